"""Landed pages to rows in document order: text nodes, headings and table rows with what their cells hold."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinelake.sources.html import HIDDEN

CELL = "struct<text:string,nodes:array<string>,links:array<struct<href:string,label:string>>,images:string,image:string,heading:string,genres:string,css:string,span:int>"
SCHEMA = f"pos int, kind string, table_no int, line string, css string, cells array<{CELL}>, links array<struct<href:string,label:string>>"
_LINK = pa.struct([("href", pa.string()), ("label", pa.string())])
_CELL = pa.struct([
    ("text", pa.string()), ("nodes", pa.list_(pa.string())), ("links", pa.list_(_LINK)), ("images", pa.string()), ("image", pa.string()),
    ("heading", pa.string()), ("genres", pa.string()), ("css", pa.string()), ("span", pa.int32()),
])
_HEADINGS = ("h1", "h2", "h3", "h4")
#: Class of the part of a cell that lists genres. Fixed value.
GENRES = "mojo-schedule-genres"
#: Characters of a page that are read at once, and where a page may be cut.
PIECE = 1 << 20
_CUT = re.compile(r"<(?=(?:tr|table|p|div|li|h[1-4])[\s>])", re.I)


def _squash(parts) -> str:
    return " ".join(" ".join(parts).split())


class _Reader(HTMLParser):
    """Collects (kind, table_no, line, css, cells, links) rows; `scopes` are the roots that are open and the rows seen under each."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.roots: dict[str, list[int]] = {"article": [-1, -1], "main": [-1, -1], "body": [-1, -1]}
        self.hidden = self.tables = 0
        self.open: list[dict] = []  # headings and cells that collect text
        self.row: dict | None = None
        self.link: dict | None = None
        self.genres = 0  # depth of open elements in a list of genres

    def _add(self, kind: str, **more):
        self.rows.append({"kind": kind, "table_no": self.tables, "line": "", "css": "", "cells": [], "links": []} | more)

    def handle_starttag(self, tag, attrs):
        at = {k: v or "" for k, v in attrs}
        if tag in HIDDEN:
            self.hidden += 1
        if tag in self.roots and self.roots[tag][0] < 0:
            self.roots[tag][0] = len(self.rows)
        if self.genres and tag not in ("br", "img"):
            self.genres += 1
        elif tag == "div" and GENRES in at.get("class", "").split():
            self.genres = 1
        if tag == "table":
            self.tables += 1
        elif tag == "tr":
            self._end_row()
            self.row = {"css": at.get("class", ""), "cells": []}
        elif tag in ("td", "th") and self.row is not None:
            self._close(("td", "th"))
            cell = {"tag": tag, "parts": [], "links": [], "images": [], "image": "", "heading": [], "genres": [], "css": at.get("class", ""), "span": int(at.get("colspan") or 1) if (at.get("colspan") or "1").isdigit() else 1}
            self.row["cells"].append(cell)
            self.open.append(cell)
        elif tag in _HEADINGS:
            self.open.append({"tag": tag, "parts": [], "links": []})
        elif tag == "a":
            self.link = {"href": at.get("href", ""), "parts": []}
            for o in self.open:
                o["links"].append(self.link)
        elif tag == "img":
            for o in self.open:
                if "images" in o:
                    o["images"].append(at.get("alt") or at.get("title") or "")
                    o["image"] = at.get("data-a-hires") or at.get("src") or o["image"]

    def _close(self, tags):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i]["tag"] in tags:
                return self.open.pop(i)
        return None

    def _end_row(self):
        self._close(("td", "th"))
        if self.row is not None:
            cells = [
                {"text": _squash(c["parts"]), "nodes": [t for p in c["parts"] if (t := _squash([p]))], "links": _links(c["links"]), "images": _squash(c["images"]), "image": c["image"],
                 "heading": _squash(c["heading"]), "genres": _squash(c["genres"]), "css": c["css"], "span": c["span"]}
                for c in self.row["cells"]
            ]
            self._add("row", css=self.row["css"], cells=cells, line=_squash(c["text"] for c in cells))
        self.row = None

    def handle_endtag(self, tag):
        if tag in HIDDEN and self.hidden:
            self.hidden -= 1
        if self.genres and tag not in ("br", "img"):
            self.genres -= 1
        if tag in self.roots and self.roots[tag][1] < 0:
            self.roots[tag][1] = len(self.rows)
        if tag in _HEADINGS and (done := self._close((tag,))):
            inside = next((o for o in self.open if "heading" in o), None)
            if inside is not None and not inside["heading"]:
                inside["heading"] = done["parts"]
            self._add("heading", line=_squash(done["parts"]), css=tag, links=_links(done["links"]))
        elif tag in ("td", "th"):
            self._close((tag,))
        elif tag == "tr" or tag == "table":
            self._end_row()
        elif tag == "a" and self.link is not None:
            self._add("link", line=_squash(self.link["parts"]), links=_links([self.link]))
            self.link = None

    def handle_data(self, data):
        if self.hidden:
            return
        for o in self.open:
            o["parts"].append(data)
            if self.genres and "genres" in o:
                o["genres"].append(data)
        if self.link is not None:
            self.link["parts"].append(data)
        for line in data.split("\n"):
            if text := _squash([line]):
                self._add("text", line=text)

    def close(self):
        super().close()
        self._end_row()


def _links(found: list[dict]) -> list[dict]:
    return [{"href": x["href"], "label": _squash(x["parts"])} for x in found]


def read(html: str | None) -> list[dict]:
    """Rows of the first article of a page, else its main part, else its body, else all of it; links come from the whole page."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    start, end = next(((s, e if e >= 0 else len(reader.rows)) for s, e in reader.roots.values() if s >= 0), (0, len(reader.rows)))
    return [{"pos": i} | r for i, r in enumerate(reader.rows) if r["kind"] == "link" or start <= i < end]


class _Count:
    """Stands for the rows of a reader that are only counted."""

    def __init__(self):
        self.n = 0

    def __len__(self):
        return self.n

    def append(self, row):
        self.n += 1


class _Passing(_Count):
    """Counts rows and holds those that weren't handed on yet."""

    def __init__(self):
        super().__init__()
        self.held: list[dict] = []

    def append(self, row):
        self.held.append({"pos": self.n} | row)
        self.n += 1


def _fed(reader: _Reader, html: str) -> Iterator[None]:
    """Feeds a page piece by piece, cut before elements that end a text anyway."""
    at = 0
    while at < len(html):
        cut = _CUT.search(html, at + PIECE)
        end = cut.start() if cut else len(html)
        reader.feed(html[at:end])
        at = end
        yield
    reader.close()
    yield


def read_parts(html: str | None) -> Iterator[list[dict]]:
    """The rows of read() in parts; of a large page neither all rows nor a second copy are held. It is gone through twice: where its main part lies is known at its end only."""
    if len(html or "") <= PIECE:
        yield read(html)
        return
    reader = _Reader()
    reader.rows = _Count()
    for _ in _fed(reader, html):
        pass
    start, end = next(((s, e if e >= 0 else len(reader.rows)) for s, e in reader.roots.values() if s >= 0), (0, len(reader.rows)))
    reader = _Reader()
    reader.rows = _Passing()
    for _ in _fed(reader, html):
        held, reader.rows.held = reader.rows.held, []
        yield [r for r in held if r["kind"] == "link" or start <= r["pos"] < end]


def blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, pos, kind, table_no, line, css, cells, links): `text`, `heading`, `row` and `link` rows of each page, each where it ends.

    Null and empty pages have no rows; rows with a null id are left out. One pass, no shuffle.
    """
    kind = dict(pages.dtypes)[id_col]
    types = {"pos": pa.int32(), "kind": pa.string(), "table_no": pa.int32(), "line": pa.string(), "css": pa.string(), "cells": pa.list_(_CELL), "links": pa.list_(_LINK)}

    def run(batches):
        for batch in batches:
            for i, html in enumerate(batch.column(1)):
                for rows in read_parts(html.as_py()):
                    ids = pa.concat_arrays([batch.column(0).slice(i, 1)] * len(rows)) if rows else batch.column(0).slice(0, 0)
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[c] for r in rows], t) for c, t in types.items())], [id_col, *types])

    return pages.select(id_col, html_col).filter(F.col(id_col).isNotNull()).mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}")
