"""Artist charts: pages to ranked rows, new entries over weeks, and what artist pages say."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinelake.functions import dates, text
from cinelake.functions.text import squash
from cinelake.operators import dedupe
from cinelake.operators.spread import spread
from cinelake.sources.calendars import absolute
from cinelake.sources.html import HIDDEN

# Fixed values.
CHART_PAGE = "https://www.billboard.com/charts/artist-100/"
CONTAINERS = ("o-chart-results-list-row-container", "chart-results-list-row-container")
CAPTIONS = ("last week", "peak pos.", "wks on chart")
STAT = re.compile(r"(?i)^(?:\d+|-|NEW|RE-ENTRY|RE ENTRY|RE- ENTRY)$")
RANKS, RANK_TOKENS, MOST_DETAILS = 100, 8, 1200
MEMBERS = {
    "rank": ["rank", "position", "chartPosition"], "artist": ["artist", "artistName", "title", "name"], "last_week": ["lastWeek", "last_week", "last"],
    "peak": ["peak", "peakPosition", "peak_pos"], "weeks": ["weeks", "weeksOnChart", "weeks_on_chart"], "url": ["artistUrl", "artistURL", "artist_url", "artistLink", "artist_link", "url", "link"],
}
_VOID = ("br", "img", "input", "meta", "link", "hr", "source")


class _Containers(HTMLParser):
    """Text nodes, the artist's heading and its link of each chart row."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[dict] = []
        self.depth = self.hidden = 0
        self.heading = False
        self.anchors: list[str] = []

    def handle_starttag(self, tag, attrs):
        at = {k: v or "" for k, v in attrs}
        if tag in HIDDEN:
            self.hidden += 1
        css = at.get("class", "").split()
        if not self.depth and tag == "div" and any(c in css for c in CONTAINERS):
            self.found.append({"tokens": [], "artist": [], "url": "", "link": ""})
            self.depth = 1
            return
        if not self.depth:
            return
        if tag not in _VOID:
            self.depth += 1
        if tag == "a":
            self.anchors.append(at.get("href", ""))
            if "/artist/" in self.anchors[-1] and not self.found[-1]["link"]:
                self.found[-1]["link"] = self.anchors[-1]
        if tag == "h3" and not self.found[-1]["artist"] and (at.get("id") == "title-of-a-story" or "c-title" in css):
            self.heading = True
            self.found[-1]["url"] = self.anchors[-1] if self.anchors else ""

    def handle_endtag(self, tag):
        if tag in HIDDEN and self.hidden:
            self.hidden -= 1
        if tag == "h3":
            self.heading = False
        if tag == "a" and self.anchors:
            self.anchors.pop()
        if self.depth and tag not in _VOID:
            self.depth -= 1

    def handle_data(self, data):
        token = " ".join(data.split())
        if self.hidden or not self.depth or not token:
            return
        if token.lower() not in CAPTIONS:
            self.found[-1]["tokens"].append(token)
        if self.heading:
            self.found[-1]["artist"].append(token)


def _of_containers(html: str) -> list[tuple]:
    reader = _Containers()
    reader.feed(html)
    reader.close()
    out = []
    for row in reader.found:
        artist, tokens = " ".join(row["artist"]), row["tokens"]
        rank = next((t for t in tokens[:RANK_TOKENS] if t.isdecimal() and 1 <= int(t) <= RANKS), None)
        if artist and rank:
            at = tokens.index(artist) if artist in tokens else 0
            stats = [t for t in tokens[at + 1 :] if STAT.match(t)][:3]
            out.append((rank, artist, *(stats + [""] * 3)[:3], row["url"] or row["link"]))
    return out


def _members(value):
    """All objects inside a JSON value, outer ones first."""
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            yield v
            todo.extend(reversed(list(v.values())))
        elif isinstance(v, list):
            todo.extend(reversed(v))


def _said(item: dict, name: str) -> str:
    found = next((item[k] for k in MEMBERS[name] if item.get(k)), "")
    return " ".join(str(found).split()) if not isinstance(found, (dict, list)) else ""


def _of_json(html: str) -> list[tuple]:
    out = []
    for script in re.findall(r"(?is)<script[^>]*>(.*?)</script>", html):
        if "Artist 100" not in script:
            continue
        try:
            rows = [(_said(i, "rank"), _said(i, "artist"), _said(i, "last_week"), _said(i, "peak"), _said(i, "weeks"), u if "/artist/" in (u := _said(i, "url")) or "billboard.com" in u else "") for i in _members(json.loads(script.strip()))]
            rows = [r for r in rows if r[0].isdecimal() and r[1]]
        except ValueError:
            rows = []
        out += rows or [(r, a.encode().decode("unicode_escape", "ignore") if "\\" in a else a, "", "", "", "") for r, a in re.findall(r'(?is)"rank"\s*:\s*"?(\d{1,3})"?.{0,500}?"(?:artistName|artist|title|name)"\s*:\s*"([^"]+)"', script)]
    return out


def chart_rows(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, pos, rank, artist, last_week, peak, weeks, chart_date, artist_url), in the order of ranks within a page.

    Read from the rows' containers, else from embedded JSON. Rows that repeat a rank and artist
    count once. A page without a row has none here: `empty_pages` tells which.
    """
    kind = dict(pages.dtypes)[id_col]
    names = ["pos", "rank", "artist", "last_week", "peak", "weeks", "url"]

    def run(batches):
        for batch in batches:
            for i, html in enumerate(batch.column(1).to_pylist()):
                rows = [(n, *r) for n, r in enumerate(_of_containers(html or "") or _of_json(html or ""))]
                if rows:
                    ids = pa.concat_arrays([batch.column(0).slice(i, 1)] * len(rows))
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int32() if n == "pos" else pa.string()) for n, c in zip(names, zip(*rows)))], [id_col, *names])

    found = pages.select(id_col, html_col).filter(F.col(id_col).isNotNull()).mapInArrow(run, f"`{id_col}` {kind}, pos int, rank string, artist string, last_week string, peak string, weeks string, url string")
    once = dedupe.keep_first(found, [id_col, "rank", "artist"], ["pos"])
    said = pages.select(id_col, chart_date(html_col).alias("chart_date"))
    url = F.when(F.col("url") == "", "").otherwise(absolute("url", CHART_PAGE))
    return once.join(said, id_col).select(id_col, "pos", "rank", "artist", "last_week", "peak", "weeks", "chart_date", url.alias("artist_url"))


def rank_order(rank: str = "rank"):
    """Ranks as numbers; what is none comes last."""
    return F.coalesce(F.when(F.col(rank).rlike(r"^\d+$"), F.col(rank).try_cast("int")), F.lit(999))


def chart_date(html):
    """The day after `Week of`, else that of the canonical address; null if a page has neither."""
    plain = squash(F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]+>", " "))
    week = F.replace(F.regexp_extract(plain, r"(?i)\bWeek of\s+([a-z]+\.?\s+\d{1,2},\s*\d{4})", 1), F.lit("."), F.lit(""))
    return F.coalesce(dates.parse_long_date(F.initcap(week)), F.try_to_date(F.regexp_extract(html, r"/charts/artist-100/(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd"))


def empty_pages(pages: DataFrame, rows: DataFrame, id_col: str = "page_id") -> DataFrame:
    return pages.select(id_col).join(rows.select(id_col).distinct(), id_col, "left_anti")


def new_entries(rows: DataFrame, requested: str = "requested") -> DataFrame:
    """Rows without a last week, the first of each artist (whatever the case) and chart day, over all weeks."""
    fresh = rows.filter(text.is_new_entry("last_week")).withColumn("chart_date", F.coalesce("chart_date", requested))
    return dedupe.keep_first(fresh, [F.lower("artist"), "chart_date"], [requested, "pos"])


def page_details(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, details): descriptions of a page's meta elements and JSON-LD, each once by key, joined by bars and cut at 1200 characters."""
    from cinelake.sources.lookups import ld_items, ld_texts

    pages = spread(pages.select(id_col, html_col))
    metas = [r'(?is)<meta[^>]*name=["\']description["\'][^>]*content="([^"]*)"', r'(?is)<meta[^>]*property=["\']og:description["\'][^>]*content="([^"]*)"', r'(?is)<meta[^>]*name=["\']twitter:description["\'][^>]*content="([^"]*)"']
    said = pages.select(id_col, F.posexplode(F.array(*(squash(F.regexp_extract(html_col, m, 1)) for m in metas))).alias("n", "text"))
    item = lambda p: F.get_json_object("item", p)
    extra = F.concat_ws("; ", *(F.concat(F.lit(label), F.nullif(F.array_join(ld_texts(item(p)), "; "), F.lit(""))) for label, p in (("Genre: ", "$.genre"), ("Birth date: ", "$.birthDate"), ("Birth place: ", "$.birthPlace"))))
    more = ld_items(pages, id_col, html_col).select(id_col, "place", F.posexplode(F.array(F.coalesce(squash(item("$.description")), F.lit("")), extra)).alias("part", "text"))
    placed = said.select(id_col, F.lit(0).alias("a"), F.col("n").alias("b"), F.lit(0).alias("c"), F.lit(0).alias("d"), "text").unionByName(more.select(id_col, F.lit(1).alias("a"), F.col("place.script").alias("b"), F.col("place.n").alias("c"), F.col("part").alias("d"), "text"))
    firsts = placed.withColumn("key", text.title_key("text")).filter("key <> ''").withColumn("r", F.row_number().over(Window.partitionBy(id_col, "key").orderBy("a", "b", "c", "d"))).filter("r = 1")
    joined = firsts.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("a", "b", "c", "d", "text"))).alias("parts"))
    return pages.select(id_col).join(joined, id_col, "left").select(id_col, F.substring(F.coalesce(F.array_join(F.transform("parts", lambda x: x["text"]), " | "), F.lit("")), 1, MOST_DETAILS).alias("details"))
