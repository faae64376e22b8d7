"""Landed pages to rows: visible lines, table cells, links and cards; the rest of parsing is window logic over those rows."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinelake.functions.markers import holds_any
from cinelake.operators.numbering import running_totals
from cinelake.sources.scratch import written

# Fixed values.
HIDDEN = ("script", "style", "noscript", "svg", "template")
BREAKS = ("p", "div", "br", "li", "ul", "ol", "tr", "td", "th", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "nav", "main", "title", "blockquote", "pre", "hr")
CHALLENGES = ("just a moment", "cf-browser-verification", "challenge-platform")


class _Page(HTMLParser):
    """One pass over a page that collects lines, links and table rows."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[str] = []
        self.links: list[tuple[str, str]] = []
        self.rows: list[tuple[int, list[str]]] = []
        self._text: list[str] = []
        self._hidden = self._tables = 0
        self._link: list | None = None
        self._cells: list[list[str]] | None = None

    def _flush(self):
        if line := " ".join("".join(self._text).split()):
            self.lines.append(line)
        self._text = []

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self._hidden += 1
        if tag in BREAKS:
            self._flush()
        if tag == "table":
            self._tables += 1
        if tag == "tr":
            self._cells = []
        if tag in ("td", "th") and self._cells is not None:
            self._cells.append([])
        if tag == "a":
            self._link = [dict(attrs).get("href") or "", []]

    def handle_endtag(self, tag):
        if tag in HIDDEN and self._hidden:
            self._hidden -= 1
        if tag in BREAKS:
            self._flush()
        if tag == "tr" and self._cells is not None:
            self.rows.append((self._tables, [" ".join("".join(c).split()) for c in self._cells]))
            self._cells = None
        if tag == "a" and self._link is not None:
            self.links.append((self._link[0], " ".join("".join(self._link[1]).split())))
            self._link = None

    def handle_data(self, data):
        if self._hidden:
            return
        self._text.append(data)
        if self._link is not None:
            self._link[1].append(data)
        if self._cells:
            self._cells[-1].append(data)

    def close(self):
        super().close()
        self._flush()


def parse(html: str | None) -> _Page:
    page = _Page()
    page.feed(html or "")
    page.close()
    return page


def _rows(pages: DataFrame, id_col: str, html_col: str, schema: str, columns: list[str], produce) -> DataFrame:
    def run(frames):
        for frame in frames:
            out = [(i, *row) for i, html in zip(frame["id"], frame["html"]) for row in produce(html)]
            yield pd.DataFrame(out, columns=[id_col, *columns])

    return pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).filter("id is not null").mapInPandas(run, f"{id_col} {dict(pages.dtypes)[id_col]}, {schema}")


def lines(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, pos, line): visible text, a line for each block."""
    return _rows(pages, id_col, html_col, "pos int, line string", ["pos", "line"], lambda h: list(enumerate(x for x in parse(h).lines if x != "* * *")))


def links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, pos, href, label) of the anchors in order."""
    return _rows(pages, id_col, html_col, "pos int, href string, label string", ["pos", "href", "label"], lambda h: [(i, *x) for i, x in enumerate(parse(h).links)])


def table_rows(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, table_no, pos, cells) of the table rows in order."""
    return _rows(pages, id_col, html_col, "table_no int, pos int, cells array<string>", ["table_no", "pos", "cells"], lambda h: [(t, i, c) for i, (t, c) in enumerate(parse(h).rows)])


def is_challenge(html: Column | str) -> Column:
    """An interstitial instead of a page, told by its first 4000 characters."""
    return holds_any(F.lower(F.substring(html, 1, 4000)), CHALLENGES)


# Addresses of thumbnails and of detail pages, classes of a card's heading and label, what a title's image text ends in,
# what stands over the part of a listing that repeats cards, cards of a page, and the columns of the export.
THUMBNAIL = r"https?://[^\s\"']*?/images/(?P<slug>[^/\"']+)/ytimg/(?P<video_id>[A-Za-z0-9_-]{11})/(?P<file>[^\s\"'>]+)"
DETAIL = r"/m(?P<movie_id>\d+)/(?P<slug>[^/\"'?#]+)/videos/(?P<video_page_id>\d+)"
HEADING_CLASS, LABEL_CLASS = "media-heading", "small"
IMAGE_TEXT_END = r"(?i)\s+trailer\s*$"
SECTION_ENDS = ("most viewed", "most popular")
CARDS_A_PAGE = 24
FEED_SITE = "https://www.movieinsider.com"
FEED_COLUMNS = ["#", "Title", "Trailer", "YouTube Video ID", "YouTube URL", "Thumbnail URL", "MovieInsider Movie ID", "MovieInsider Slug", "MovieInsider URL", "Source Page", "Page URL"]

_PARTS = ["kind", "text", "address", "slug", "video_id", "movie_id", "video_page_id"]


class _Listing(HTMLParser):
    """Events of a listing in document order: a row (kind, text, address, slug, video_id, movie_id, video_page_id) for each image, link, heading, label and end of the section."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.events: list[tuple] = []
        self._link = ("", "", "")  # of the open anchor: slug, movie, page
        self._collects: tuple[str, str] | None = None  # tag and kind of the element whose text is wanted
        self._text: list[str] = []

    def handle_starttag(self, tag, attrs):
        at = {k: v or "" for k, v in attrs}
        classes = at.get("class", "").split()
        if tag == "a":
            found = re.search(DETAIL, at.get("href", ""), re.I)
            self._link = (found["slug"], found["movie_id"], found["video_page_id"]) if found else ("", "", "")
            if found:
                self.events.append(("link", "", "", self._link[0], "", *self._link[1:]))
        if (found := next((m for v in at.values() if (m := re.search(THUMBNAIL, v, re.I))), None)) is not None:
            own = self._link
            if own[1] and self.events[-1][0] == "link":  # the link is the image's own, not one that follows the image before
                self.events.pop()
            self.events.append(("image", " ".join(at.get("alt", "").split()), found[0], own[0] or found["slug"], found["video_id"], *own[1:]))
        if (tag == "h3" and HEADING_CLASS in classes) or (tag == "p" and classes[:1] == [LABEL_CLASS]):
            self._collects, self._text = (tag, "heading" if tag == "h3" else "label"), []

    def handle_endtag(self, tag):
        if tag == "a":
            self._link = ("", "", "")
        if self._collects and tag == self._collects[0]:
            self.events.append((self._collects[1], " ".join("".join(self._text).split()), "", "", "", "", ""))
            self._collects = None

    def handle_data(self, data):
        if self._collects:
            self._text.append(data)
        if any(end in data.lower() for end in SECTION_ENDS):
            self.events.append(("end", "", "", "", "", "", ""))


def listing_events(pages: DataFrame, page_no: str = "page_no", html_col: str = "html") -> DataFrame:
    """(page_no, pos, kind, text, address, slug, video_id, movie_id, video_page_id) of what a listing's cards are made of, in order; no shuffle."""

    def read(html):
        listing = _Listing()
        listing.feed(html or "")
        listing.close()
        return [(i, *event) for i, event in enumerate(listing.events)]

    return _rows(pages, page_no, html_col, "pos int, " + ", ".join(f"{p} string" for p in _PARTS), ["pos", *_PARTS], read)


def listing_cards(pages: DataFrame, page_no: str = "page_no", html_col: str = "html") -> DataFrame:
    """(page_no, pos, title, slug, movie_id, video_page_id, label, video_id, thumbnail): cards of each page, a video once, at most a page's number of them.

    An image with a thumbnail's address opens a card, which the heading, the label and, where the
    image stands outside one, the link that follow belong to. Nothing counts from where the most
    viewed begin, unless no card came before. The title is the image's text, the heading's where
    that is missing or cut short, else the slug's words.
    """
    so_far = Window.partitionBy(page_no).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    numbered = listing_events(pages, page_no, html_col).withColumn("item", F.count_if(F.col("kind") == "image").over(so_far)).filter("item > 0")
    open_ = numbered.withColumn("ended", F.max(F.col("kind") == "end").over(so_far)).filter(~F.col("ended"))
    first = lambda kind, value, also=F.lit(True): F.min_by(F.when((F.col("kind") == kind) & also, value), F.when((F.col("kind") == kind) & also, F.col("pos")))
    link = F.struct("slug", "movie_id", "video_page_id")
    items = open_.groupBy(page_no, "item").agg(
        first("image", F.struct("text", "address", "video_id", "slug", "movie_id", "video_page_id")).alias("i"), first("link", link).alias("l"),
        first("heading", F.col("text")).alias("heading"), first("label", F.col("text")).alias("label"),
    )
    own = F.col("i.movie_id") != ""
    told = F.regexp_replace("i.text", IMAGE_TEXT_END, "")
    cut = lambda c: F.trim(F.regexp_replace(c, r"\.\.\.$", ""))
    title = F.coalesce(F.when(~told.endswith("..."), F.nullif(told, F.lit(""))), F.nullif(cut(F.col("heading")), F.lit("")), F.nullif(told, F.lit("")), F.initcap(F.replace("i.slug", F.lit("-"), F.lit(" "))))
    of = lambda name: F.when(own, F.col(f"i.{name}")).otherwise(F.coalesce(f"l.{name}", f"i.{name}")).alias(name)
    cards = items.select(page_no, "item", title.alias("title"), of("slug"), of("movie_id"), of("video_page_id"), F.coalesce("label", F.lit("Trailer")).alias("label"), F.col("i.video_id").alias("video_id"), F.col("i.address").alias("thumbnail"))
    once = cards.withColumn("again", F.row_number().over(Window.partitionBy(page_no, "video_id").orderBy("item"))).filter("again = 1")
    placed = once.withColumn("pos", F.row_number().over(Window.partitionBy(page_no).orderBy("item")) - 1).filter(F.col("pos") < CARDS_A_PAGE)
    return placed.select(page_no, "pos", "title", "slug", "movie_id", "video_page_id", "label", "video_id", "thumbnail")


def trailer_feed(pages: DataFrame, page_no: str = "page_no", html_col: str = "html") -> DataFrame:
    """Cards of all pages before the first empty one, each video once (its first card), numbered in feed order."""
    found = written(listing_cards(pages, page_no, html_col), "cards")
    counted = pages.select(page_no).join(found.select(page_no).distinct().withColumn("full", F.lit(True)), page_no, "left")
    stop = counted.filter("full is null").agg(F.min(page_no).alias("stop"))
    kept = found.join(F.broadcast(stop), F.lit(True)).filter(F.col("stop").isNull() | (F.col(page_no) < F.col("stop"))).drop("stop")
    firsts = kept.withColumn("r", F.row_number().over(Window.partitionBy("video_id").orderBy(page_no, "pos"))).filter("r = 1").drop("r")
    firsts = written(firsts, "feed")
    # numbers from counts by page: no window over the whole feed
    before = running_totals(firsts.groupBy(page_no).agg(F.count("*").alias("n")), page_no, "n", "before")
    place = F.row_number().over(Window.partitionBy(page_no).orderBy("pos"))
    return firsts.join(before.select(page_no, "before"), page_no).withColumn("number", (F.col("before") + place).cast("int")).drop("before")


def feed_rows(feed: DataFrame, page_no: str = "page_no", page_url: Column | str = "page_url") -> DataFrame:
    """A trailer feed in the columns of its export."""
    detail = F.when(F.col("movie_id") == "", "").otherwise(F.concat(F.lit(FEED_SITE + "/m"), "movie_id", F.lit("/"), "slug", F.lit("/videos/"), "video_page_id"))
    values = [F.col("number"), F.col("title"), F.col("label"), F.col("video_id"), F.concat(F.lit("https://www.youtube.com/watch?v="), "video_id"), F.col("thumbnail"), F.col("movie_id"), F.col("slug"), detail, F.col(page_no), page_url if isinstance(page_url, Column) else F.col(page_url)]
    return feed.select(*(v.alias(n) for v, n in zip(values, FEED_COLUMNS)))


def rest_from(name: str, start: int | Column) -> Column:
    """An array's elements from a place on."""
    return F.slice(F.col(name), F.lit(start) if isinstance(start, int) else start, F.greatest(F.size(name), F.lit(1)))


def carry_forward(df: DataFrame, by: list[str], order: str, value: Column, name: str) -> DataFrame:
    """The last value so far that isn't null: a heading over the rows below it."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def item_numbers(df: DataFrame, by: list[str], order: str, opens: Column, name: str) -> DataFrame:
    """Which item a row belongs to, where rows that `opens` holds for start one."""
    return df.withColumn(name, F.sum(F.when(opens, 1).otherwise(0)).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def embedded_json(html: str | None) -> list[str]:
    """Contents of JSON script elements."""
    return re.findall(r'(?is)<script[^>]*type="application/(?:ld\+)?json"[^>]*>(.*?)</script>', html or "")
