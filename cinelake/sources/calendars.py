"""Release calendars: rows of `blocks` to records. Headings are carried forward and items are numbered by windows of one page."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinelake.functions import classify, dates
from cinelake.functions.markers import any_of
from cinelake.functions.text import col, squash
from cinelake.sources.html import rest_from as _from
from cinelake.sources.html import carry_forward, item_numbers

# Fixed values.
TV_PAGE = "https://www.metacritic.com/news/tv-premiere-dates/"
GAME_PAGE = "https://www.metacritic.com/news/major-new-and-upcoming-video-games-ps5-xbox-switch-pc/"
MOVIE_PAGE = "https://www.metacritic.com/news/upcoming-movie-release-dates-schedule/"
SITE = "https://www.metacritic.com"
NOISE = ["advertisement", "register", "cookie settings", "overview", "follow us", "additional content by keith kimbell."]
NOISE_STARTS = ["image: bar", "video and images", "movie title data", "copyright", "©"]
AVAILABILITY = [r"Streaming\s*\([^)]+\)", "Limited/VOD", "RENT/BUY", "Event screening", "Event screeing", "Rerelease", "Streaming", "Limited", "WIDE", "VOD", "LA/NY", "NY/LA", "NY", "LA", "IMAX"]
UPPER = ["WIDE", "RENT/BUY", "VOD", "NY", "LA", "IMAX"]
MOVIE_GENRES = [
    "Action-Adventure", "Action", "Adventure", "Animation", "Anime", "Comedy", "Documentary", "Drama", "Family", "Fantasy", "Foreign", "Horror",
    "Music", "Musical", "Mystery", "Rom-Com", "Sci-Fi", "Sports", "Thriller",
]
UNGUESSED = ["Music Special", "Special"]
NO_TITLES = ["trailer", "trailer2", "image", "see all", "more", "tbd"]
# What is taken out of a calendar's title, in this order.
TITLE_CLEANERS = [
    (r"(?i)^\d{2,3}\s+(?=\(\$\))", ""),
    (r"(?i)^tbd\s+", ""),
    (r"^\(\$\)\s*", ""),
    (r"\s*\(\$\)\s*", " "),
    (r"(?i)\s+[-\u2013]\s+Trailer\d?.*$", ""),
    (r"(?i)\bTrailer\d?\b.*$", ""),
    (r"(?i)Image:\s*(?:new series|limited series|movie|bar)", ""),
    (r"(?i)\s+\d+p(?:\s+[A-Z]{2})?(?:\s*/\s*\d+p\s+[A-Z]{2})?$", ""),
]

HEADING = r"(?i)^(?:MON|TUE|WED|THU|FRI|SAT|SUN)\s*/\s*([A-Z]+\.?\s+\d{1,2}(?:,\s*\d{4})?)$"
YEAR = r"^(20\d{2})$"
GAME_DATE = r"^(.+?)\s+-\s+([A-Za-z]+\.?\s+\d{1,2}(?:,\s*\d{4})?)(.*)$"
SCORED = r"(?i)^(?:\d{2,3}|tbd)"


# Columns


def clean_title(c: Column | str) -> Column:
    """A calendar's title without score, price mark, trailer, image caption and hour."""
    t = squash(c)
    for pattern, by in TITLE_CLEANERS:
        t = F.regexp_replace(t, pattern, by)
    return F.trim(squash(t), F.lit(" -:"))


def calendar_key(c: Column | str) -> Column:
    """Key under which a calendar's titles and anchors meet."""
    return squash(F.regexp_replace(F.replace(F.lower(clean_title(c)), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))


def score(c: Column | str) -> Column:
    found = F.regexp_extract(F.trim(col(c)), r"(?i)^(\d{2,3}|tbd)\b", 1)
    return F.when(F.lower(found) == "tbd", "tbd").otherwise(found)


def is_noise(c: Column | str) -> Column:
    t = F.lower(F.trim(col(c)))
    return (t == "") | t.isin(NOISE) | t.rlike("^(?:" + any_of(NOISE_STARTS) + ")")


def title_slug(c: Column | str) -> Column:
    t = F.regexp_replace(F.replace(clean_title(c), F.lit("&"), F.lit(" and ")), "['’]", "")
    return F.lower(F.trim(F.regexp_replace(t, "[^A-Za-z0-9]+", "-"), F.lit("-")))


def page_url(title: Column | str, source_url: Column, release_type: Column, content_format: Column, default: str, details: Column | None = None) -> Column:
    """The source's address where there is one, else that of the title's page by media type and slug; empty without a slug."""
    said = F.lower(F.concat_ws(" ", release_type, content_format, details if details is not None else F.lit("")))
    media = F.when(F.contains(said, F.lit("video game")) | F.lit(default == "game"), "game").when(said.rlike(r"\bmovie\b"), "movie").otherwise(default or "tv")
    slug = title_slug(title)
    made = F.when(slug == "", "").otherwise(F.concat(F.lit(SITE + "/"), media, F.lit("/"), slug, F.lit("/")))
    return F.coalesce(F.nullif(source_url, F.lit("")), made)


def absolute(href: Column | str, base: str) -> Column:
    """A link's address seen from a page: with scheme as it is, from the host's root, or beside the page."""
    h, host = F.coalesce(col(href), F.lit("")), re.match(r"https?://[^/]+", base)[0]
    beside = base[: base.rindex("/") + 1] if base.count("/") > 2 else base + "/"
    return (
        F.when(h == "", base).when(h.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), h).when(h.startswith("//"), F.concat(F.lit(host.split("//")[0]), h))
        .when(h.startswith("/"), F.concat(F.lit(host), h)).when(h.rlike(r"^[?#]"), F.concat(F.lit(base), h)).otherwise(F.concat(F.lit(beside), h))
    )


_NETWORK = rf"(?i)(?<![A-Za-z0-9])(?:{any_of(classify.NETWORKS)})(?![A-Za-z0-9])"


def before_network(c: Column | str) -> Column:
    return squash(F.regexp_replace(squash(c), rf"{_NETWORK}.*$", ""))


def from_network(c: Column | str) -> Column:
    return squash(F.regexp_extract(squash(c), rf"{_NETWORK}.*$", 0))


def network_list(c: Column | str) -> Column:
    return F.array_join(classify.networks(c), "; ")


def guessed_genre(c: Column | str) -> Column:
    """What stands before a network in a text that starts with a genre; empty if none does."""
    known = [g for g in classify.GENRES if g not in UNGUESSED]
    return F.when(col(c).rlike(rf"(?i)^(?:{any_of(known)})(?:\b|/)"), before_network(c)).otherwise("")


def genre_and_details(c: Column | str) -> Column:
    """(genre, details) of `[note] Genre: what it is`."""
    t = squash(c)
    noted = r"^(\[[^\]]+\])\s*[-–]?\s*(.*)$"
    note, rest = F.regexp_extract(t, noted, 1), F.when(t.rlike(noted), squash(F.regexp_extract(t, noted, 2))).otherwise(t)
    split = F.contains(rest, F.lit(":"))
    after = F.substring(rest, F.locate(":", rest) + 1, F.length(rest))
    return F.struct(
        F.when(split, squash(F.substring_index(rest, ":", 1))).otherwise(rest).alias("genre"),
        F.when(split, squash(F.concat_ws(" ", F.nullif(note, F.lit("")), after))).otherwise(note).alias("details"),
    )


def availability_values(c: Column | str) -> Column:
    """Availability terms of a text in the list's order, each once; what a longer one covers doesn't count."""
    t, found = squash(c), F.array().cast("array<string>")
    for pattern in AVAILABILITY:
        values = F.transform(F.regexp_extract_all(t, F.lit(f"(?i)({pattern})"), F.lit(1)), lambda v: F.when(F.upper(squash(v)).isin(UPPER), F.upper(squash(v))).otherwise(squash(v)))
        found, t = F.concat(found, values), F.regexp_replace(t, f"(?i){pattern}", "\u0001")
    return F.array_distinct(found)


def is_movie_genre(c: Column | str) -> Column:
    parts = F.filter(F.transform(F.split(col(c), "[/,]"), lambda p: F.lower(F.trim(p))), lambda p: p != "")
    return (col(c) != "") & (F.length(col(c)) <= 80) & F.forall(parts, lambda p: p.isin([g.lower() for g in MOVIE_GENRES]))


def movie_genre(c: Column | str) -> Column:
    """The genre a detail line starts with, up to a dash or an availability term; empty if it isn't one."""
    t = F.regexp_replace(squash(c), r"\s+\([^)]+\)\s*$", "")
    t = F.regexp_replace(t, r"\s+-\s+.*$", "")
    for pattern in AVAILABILITY:
        t = F.regexp_replace(t, rf"(?i)(?<![A-Za-z0-9]){pattern}(?![A-Za-z0-9]).*$", "")
    genre = squash(F.trim(t, F.lit(" -;/")))
    return F.when(is_movie_genre(genre), genre).otherwise("")


# Windows of a page


def dated(rows: DataFrame, page: str, as_of: dt.date) -> DataFrame:
    """Rows under a date heading, with `day` and the number of their section; headings and bare years themselves go.

    A heading without a year takes that of the last bare year or dated heading above it, as_of's
    at first, and the next year if it would lie over 45 days before as_of.
    """
    said = F.replace(F.regexp_extract("line", HEADING, 1), F.lit("."), F.lit(""))
    year = F.nullif(F.concat(F.regexp_extract("line", YEAR, 1), F.regexp_extract(said, r",\s*(\d{4})$", 1)), F.lit("")).cast("int")
    years = carry_forward(rows.withColumn("said", said), [page], "pos", year, "year")
    day = F.when(F.col("said") != "", dates.article_date(F.initcap("said"), F.coalesce("year", F.lit(as_of.year)), as_of))
    days = carry_forward(years, [page], "pos", day, "day")
    opens = (F.col("said") != "") | F.col("line").rlike(YEAR)
    return item_numbers(days, [page], "pos", opens, "section").filter(~opens & F.col("day").isNotNull()).drop("said", "year")


def anchors(rows: DataFrame, page: str, base: str) -> DataFrame:
    """(page, key, url): the first link of each title; trailers, scores and captions are no titles."""
    label, href = F.lower("line"), F.get("links", F.lit(0))["href"]
    titles = rows.filter("kind = 'link' and line <> ''").filter(
        (href != "") & ~label.isin(NO_TITLES) & ~label.rlike(r"^\d+$") & ~href.rlike("youtube|youtu\\.be") & ~label.startswith("image:") & (F.length(clean_title("line")) >= 2)
    )
    return titles.groupBy(page, calendar_key("line").alias("key")).agg(F.min_by(absolute(href, base), "pos").alias("url"))


def _items(rows: DataFrame, page: str, weak: Column, strong: Column) -> DataFrame:
    """(page, section, item, day, lines): a line opens an item if `strong`, or if `weak` and nothing has opened in its section yet."""
    first = F.min(F.when(weak | strong, F.col("pos"))).over(Window.partitionBy(page, "section"))
    opened = item_numbers(rows.withColumn("first", first), [page, "section"], "pos", (F.col("pos") == F.col("first")) | strong & (F.col("pos") > F.col("first")), "item")
    held = opened.filter("item > 0").groupBy(page, "section", "item").agg(F.first("day").alias("day"), F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    return held.select(page, "section", "item", "day", F.col("lines.pos")[0].alias("pos"), F.col("lines.line").alias("lines"))


def _finish(records: DataFrame, page: str, links: DataFrame | None, default: str, columns: list[str]) -> DataFrame:
    """Adds the addresses and keeps the first record of a title and day, by place in the page."""
    if links is not None:
        records = records.withColumn("key", calendar_key("title")).join(links, [page, "key"], "left").withColumn("source_url", F.coalesce("url", F.lit("")))
    rows = records.filter("title <> ''").withColumn("page_url", page_url("title", F.col("source_url"), F.col("release_type"), F.col("content_format"), default))
    turn = F.row_number().over(Window.partitionBy(page, F.lower("title"), "release_date").orderBy("pos"))
    return rows.withColumn("turn", turn).filter("turn = 1").select(page, "pos", *columns, "source_url", "page_url")


TV_COLUMNS = ["title", "release_type", "genre", "release_date", "content_format", "daypart", "program_type", "language_type", "availability", "score", "details"]
MOVIE_COLUMNS = ["title", "studio", "release_type", "genre", "release_date", "content_format", "availability", "score", "details"]
GAME_COLUMNS = ["title", "release_type", "genre", "release_date", "content_format", "availability", "score", "details"]


def _with_matrix(records: DataFrame, source: str) -> DataFrame:
    """Daypart, programme and language of series; others have none."""
    whole = F.concat_ws(" ", "genre", "availability", "details", source)
    series = classify.is_series_like("release_type", "content_format")
    cell = lambda c: F.when(series, c).otherwise("")
    return records.withColumns({
        "daypart": cell(classify.daypart(whole)),
        "program_type": cell(classify.program_type("release_type", "content_format", whole)),
        "language_type": cell(classify.language_type("genre", "details", whole)),
    })


def tv_items(rows: DataFrame, as_of: dt.date, page: str = "page_id") -> DataFrame:
    """Records of a TV calendar written as lines: a title, then `Genre: details` with a network, then more."""
    lines = dated(rows.filter("kind = 'text' and line not like '* * *%'"), page, as_of).filter(~is_noise("line")).withColumns({"networks": network_list("line"), "guess": guessed_genre("line")})
    t, low = F.col("line"), F.lower("line")
    marked = F.contains(low, F.lit("image:")) | F.contains(low, F.lit(" trailer")) | low.endswith("trailer") | t.rlike(r"(?i)^(?:\d{2,3}|tbd|\(\$\)|\$)")
    details = F.contains(t, F.lit(":")) | (t == F.col("networks")) | t.rlike(rf"(?i)^(?:{any_of(classify.NETWORKS)})(?![A-Za-z0-9])") | low.startswith("(also on") | (F.col("guess") != "")
    items = _items(lines, page, ~low.startswith("did you miss"), marked | ~details)
    joined = squash(F.array_join("lines", " "))
    head = F.coalesce(F.get("lines", F.lit(1)), F.lit(""))
    more = F.filter(_from("lines", 3), lambda x: ~is_noise(x))
    after = F.when(F.contains(head, F.lit(":")), F.substring(head, F.locate(":", head) + 1, F.length(head)))
    networks_of = lambda c: F.nullif(network_list(c), F.lit(""))
    named = F.coalesce(F.when(after.isNotNull(), F.coalesce(networks_of(after), networks_of(joined))).otherwise(F.nullif(from_network(head), F.lit(""))), F.get(F.filter(F.transform(more, network_list), lambda x: x != ""), F.lit(0)), networks_of(joined), F.lit(""))
    told = F.concat(F.array(F.coalesce(before_network(after), F.lit(""))), F.transform(F.filter(more, lambda x: (x == "") | (x != network_list(x))), before_network))
    records = items.select(
        page, "pos", clean_title(F.get("lines", F.lit(0))).alias("title"), F.col("day").alias("release_date"), joined.alias("joined"), score(joined).alias("score"),
        F.coalesce(F.nullif(F.when(after.isNotNull(), squash(F.substring_index(head, ":", 1))).otherwise(before_network(head)), F.lit("")), guessed_genre(joined)).alias("genre"),
        F.when(F.lower(joined).contains("rent/buy") & ~named.contains("RENT/BUY"), F.trim(F.concat(named, F.lit("; RENT/BUY")), F.lit("; "))).otherwise(named).alias("availability"),
        squash(F.array_join(F.filter(told, lambda x: x != ""), " ")).alias("details"), classify.tv_release_type(joined).alias("release_type"),
    )
    records = records.filter(~F.lower("title").startswith("trailer")).withColumn("content_format", classify.tv_content_format("release_type", "joined"))
    return _finish(_with_matrix(records, "joined"), page, anchors(rows, page, TV_PAGE), "tv", TV_COLUMNS)


def _title_link(cell: Column) -> Column:
    """The first link of a cell that is no trailer and no score."""
    label = lambda x: F.lower(x["label"])
    return F.get(F.filter(cell["links"], lambda x: ~label(x).startswith("trailer") & ~x["href"].rlike("youtube|youtu\\.be") & (label(x) != "tbd") & ~label(x).rlike(r"^\d+$")), F.lit(0))


def _without(c: Column, title: Column) -> Column:
    """The text after its title, whatever the case of either."""
    return F.when(F.startswith(F.lower(c), F.lower(title)), F.trim(F.substring(c, F.length(title) + 1, F.length(c)))).otherwise(c)


def tv_tables(rows: DataFrame, as_of: dt.date, page: str = "page_id") -> DataFrame:
    """Records of a TV calendar written as tables of score, title with details, and availability, under date headings."""
    heads = rows.filter("(kind = 'heading' and css in ('h2', 'h3')) or kind = 'row'").withColumn("line", F.when(F.col("kind") == "heading", F.col("line")).otherwise(F.concat(F.lit("row "), "line")))
    told = dated(heads, page, as_of).filter("kind = 'row' and size(cells) >= 2")
    cell = F.col("cells")
    link = F.coalesce(_title_link(F.get(cell, F.lit(1))), _title_link(F.get(cell, F.lit(0))))
    raw = F.regexp_replace(squash(F.get(cell, F.lit(1))["text"]), r"^\(\$\)\s*", "")
    genre = rf"(?i)\s(?:{any_of(classify.GENRES)})(?=\b|/|:)"
    tail = F.when(raw.rlike(r"(?i)\S\s+[-–]?\s*Trailer\d?\b"), F.regexp_extract(raw, r"(?i)\s+[-–]?\s*Trailer\d?\b.*$", 0)).otherwise(F.regexp_extract(raw, genre + ".*$", 0))
    named = F.when(_title_link(F.get(cell, F.lit(1))).isNotNull(), clean_title(_title_link(F.get(cell, F.lit(1)))["label"])).otherwise(clean_title(F.substring(raw, F.lit(1), F.length(raw) - F.length(tail))))
    base = told.select(page, "pos", F.col("day").alias("release_date"), squash(F.get(cell, F.lit(1))["text"]).alias("joined"), raw.alias("raw"), named.alias("title"), score(squash(F.get(cell, F.lit(0))["text"])).alias("score"),
                       F.lower(F.get(cell, F.lit(1))["images"]).alias("images"), F.when(link.isNull() | (link["href"] == ""), "").otherwise(absolute(link["href"], TV_PAGE)).alias("source_url"),
                       F.coalesce(squash(F.get(cell, F.lit(2))["text"]), F.lit("")).alias("stated"))
    rest = squash(F.trim(F.regexp_replace(F.regexp_replace(_without(F.col("raw"), F.col("title")), r"(?i)^\s*[-–]?\s*Trailer\d?\s*(?:[-–]\s*Trailer\d?\s*)*", ""), r"(?i)\bTrailer\d?\b", ""), F.lit(" -")))
    parts = base.withColumn("rest", rest).withColumn("parts", genre_and_details("rest"))
    pictured = F.when(F.contains("images", F.lit("limited series")), "Limited Series").when(F.contains("images", F.lit("new series")), "New Series").when(F.contains("images", F.lit("movie")), "Movie")
    records = parts.select(
        page, "pos", "title", "release_date", "joined", "score", "source_url", F.coalesce(F.nullif("parts.genre", F.lit("")), guessed_genre("rest")).alias("genre"), F.col("parts.details").alias("details"),
        F.coalesce(F.nullif("stated", F.lit("")), network_list("joined")).alias("availability"), F.coalesce(pictured, classify.tv_release_type("joined")).alias("release_type"),
    ).withColumn("content_format", classify.tv_content_format("release_type", F.concat_ws(" ", "joined", "availability")))
    return _finish(_with_matrix(records, "joined"), page, None, "tv", TV_COLUMNS)


def either(first: DataFrame, second: DataFrame, page: str) -> DataFrame:
    """The first reading's records of a page where it has any, else the second's."""
    return first.unionByName(second.join(first.select(page).distinct(), page, "left_anti"))


def tv_calendar(rows: DataFrame, as_of: dt.date, page: str = "page_id") -> DataFrame:
    return either(tv_tables(rows, as_of, page), tv_items(rows, as_of, page), page)


def movie_calendar(rows: DataFrame, as_of: dt.date, page: str = "page_id") -> DataFrame:
    """Records of a film calendar: a score and title, the studio in parentheses, then genre, availability and details."""
    lines = dated(rows.filter("kind = 'text' and line not like '* * *%'"), page, as_of).filter(~is_noise("line"))
    t, low = F.col("line"), F.lower("line")
    only = (F.array_join(availability_values(t), "; ") == t) | F.upper(t).isin(UPPER)
    barred = t.isin("-", "–") | low.startswith("trailer") | t.startswith("(") | only | is_movie_genre(movie_genre(t))
    strong = ~barred & (t.rlike(r"(?i)^(?:\d{2,3}|tbd)(?:\s+|$)") | F.contains(low, F.lit("trailer")))
    items = _items(lines, page, ~barred & ~low.rlike("looking for previous|release calendar"), strong)
    alone = F.get("lines", F.lit(0)).rlike(SCORED + "$") & (F.size("lines") > 1)
    rest = F.when(alone, _from("lines", 3)).otherwise(_from("lines", 2))
    split = items.select(page, "pos", F.col("day").alias("release_date"), squash(F.when(alone, F.concat_ws(" ", F.get("lines", F.lit(0)), F.get("lines", F.lit(1)))).otherwise(F.get("lines", F.lit(0)))).alias("head"),
                         F.filter(rest, lambda x: ~x.isin("-", "–") & ~F.lower(x).startswith("trailer")).alias("rest"))
    is_studio = lambda x: x.rlike(r"^\([^)]+\)$") & ~F.lower(x).rlike(r"^\((?:also|wide|vod)|more cities|:")
    at = F.array_position(F.transform("rest", is_studio), True)
    told = split.select(page, "pos", "release_date", "head", F.when(at > 0, squash(F.regexp_replace(F.get("rest", (at - 1).cast("int")), r"[()]", ""))).otherwise("").alias("studio"), F.filter("rest", lambda x, i: i != at - 1).alias("told"))
    title = F.regexp_replace("head", SCORED + r"\s+", "")
    for pattern in (r"(?i)\s+[-–]\s+Trailer\d?.*$", r"(?i)\bTrailer\d?\b.*$", r"\s+\[[^\]]+\]\s*$"):
        title = F.regexp_replace(title, pattern, "")
    joined = squash(F.array_join("told", " "))
    base = told.select(page, "pos", "release_date", "studio", clean_title(title).alias("title"), score("head").alias("score"), joined.alias("joined"),
                       F.coalesce(movie_genre(F.get("told", F.lit(0))), F.lit("")).alias("genre"), availability_values(joined).alias("values"))
    bare = F.col("joined")
    bare = F.when(F.col("genre") != "", _without(bare, F.col("genre"))).otherwise(bare)
    for pattern in AVAILABILITY:
        bare = F.regexp_replace(bare, f"(?i){pattern}", "")
    records = base.select(page, "pos", "release_date", "studio", "title", "score", "genre", F.array_join("values", "; ").alias("availability"), squash(F.trim(bare, F.lit(" -;/"))).alias("details"))
    records = records.withColumns({"content_format": classify.movie_content_format("availability"), "release_type": classify.movie_release_type("availability", "details")})
    return _finish(records, page, anchors(rows, page, MOVIE_PAGE), "movie", MOVIE_COLUMNS)


def _game_records(df: DataFrame, page: str, as_of: dt.date) -> DataFrame:
    """Records of (title, platforms, detail `genre - date more`, score)."""
    part = lambda i: squash(F.regexp_extract("detail", GAME_DATE, i))
    extra = squash(F.ltrim(part(3), F.lit(" -")))
    day = dates.article_date(F.initcap(F.replace(part(2), F.lit("."), F.lit(""))), as_of.year, as_of)
    return df.filter(F.col("detail").rlike(GAME_DATE)).select(
        page, "pos", "title", "score", "source_url", F.col("platforms").alias("availability"), part(1).alias("genre"), extra.alias("details"), day.alias("release_date"),
        F.when(F.lower(F.concat_ws(" ", part(1), extra)).contains("expansion"), "Expansion").otherwise("Game").alias("release_type"), F.lit("Video Game").alias("content_format"),
    )


def game_calendar(rows: DataFrame, as_of: dt.date, page: str = "page_id") -> DataFrame:
    """Records of a game calendar: tables where there are any, else a line of title and platforms and the line after it."""
    codes = "|".join(classify.PLATFORMS)
    cell = F.col("cells")
    link, whole = _title_link(F.get(cell, F.lit(1))), squash(F.get(cell, F.lit(1))["text"])
    named = F.coalesce(clean_title(link["label"]), classify.split_platforms(whole)["title"])
    heads = rf"^((?:(?:{codes})\*?\s+)*)"
    cut = rows.filter("kind = 'row' and size(cells) >= 2").select(page, "pos", named.alias("title"), whole.alias("whole"), score(squash(F.get(cell, F.lit(0))["text"])).alias("score"),
                                                                   F.when(link.isNull(), "").otherwise(absolute(link["href"], GAME_PAGE)).alias("source_url"))
    cut = cut.withColumn("rest", _without(F.col("whole"), F.col("title")))
    of_tables = _game_records(cut.select("*", F.trim(F.regexp_extract("rest", heads, 1)).alias("platforms"), F.regexp_replace("rest", heads, "").alias("detail")), page, as_of)
    lines = rows.filter("kind = 'text' and line not like '* * *%'").filter(~is_noise("line")).select(page, "pos", "line")
    pairs = lines.withColumn("detail", F.lead("line").over(Window.partitionBy(page).orderBy("pos")))
    item = ~F.col("line").startswith("#") & ~F.contains("line", F.lit(" - ")) & F.col("line").rlike(rf"(?:^|\s)(?:{codes})\*?(?:\s|$)")
    split = pairs.filter(item).select(page, "pos", score("line").alias("score"), "detail", classify.split_platforms(F.trim(F.regexp_replace("line", SCORED + r"\s+", ""))).alias("s"))
    of_lines = _game_records(split.select(page, "pos", "score", "detail", clean_title("s.title").alias("title"), F.col("s.platforms").alias("platforms"), F.lit("").alias("source_url")), page, as_of)
    return either(_finish(of_tables, page, None, "game", GAME_COLUMNS), _finish(of_lines.drop("source_url"), page, anchors(rows, page, GAME_PAGE), "game", GAME_COLUMNS), page)
