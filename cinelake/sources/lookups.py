"""Landed answers of catalogue services (JSON) to candidate rows. Absent and null members read as empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinelake.functions import dates
from cinelake.functions.text import col, squash, title_key

# Fixed values.
THEATRICAL = (2, 3, 4, 5, 6)
ARTICLE = "https://en.wikipedia.org/wiki/"
ENTITY = "https://www.wikidata.org/wiki/"

DETAILS = """struct<id:string,title:string,name:string,release_date:string,first_air_date:string,last_air_date:string,number_of_seasons:int,genres:array<struct<name:string>>,
production_companies:array<struct<name:string>>,networks:array<struct<name:string>>,external_ids:struct<imdb_id:string>,
release_dates:struct<results:array<struct<iso_3166_1:string,release_dates:array<struct<type:int,release_date:string>>>>>,
seasons:array<struct<season_number:int,episode_count:int,air_date:string>>,last_episode_to_air:struct<season_number:int,air_date:string>>"""
CLAIM = "array<struct<mainsnak:struct<datavalue:struct<value:string>>>>"
ENTITIES = f"""map<string,struct<labels:struct<en:struct<value:string>>,descriptions:struct<en:struct<value:string>>,sitelinks:struct<enwiki:struct<title:string>>,
claims:map<string,{CLAIM}>>>"""
SEARCH = "struct<Response:string,imdbID:string,Title:string,Year:string,totalSeasons:string,Search:array<struct<imdbID:string,Title:string,Year:string,Type:string>>>"
VIDEOS = "struct<items:array<struct<id:struct<videoId:string>,snippet:struct<title:string,description:string,publishedAt:string,channelId:string,channelTitle:string>>>>"
CHANNELS = "struct<items:array<struct<id:string,snippet:struct<title:string,customUrl:string>,statistics:struct<subscriberCount:string>>>>"


def _text(c: Column) -> Column:
    return F.coalesce(squash(c), F.lit(""))


def _names(c: Column) -> Column:
    return F.filter(F.coalesce(F.transform(c, lambda x: F.coalesce(x["name"], F.lit(""))), F.array().cast("array<string>")), lambda n: n != "")


def title_candidates(answers: DataFrame, kind: Column | str = "kind", body: str = "body") -> DataFrame:
    """Adds name, release_date, release_precision, genres, network, imdb_id and source to details answers; `kind` is movie or tv.

    A film's day is its first of a theatrical to physical release in the US, else the stated one;
    its network is its companies. Broken answers give empty candidates.
    """
    d = F.col("__d")
    us = F.get(F.filter(d["release_dates"]["results"], lambda r: r["iso_3166_1"] == "US"), F.lit(0))["release_dates"]
    shown = F.transform(F.filter(us, lambda r: r["type"].isin(*THEATRICAL)), lambda r: dates.parse_date(F.substring(r["release_date"], 1, 10)))
    film = col(kind) == "movie"
    day = F.when(film, F.coalesce(F.array_min(F.array_compact(shown)).cast("string"), d["release_date"])).otherwise(d["first_air_date"])
    return answers.withColumn("__d", F.from_json(body, DETAILS)).withColumns({
        "name": _text(F.coalesce(d["title"], d["name"])), "release_date": _text(day), "release_precision": F.when(_text(day) != "", "date").otherwise(""), "genres": _names(d["genres"]),
        "network": F.array_join(F.when(film, _names(d["production_companies"])).otherwise(_names(d["networks"])), "; "), "imdb_id": _text(d["external_ids"]["imdb_id"]), "source": F.lit("TMDB"),
    }).drop("__d")


def season_fields(answers: DataFrame, preferred: Column | str, body: str = "body") -> DataFrame:
    """Adds season, episodes, season_date and last_date of the preferred season if an answer has it, else of its latest; the last day only if it is of that season."""
    d, wanted = F.col("__d"), col(preferred).cast("int")
    real = F.filter(F.coalesce(d["seasons"], F.array().cast("array<struct<season_number:int,episode_count:int,air_date:string>>")), lambda s: s["season_number"] >= 1)
    latest = F.array_max(F.transform(real, lambda s: s["season_number"]))
    own = F.filter(real, lambda s: s["season_number"] == wanted)
    chosen = F.coalesce(F.get(own, F.lit(0)), F.get(F.filter(real, lambda s: s["season_number"] == latest), F.lit(0)))
    season = F.coalesce(chosen["season_number"], F.nullif(d["number_of_seasons"], F.lit(0)))
    last = F.coalesce(d["last_episode_to_air"]["air_date"], d["last_air_date"])
    same = d["last_episode_to_air"]["season_number"].isNull() | (d["last_episode_to_air"]["season_number"] == season)
    return answers.withColumn("__d", F.from_json(body, DETAILS)).withColumns({
        "season": season, "episodes": F.nullif(chosen["episode_count"], F.lit(0)), "season_date": dates.parse_date(chosen["air_date"]), "last_date": F.when(same, dates.parse_date(last)),
    }).drop("__d")


def search_candidates(answers: DataFrame, body: str = "body") -> DataFrame:
    """A row for each title of a search answer, or for the one title that an answer is about: place, imdb_id, name, year, seasons."""
    d = F.from_json(body, SEARCH)
    one = F.array(F.struct(d["imdbID"].alias("imdbID"), d["Title"].alias("Title"), d["Year"].alias("Year"), F.lit(None).cast("string").alias("Type")))
    listed = F.when(d["Search"].isNotNull(), d["Search"]).when(d["imdbID"].isNotNull(), one)
    flat = answers.withColumn("__ok", F.lower(d["Response"]) != "false").withColumn("__seasons", d["totalSeasons"].try_cast("int")).filter("__ok").select("*", F.posexplode(listed).alias("place", "__t"))
    return flat.select(*answers.columns, "place", F.col("__t.imdbID").alias("imdb_id"), _text(F.col("__t.Title")).alias("name"), F.regexp_extract(_text(F.col("__t.Year")), r"^\d{4}", 0).alias("year"), F.col("__seasons").alias("seasons"))


def entities(answers: DataFrame, body: str = "body") -> DataFrame:
    """A row for each entity of an answer: qid, label, description, article and claims (property to texts of its values)."""
    flat = answers.select(*[c for c in answers.columns if c != body], F.explode(F.from_json(F.get_json_object(body, "$.entities"), ENTITIES)).alias("qid", "e"))
    page = F.col("e.sitelinks.enwiki.title")
    article = F.when(_text(page) == "", "").otherwise(F.concat(F.lit(ARTICLE), F.replace(F.replace(F.url_encode(F.replace(page, F.lit(" "), F.lit("_"))), F.lit("%28"), F.lit("(")), F.lit("%29"), F.lit(")"))))
    values = F.transform_values("e.claims", lambda _, v: F.array_compact(F.transform(v, lambda x: x["mainsnak"]["datavalue"]["value"])))
    return flat.select(
        *[c for c in answers.columns if c != body], "qid", F.concat(F.lit(ENTITY), "qid").alias("entity_url"), _text(F.col("e.labels.en.value")).alias("label"),
        _text(F.col("e.descriptions.en.value")).alias("description"), article.alias("article"), values.alias("claims"),
    )


def claim_ids(claims: Column | str, prop: str) -> Column:
    """Items that a property points at."""
    ids = F.transform(F.coalesce(col(claims)[prop], F.array().cast("array<string>")), lambda v: F.coalesce(F.get_json_object(v, "$.id"), F.lit("")))
    return F.filter(ids, lambda x: x != "")


def claim_time(claims: Column | str, prop: str) -> Column:
    """The day of a property's first time, without sign and clock; empty if there is none."""
    times = F.filter(F.transform(col(claims)[prop], lambda v: F.get_json_object(v, "$.time")), lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(F.substring_index(F.ltrim(F.get(times, F.lit(0)), F.lit("+")), "T", 1), F.lit(""))


def claim_text(claims: Column | str, prop: str) -> Column:
    """The first value of a property that is plain text (an address, a code)."""
    return F.coalesce(F.get(F.filter(F.transform(col(claims)[prop], squash), lambda x: (x != "") & ~x.startswith("{")), F.lit(0)), F.lit(""))


def with_labels(found: DataFrame, labels: DataFrame, properties: dict[str, str], key: str = "qid") -> DataFrame:
    """Adds for each property a column of the labels of its items, joined by `; ` in their order; `labels` are (qid, label) rows, unknown items are skipped."""
    flat = found.select(key, F.explode(F.array(*(F.struct(F.lit(n).alias("name"), claim_ids("claims", p).alias("ids")) for n, p in properties.items()))).alias("p")).select(key, "p.name", F.posexplode("p.ids").alias("place", "item"))
    named = flat.join(labels.select(F.col("qid").alias("item"), F.col("label").alias("text")), "item").filter("text <> ''")
    parts = named.groupBy(key).pivot("name", list(properties)).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "; "))
    return found.join(parts, key, "left").na.fill("", list(properties))


def videos(answers: DataFrame, body: str = "body", most: int = 10) -> DataFrame:
    """A row for each video of a search answer, in its order."""
    flat = answers.select(*[c for c in answers.columns if c != body], F.posexplode(F.slice(F.from_json(body, VIDEOS)["items"], 1, most)).alias("place", "v"))
    s = lambda n: _text(F.col(f"v.snippet.{n}"))
    return flat.select(*[c for c in answers.columns if c != body], "place", F.col("v.id.videoId").alias("video_id"), s("title").alias("title"), s("description").alias("description"),
                       F.to_date(F.substring(s("publishedAt"), 1, 10)).alias("published"), s("channelId").alias("channel_id"), s("channelTitle").alias("channel")).filter("video_id is not null")


def channels(answers: DataFrame, body: str = "body") -> DataFrame:
    """(…, place, channel_id, title, custom_url, subscribers) of the channels of an answer."""
    rest = [c for c in answers.columns if c != body]
    flat = answers.select(*rest, F.posexplode(F.from_json(body, CHANNELS)["items"]).alias("place", "c"))
    return flat.select(*rest, "place", _text(F.col("c.id")).alias("channel_id"), _text(F.col("c.snippet.title")).alias("title"), _text(F.col("c.snippet.customUrl")).alias("custom_url"), F.col("c.statistics.subscriberCount").try_cast("long").alias("subscribers"))


def channel_token(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(squash(c)), "[^a-z0-9]+", "")


def best_channel(found: DataFrame, wanted: str, by: list[str]) -> DataFrame:
    """Of each probe's channels the first whose title or address is what was asked for, else the first."""
    fits = (channel_token(wanted) != "") & ((channel_token("title") == channel_token(wanted)) | (channel_token("custom_url") == channel_token(wanted)))
    rest = [c for c in found.columns if c not in by]
    return found.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(~fits, "place")).alias("c")).select(*by, "c.*")


def ld_items(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, place, item): each JSON-LD object of a page, those of lists and graphs too, as JSON text."""
    scripts = F.regexp_extract_all(F.coalesce(col(html_col), F.lit("")), F.lit(r'(?is)<script[^>]*type=["\']application/ld\+json["\'][^>]*>(.*?)</script>'), F.lit(1))
    flat = pages.select(id_col, F.posexplode(scripts).alias("script", "raw")).withColumn("raw", F.trim("raw"))
    listed = F.when(F.col("raw").startswith("["), F.from_json("raw", "array<string>")).otherwise(F.concat(F.array("raw"), F.coalesce(F.from_json(F.get_json_object("raw", "$['@graph']"), "array<string>"), F.array().cast("array<string>"))))
    return flat.select(id_col, "script", F.posexplode(listed).alias("n", "item")).filter(F.col("item").startswith("{")).select(id_col, F.struct("script", "n").alias("place"), "item")


def ld_title(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, name, release_date, genres): of each page's JSON-LD the first film, series or episode, else the first with a day or genre; earlier scripts first."""
    item = lambda p: F.get_json_object("item", p)
    rank = F.when(item("$['@type']").isin("Movie", "TVSeries", "TVEpisode"), 0).when(item("$.datePublished").isNotNull() | item("$.genre").isNotNull(), 1)
    best = ld_items(pages, id_col, html_col).withColumn("rank", rank).filter("rank is not null").groupBy(id_col).agg(F.min_by("item", F.struct("place.script", "rank", "place.n")).alias("item"))
    return best.select(id_col, _text(item("$.name")).alias("name"), dates.parse_date(item("$.datePublished")).alias("release_date"), ld_texts(item("$.genre")).alias("genres"))


def ld_texts(c: Column) -> Column:
    """Texts of a JSON-LD member that may be a text, an object or a list of either; each key once."""
    listed = F.when(F.trim(c).startswith("["), F.from_json(c, "array<string>")).otherwise(F.array(c))
    of = lambda x: F.when(F.trim(x).startswith("{"), F.coalesce(F.get_json_object(x, "$.name"), F.get_json_object(x, "$.url"), F.get_json_object(x, "$['@id']"))).otherwise(x)
    # a lambda's variable is computed once, what it would stand for again for each element
    keyed = F.transform(F.transform(listed, lambda x: squash(of(x))), lambda v: F.struct(v.alias("v"), title_key(v).alias("k")))
    firsts = lambda all_: F.filter(all_, lambda p, i: F.array_position(all_["k"], p["k"]) == i + 1)
    once = F.get(F.transform(F.array(F.filter(keyed, lambda p: p["k"] != "")), firsts), F.lit(0))
    return F.coalesce(once["v"], F.array().cast("array<string>"))
