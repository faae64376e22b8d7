"""Classifiers by ordered rules, and dictionary scans over availability and genre text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cinelake.functions.dates import daypart_of_hour, hour_24
from cinelake.functions.markers import any_of, named, names_any
from cinelake.functions.text import col, title_key

# Fixed values.
NETWORKS = [
    "Prime Video", "Apple TV+", "Apple TV", "HBO Max", "Disney+", "Paramount+", "Netflix", "Peacock", "Hulu", "BritBox", "Acorn TV",
    "The Roku Channel", "Roku Channel", "Discovery+", "Screambox", "Showtime", "Lifetime", "Discovery", "Food", "TLC", "Bravo", "Oxygen",
    "History", "Nat Geo", "National Geographic", "A&E", "ABC", "CBS", "NBC", "Fox", "FOX", "PBS", "CW", "FXX", "FX", "AMC", "BBC America",
    "Freevee", "MGM+", "Starz", "BET+", "YouTube", "RENT/BUY",
]
STREAMING = [
    "Prime Video", "Apple TV+", "Apple TV", "HBO Max", "Disney+", "Paramount+", "Netflix", "Peacock", "Hulu", "BritBox", "Acorn TV",
    "The Roku Channel", "Roku Channel", "Discovery+", "Screambox", "Freevee", "MGM+", "BET+",
]
GENRES = [
    "Action", "Adventure", "Anime", "Animation", "Comedy", "Crime", "Documentary", "Drama", "Family", "Fantasy", "Food", "Foreign",
    "Game Show", "Horror", "Live Event", "Music Special", "Music", "Reality Competition", "Reality", "Rom-Com", "Sci-Fi", "Special",
    "Sports", "Thriller", "Variety",
]
PLATFORMS = ["PC", "PS5", "PS4", "XBX", "XB1", "NS2", "NS", "MOBILE", "MQ", "IOS", "ANDROID"]
INELIGIBLE = r"\$|rent/buy|movie|special"


def networks(c: Column | str) -> Column:
    """All networks that a text names, in the list's order."""
    return named(c, NETWORKS)


def is_streaming(c: Column | str) -> Column:
    return names_any(c, STREAMING)


def leading_genre(c: Column | str) -> Column:
    """The longest genre term that a text starts with; empty if none."""
    return F.regexp_extract(F.coalesce(col(c), F.lit("")), rf"(?i)^({any_of(GENRES)})(?:\b|/)", 1)


def daypart(c: Column | str) -> Column:
    """Bucket of the hour that a text names, else Streaming for a streaming brand, else empty."""
    return F.coalesce(daypart_of_hour(hour_24(c)), F.when(is_streaming(c), "Streaming"), F.lit(""))


def tv_release_type(c: Column | str) -> Column:
    text = F.lower(F.coalesce(col(c), F.lit("")))
    return (
        F.when(F.contains(text, F.lit("limited series")), "Limited Series").when(F.contains(text, F.lit("new series")), "New Series")
        .when(F.contains(text, F.lit("image: movie")) | text.rlike(r"\bmovie\b"), "Movie").when(text.rlike(r"\bspecial\b"), "Special")
        .when(text.rlike(r"\bseason\s+\d+|\bs\d+\b|\bnew season\b"), "Returning Series").when(F.contains(text, F.lit("live event")), "Live Event")
        .otherwise("TV Series")
    )


def tv_content_format(release_type: Column | str, c: Column | str) -> Column:
    kind, text = col(release_type), F.lower(F.coalesce(col(c), F.lit("")))
    return F.when(kind == "Movie", "TV Movie").when(kind == "Special", "Special").when(text.rlike("vod|rent/buy"), "VOD").when(kind == "Live Event", "Live Event").otherwise("TV Series")


def program_type(*parts: Column | str) -> Column:
    text = F.lower(F.concat_ws(" ", *map(col, parts)))
    return F.when(text.rlike("limited series|miniseries|mini series"), "Mini Series").when(F.contains(text, F.lit("tv show")), "TV Show").when(F.contains(text, F.lit("series")), "Series").otherwise("")


def language_type(*parts: Column | str) -> Column:
    return F.when(F.lower(F.concat_ws(" ", *map(col, parts))).rlike(r"\b(foreign|non-english|non english|subtitled)\b"), "Foreign").otherwise("English")


def is_series_like(release_type: Column | str, content_format: Column | str) -> Column:
    text = F.lower(F.concat_ws(" ", col(release_type), col(content_format)))
    return ~text.rlike(r"\b(movie|special|live event)\b") & text.rlike("series|tv show")


def movie_content_format(availability: Column | str) -> Column:
    text = F.lower(F.coalesce(col(availability), F.lit("")))
    return F.when(F.contains(text, F.lit("streaming")), "Streaming Movie").when(text.rlike("rent/buy|vod"), "VOD Movie").otherwise("Movie")


def movie_release_type(availability: Column | str, details: Column | str) -> Column:
    text = F.lower(F.concat_ws(" ", col(availability), col(details)))
    return F.when(F.contains(text, F.lit("rerelease")), "Rerelease").when(text.rlike("event scree(n)?ing"), "Event Screening").otherwise("Movie")


def series_eligible(*parts: Column | str) -> Column:
    """None of price, rent/buy, movie or special in the columns."""
    return ~F.lower(F.concat_ws(" ", *map(col, parts))).rlike(INELIGIBLE)


def split_platforms(c: Column | str) -> Column:
    """(title, platforms): platform codes at the end of a game's line."""
    codes = "|".join(PLATFORMS)
    tail = F.regexp_extract(F.coalesce(col(c), F.lit("")), rf"((?:\s+(?:{codes})\*?)+)\s*$", 1)
    return F.struct(F.trim(F.substring(col(c), F.lit(1), F.length(col(c)) - F.length(tail))).alias("title"), F.trim(tail).alias("platforms"))


def input_kind(kind: Column | str, code: Column | str) -> Column:
    names = ["person", "people", "name", "talent", "actor", "actress", "director", "producer"]
    return F.when(F.coalesce(col(code), F.lit("")).startswith("nm") | title_key(kind).isin(names), "name").otherwise("title")


def title_category(kind: Column | str) -> Column:
    return F.when(title_key(kind).isin("tv", "tv show", "tv shows", "tv series", "series"), "TV Shows").otherwise("Movies")


def preferred_types(category: Column | str) -> Column:
    """Catalogue types of a category, the best first."""
    key = title_key(category)
    types = lambda *names: F.array(*map(F.lit, names))
    return (
        F.when(key.isin("game", "games", "video game", "video games"), types("videoGame")).when(key.isin("tv movie", "tv movies"), types("tvMovie", "movie"))
        .when(key == "movies", types("movie", "tvMovie")).when(key == "tv shows", types("tvSeries", "tvMiniSeries"))
        .otherwise(types("movie", "tvMovie", "tvSeries", "tvMiniSeries", "videoGame"))
    )


def routed_category(tracker: Column | str, section_key: Column | str, section_title: Column | str, *row_types: Column | str) -> Column:
    """The category under which a row of a tracker's section is looked up; empty if nothing tells it."""
    who, key = title_key(tracker), title_key(section_key)
    said = F.concat_ws(" ", who, key, title_key(section_title), title_key(F.concat_ws(" ", *map(col, row_types))))
    return (
        F.when((who == "game") | (key == "games") | F.contains(said, F.lit("video game")), "Video Games").when(F.contains(said, F.lit("tv movie")), "TV Movies")
        .when(who.isin("boxoffice", "release schedule changes") | said.rlike("movie|film"), "Movies").when(said.rlike("tv|series|season|show"), "TV Shows").otherwise("")
    )
