"""Seasons told in text: episode dates, stated ends, episode counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cinelake.functions.text import NUMBER_WORDS, col, let, number_word

# Fixed values.
MONTHS = "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
ENDINGS = "through|thru|until|concludes on|finale on|ending on"
LOOK_BACK = 16


def _from_start(said: Column, start: Column) -> Column:
    """The day of `Mon d[, yyyy]`, in the start's year where none is said, and a year later if that is before the start."""
    parts = F.regexp_replace(F.regexp_replace(said, r"[.,]", " "), r"\s+", " ")
    month, day = F.initcap(F.substring(F.substring_index(parts, " ", 1), 1, 3)), F.regexp_extract(parts, r"^\S+ (\d{1,2})", 1)
    year = F.coalesce(F.nullif(F.regexp_extract(parts, r"(\d{4})$", 1), F.lit("")), F.year(start).cast("string"))
    found = F.try_to_date(F.concat_ws(" ", month, day, year), "MMM d yyyy")
    return F.when(found < start, F.add_months(found, 12)).otherwise(found)


def episode_dates(c: Column | str, start: Column | str) -> Column:
    """Days that a text names, none before the season's start."""
    said = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(rf"(?i)\b((?:{MONTHS})\.?\s+\d{{1,2}}(?:,\s*\d{{4}})?)"), F.lit(1))
    return F.array_compact(F.transform(said, lambda s: _from_start(s, col(start))))


def stated_end(c: Column | str, start: Column | str) -> Column:
    """The day after `through`, `until` and the like; null if there is none."""
    said = F.regexp_extract(F.coalesce(col(c), F.lit("")), rf"(?i)\b(?:{ENDINGS})\s+([A-Z]+\.?\s+\d{{1,2}}(?:,\s*\d{{4}})?)", 1)
    return F.when(said != "", _from_start(said, col(start)))


def told_episodes(c: Column | str, season: Column | str) -> Column:
    """The most that `N episodes` says anywhere in a text, or `N S3 episodes` of the season itself; 0 if nothing does."""
    text = F.coalesce(col(c), F.lit(""))
    words = "|".join(NUMBER_WORDS)
    plain = F.regexp_extract_all(text, F.lit(rf"(?i)\b(\d{{1,3}}|{words})[-\s]+episodes?\b"), F.lit(1))
    near = rf"(?i)(\d{{1,3}}|{'|'.join(NUMBER_WORDS[:10])})\s+(?=S0*(\d+)\s+episodes?\b)"
    counts, seasons = F.regexp_extract_all(text, F.lit(near), F.lit(1)), F.regexp_extract_all(text, F.lit(near), F.lit(2))
    own = F.filter(F.arrays_zip(counts.alias("n"), seasons.alias("s")), lambda x: x["s"].cast("int") == col(season).cast("int"))
    every = F.concat(F.transform(plain, number_word), F.transform(own, lambda x: number_word(x["n"])))
    return F.coalesce(F.array_max(every), F.lit(0))


def page_episodes(c: Column | str, season: Column | str) -> Column:
    """Of an episode page's text the largest episode number of the season, or count of episodes below 100: a maximum, not a number of different ones."""
    text = F.coalesce(col(c), F.lit(""))
    wanted = col(season).cast("int")
    numbered = []
    for pattern in (r"(?i)\bS0*(\d+)\.E(\d+)\b", r"(?i)\bEpisode\s+#0*(\d+)\.(\d+)\b"):
        pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("s"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("e"))
        numbered.append(F.transform(F.filter(pairs, lambda x: x["s"].cast("int") == wanted), lambda x: x["e"].cast("int")))
    counts = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\b(\d{1,3})\s+episodes?\b"), F.lit(1)), lambda x: x.cast("int")), lambda n: (n > 0) & (n < 100))
    return F.greatest(F.coalesce(F.array_max(F.concat(*numbered, counts)), F.lit(0)), F.lit(0))


def season_context(c: Column | str) -> Column:
    """(first, last, episodes) of a season page: the last day told for each episode number counts."""
    pattern = rf"(?i)\bEpisode\s+(\d+)\b.{{0,200}}?\b((?:{MONTHS})\.?\s+\d{{1,2}},\s*\d{{4}})"
    text = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\s+", " ")
    numbers, said = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    day = lambda s: F.try_to_date(F.concat_ws(" ", F.initcap(F.substring(s, 1, 3)), F.regexp_extract(s, r"(\d{1,2}),", 1), F.regexp_extract(s, r"(\d{4})$", 1)), "MMM d yyyy")
    told = F.filter(F.transform(F.arrays_zip(numbers.alias("n"), said.alias("s")), lambda x: F.struct(x["n"].cast("int").alias("n"), day(x["s"]).alias("day"))), lambda x: x["day"].isNotNull())
    later = lambda order, i: F.slice(order, i + 2, F.size(order))
    last_days = lambda told: let(told["n"], lambda order: F.transform(F.filter(told, lambda x, i: F.array_position(later(order, i), x["n"]) == 0), lambda x: x["day"]))
    return let(let(told, last_days), lambda days: F.struct(F.array_min(days).alias("first"), F.array_max(days).alias("last"), F.size(days).alias("episodes")))


def merged_context(a: Column, b: Column) -> Column:
    """One season context out of two: the first's days where it has them, the larger count."""
    return F.struct(F.coalesce(a["first"], b["first"]).alias("first"), F.coalesce(a["last"], b["last"]).alias("last"), F.greatest(a["episodes"], b["episodes"]).alias("episodes"))
