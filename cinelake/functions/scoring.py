"""Match scores as Column expressions. The numbers are fixed values of the domain."""

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cinelake.functions.markers import holds_any
from cinelake.functions.text import col, let, title_key, tokens

# Fixed values.
STOP_WORDS = ["a", "an", "and", "the", "of", "for", "to", "in", "on", "new", "official", "trailer", "teaser"]
TRAILER_TERMS = ["official trailer", "official teaser", "teaser trailer", "final trailer", "trailer", "teaser"]
NOISE_TERMS = ["breakdown", "concept trailer", "ending explained", "fan made", "fan trailer", "first look reaction", "full movie explained", "interview", "reaction", "recap", "review", "trailer reaction"]
CHANNEL_HINTS = [
    "20th century studios", "a24", "amazon prime video", "amazon studios", "apple tv", "bbc", "bleecker street", "criterion collection",
    "dharma productions", "disney", "disney plus", "focus features", "hbo", "hulu", "ifc films", "jiohotstar", "lionsgate movies",
    "magnolia pictures", "max", "mgm", "mubi", "neon", "netflix", "netflix india", "paramount pictures", "paramount plus", "peacock",
    "prime video", "searchlight pictures", "shudder", "sony pictures", "t series", "universal pictures", "vertical", "warner bros",
    "warner bros pictures", "yrf", "zee studios",
]
MUSIC_TERMS = ["artist", "band", "composer", "dj", "duo", "group", "musician", "rapper", "singer", "songwriter", "vocalist"]


def key_score(a: Column, b: Column) -> Column:
    """Of two keys: 70 if equal, 45 if one holds the other, else up to 40 by the words they share; 0 if one is blank."""
    ta, tb = tokens(a), tokens(b)
    share = F.size(F.array_intersect(ta, tb)) / F.greatest(F.size(ta), F.size(tb), F.lit(1)) * 40
    return F.when((a == "") | (b == ""), 0).when(a == b, 70).when(F.contains(a, b) | F.contains(b, a), 45).otherwise(share.cast("int"))


def title_score(a: Column | str, b: Column | str) -> Column:
    return key_score(title_key(a), title_key(b))


def lookup_score(kind: Column, preferred: Column, primary: Column, original: Column, key: Column, year: Column, wanted_year: Column) -> Column:
    """Title lookup: 80 less the type's place among the preferred, 20 and 10 for equal names, then the year: 50 or 15 near the wanted one, without one newer is better."""
    place = F.array_position(preferred, kind)
    near = F.abs(year - wanted_year)
    return (
        F.when(place > 0, 81 - place).otherwise(0).cast("int")
        + F.when(primary == key, 20).otherwise(0)
        + F.when(original == key, 10).otherwise(0)
        + F.when(F.coalesce(year, F.lit(0)) == 0, 0)
        .when(wanted_year.isNotNull(), F.when(near == 0, 50).when(near == 1, 15).otherwise(0))
        .otherwise(F.least(year - 1900, F.lit(125)))
    )


def series_score(kind: Column, expected: Column, primary: Column, original: Column, key: Column, year: Column, wanted_year: Column) -> Column:
    near = F.abs(year - wanted_year)
    return (
        F.when(primary == key, 60).otherwise(0)
        + F.when(original == key, 50).otherwise(0)
        + F.when(kind == expected, 30).when(kind.isin("tvSeries", "tvMiniSeries"), 12).otherwise(0)
        + F.when(F.coalesce(year, F.lit(0)) == 0, 0)
        .when(wanted_year.isNotNull(), F.when(near == 0, 120).when(near == 1, 35).otherwise(-F.least(near * 3, F.lit(90))))
        .otherwise(F.least(F.greatest(year - 1900, F.lit(0)), F.lit(125)))
    )


def name_score(professions: Column, hint: Column, death_year: Column, birth_year: Column) -> Column:
    """Name lookup: 40 for a shared profession word, 10 if alive, up to 100 for a late birth."""
    shared = F.arrays_overlap(tokens(title_key(professions)), tokens(title_key(hint)))
    return (
        F.when(F.coalesce(shared, F.lit(False)), 40).otherwise(0)
        + F.when(death_year == "", 10).otherwise(0)
        + F.when(F.coalesce(birth_year, F.lit(0)) != 0, F.least(F.greatest(birth_year - 1900, F.lit(0)), F.lit(100))).otherwise(0)
    )


def date_bonus(a: Column, b: Column) -> Column:
    """35 for the same day, 15 within two weeks."""
    days = F.abs(F.datediff(a, b))
    return F.when(days == 0, 35).when(days <= 14, 15).otherwise(0)


def year_bonus(a: Column, b: Column) -> Column:
    near = F.abs(a - b)
    return F.when(near == 0, 25).when(near == 1, 10).otherwise(0)


def _important(key: Column) -> Column:
    return F.filter(F.split(key, " "), lambda x: (F.length(x) > 1) & ~x.isin(STOP_WORDS))


def trailer_score(title: Column | str, network: Column | str, year: Column | str, video_title: Column | str, description: Column | str, channel_title: Column | str, channel_text: Column | str) -> Column:
    """Score of a video as a release's official trailer, its parts, and the verdict, as one struct: keys and parts are computed once a row."""
    text = F.concat_ws(" ", col(video_title), col(description))
    keys = F.struct(
        text.alias("text"), title_key(title).alias("wanted"), title_key(video_title).alias("video"), title_key(text).alias("said"), title_key(network).alias("network"),
        title_key(F.concat_ws(" ", col(channel_title), col(channel_text))).alias("channel"), title_key(channel_title).alias("channel_name"), col(year).alias("year"),
    )
    words = lambda k: F.struct(*(k[n].alias(n) for n in ("text", "wanted", "video", "said", "channel", "channel_name", "year")), *(_important(k[n]).alias(f"{n}_words") for n in ("wanted", "video")), *(F.array_distinct(_important(k[n])).alias(f"{n}_words") for n in ("network", "channel")))
    return let(let(let(keys, words), _trailer_parts), _trailer_verdict)


def trailer_scores(title: Column | str, network: Column | str, year: Column | str, video_title: Column | str, description: Column | str, channel_title: Column | str, channel_text: Column | str) -> dict[str, Column]:
    """The members of trailer_score by name."""
    found = trailer_score(title, network, year, video_title, description, channel_title, channel_text)
    return {n: found[n] for n in ("title_part", "trailer_part", "official_part", "year_part", "penalty", "score", "verdict")}


def _trailer_parts(k: Column) -> Column:
    ratio = F.size(F.filter(k["wanted_words"], lambda w: F.array_contains(k["video_words"], w))) / F.greatest(F.size(k["wanted_words"]), F.lit(1))
    title_part = F.when((k["wanted"] == "") | (k["video"] == ""), 0).when(F.contains(k["video"], k["wanted"]), 35).otherwise((ratio * 32).cast("int"))
    trailer_part = F.when(F.contains(k["said"], F.lit("official trailer")), 25).when(holds_any(k["said"], TRAILER_TERMS), 18).otherwise(0)
    owner, shown = k["network_words"], k["channel_words"]
    overlap = F.size(F.array_intersect(owner, shown))
    network_part = F.when((F.size(owner) == 0) | (F.size(shown) == 0) | (overlap == 0), 0).when(overlap == F.size(owner), 35).otherwise(18)
    hint_part = F.when(holds_any(k["channel"], CHANNEL_HINTS) | holds_any(k["channel_name"], CHANNEL_HINTS), 30).otherwise(0)
    official_part = F.least(network_part + hint_part + F.when(F.contains(k["channel"], F.lit("official")), 12).otherwise(0), F.lit(45))
    year_part = F.when((F.coalesce(k["year"], F.lit("")) != "") & F.contains(k["text"], k["year"]), 5).otherwise(0)
    penalty = F.when(holds_any(k["said"], NOISE_TERMS), 25).otherwise(0)
    return F.struct(title_part.alias("title_part"), trailer_part.alias("trailer_part"), official_part.alias("official_part"), year_part.alias("year_part"), penalty.alias("penalty"))


def _trailer_verdict(p: Column) -> Column:
    title_part, trailer_part, official_part = p["title_part"], p["trailer_part"], p["official_part"]
    judged = lambda total: (
        F.when((total >= 75) & (title_part >= 18) & (trailer_part >= 12) & (official_part >= 25), "Confirmed")
        .when((total >= 55) & (title_part >= 18) & (trailer_part >= 10), "Review")
        .otherwise("Not found")
    )
    total = F.greatest(F.lit(0), F.least(F.lit(100), title_part + trailer_part + official_part + p["year_part"] - p["penalty"]))
    return let(total, lambda total: F.struct(*(p[n].alias(n) for n in ("title_part", "trailer_part", "official_part", "year_part", "penalty")), total.alias("score"), judged(total).alias("verdict")))


def article_score(wanted: Column, label: Column, description: Column, year: Column, category_terms: list[str], has_article: Column) -> Column:
    """An encyclopedia entry for a title: words 70 at most, 30 for the year, 20 for a word of the category, 5 for an article."""
    said = title_key(F.concat_ws(" ", label, description))
    return (
        title_score(wanted, label)
        + F.when(year.isNotNull() & F.contains(said, year.cast("string")), 30).otherwise(0)
        + F.when(holds_any(said, category_terms), 20).otherwise(0)
        + F.when(has_article, 5).otherwise(0)
    )


def artist_score(wanted: Column, label: Column, description: Column) -> Column:
    return title_score(wanted, label) + F.when(F.arrays_overlap(tokens(title_key(description)), F.array(*map(F.lit, MUSIC_TERMS))), 25).otherwise(0)


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two strings by matching blocks, times 100; no built-in has this measure. Feed it distinct pairs."""
    return pd.Series([100 * SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])
