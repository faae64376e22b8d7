"""Titles that may belong together, found by equi-joins whose union holds every pair that a score can accept."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinelake.functions import scoring
from cinelake.functions.text import col, title_key, tokens
from cinelake.operators import bands

# What two titles score at most by shared words, what equal days, near days and a shared word of the network add.
WORDS_MOST, SAME_DAY, NEAR_DAYS, NEAR, NETWORK = 40, 35, 14, 15, 25
#: Sizes of the pieces under which a contained title is looked up, by the largest that fits: of short ones there are few, so that many titles have each.
GRAM_SIZES = (3, 6, 12)
_GRAM = GRAM_SIZES[0]


def grams(key: Column, size: int = _GRAM) -> Column:
    """The distinct pieces of `size` characters; none of a shorter key."""
    n = F.length(key)
    return F.array_distinct(F.when(n >= size, F.transform(F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1))), lambda i: F.substring(key, i, F.lit(size)))).otherwise(F.array().cast("array<string>")))


def all_grams(key: Column) -> Column:
    """The pieces of all sizes: whatever a key holds is found under its pieces of the largest size that fits it."""
    return F.concat(*(grams(key, size) for size in GRAM_SIZES))


def rare_pieces(keys: DataFrame) -> DataFrame:
    """(key, words, gram) of distinct keys: its words, those that the fewest keys have first, and the rarest of its pieces of the largest size."""
    piece = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("piece")))
    every = keys.select("key", F.explode(F.concat(piece("word", tokens(F.col("key"))), piece("gram", all_grams(F.col("key"))))).alias("p")).select("key", "p.*")
    size = F.lit(_GRAM)
    for s in GRAM_SIZES[1:]:
        size = F.when(F.length("key") >= s, s).otherwise(size)
    counted = every.join(every.groupBy("kind", "piece").agg(F.count("*").alias("n")), ["kind", "piece"])
    listed = counted.groupBy("key").agg(F.array_sort(F.collect_list(F.when(F.col("kind") == "word", F.struct("n", "piece")))).alias("w"), F.min(F.when((F.col("kind") == "gram") & (F.length("piece") == size), F.struct("n", "piece"))).alias("g"))
    return listed.select("key", F.col("w.piece").alias("words"), F.col("g.piece").alias("gram"))


def sharing(words: Column, share: float) -> Column:
    """So many of the rarest words that keys which share the part `share` of the larger one's words have one of them in common."""
    n = F.size(words)
    return F.slice(words, 1, F.greatest(n - F.ceil(n * share - 1e-9) + 1, F.lit(1)).cast("int"))


def routes(least: int, dated: bool, networked: bool) -> list[tuple[int, int, int]]:
    """(day bonus, network bonus, what the words must add) of all ways to reach `least` without one title holding the other."""
    found = [(d, n, least - d - n) for d in ((0, NEAR, SAME_DAY) if dated else (0,)) for n in ((0, NETWORK) if networked else (0,))]
    if any(not d and need <= 0 for d, _, need in found):
        raise ValueError("a limit that is reached without a day and without a word accepts every pair of a network")
    return [r for r in found if r[2] <= WORDS_MOST]


def _meeting_points(probe: bool, least: int, dated: bool, networked: bool) -> Column:
    """Hashes under which a unit with `words` and `gram` meets all others that it may reach `least` with; a hash that others share by chance only costs a comparison."""
    none, points = F.array(F.lit(0)), []
    for i, (of_day, of_network, need) in enumerate(routes(least, dated, networked)):
        day = F.datediff("day", F.lit("1970-01-01").cast("date"))
        days = none if not of_day else F.array(day) if of_day == SAME_DAY else bands.near_bins("day", NEAR_DAYS) if probe else F.array(bands.day_bin("day", NEAR_DAYS + 1))
        nets = tokens(title_key("network")) if of_network else F.array(F.lit(""))
        words = sharing(F.col("words"), need / WORDS_MOST) if need > 0 else F.array(F.lit(""))
        met = F.flatten(F.transform(days, lambda d: F.flatten(F.transform(nets, lambda n: F.transform(words, lambda w: F.xxhash64(F.lit(i), d, n, w))))))  # noqa: B023
        points.append(F.when(F.col("day").isNotNull() | F.lit(not of_day), met))
    own, held = F.array(F.col("gram")), all_grams(F.col("key"))
    in_row, in_probe = (own, held) if probe else (held, own)
    for name, values in (("probe in row", in_row), ("row in probe", in_probe)):
        points.append(F.transform(F.filter(values, lambda v: v.isNotNull()), lambda v: F.xxhash64(F.lit(name), v)))  # noqa: B023
    empty = F.array().cast("array<bigint>")
    return F.array_distinct(F.concat(*(F.coalesce(p, empty) for p in points)))


def candidate_pairs(probes: DataFrame, rows: DataFrame, least: int, dated: bool = True, networked: bool = True) -> DataFrame:
    """Pairs (p, r), structs of a distinct probe and row (key, day, network), with every pair whose title score and bonuses reach `least`; some come more than once.

    A title scores 45 and more only if one key holds the other: then it holds the other's rarest
    piece of three, six or twelve letters. Else it has up to 40 by the share of common words, and must make up the rest by the
    same day, a near day or a word of the network: for each of these ways the two meet under that
    and one of the rarest words which the needed share must have in common, or without a word where
    none is needed. All meeting points are hashes of one equi-join. Keys of one or two letters have
    no such piece; there are some 1,400 such title keys at most, so they are broadcast.
    """
    units = lambda d: d.select(F.struct("key", "day", "network").alias("u"), "key", "day", "network").distinct()
    ps, rs = units(probes), units(rows)
    pieces = rare_pieces(ps.select("key").unionByName(rs.select("key")).distinct())
    at = lambda d, name, probe: d.join(pieces, "key").select(F.col("u").alias(name), F.explode(_meeting_points(probe, least, dated, networked)).alias("at"))
    found = at(ps, "p", True).join(at(rs, "r", False), "at").select("p", "r")

    def short(inner: DataFrame, outer: DataFrame, i: str, o: str) -> DataFrame:
        few = inner.filter(F.length("key").between(1, _GRAM - 1)).select(F.col("u").alias(i), F.col("key").alias("piece"))
        held = outer.select(F.col("u").alias(o), F.explode(F.array_union(grams(F.col("key"), 1), grams(F.col("key"), 2))).alias("piece"))
        return held.join(F.broadcast(few.select("piece").distinct()), "piece", "left_semi").join(few, "piece").select("p", "r")

    return found.unionByName(short(ps, rs, "p", "r")).unionByName(short(rs, ps, "r", "p"))


def best_titles(
    probes: DataFrame, rows: DataFrame, least: int, tie: Column | str, keep: list[str], dated: bool = True, networked: bool = True, may: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """(key, day, network, keep, score) of each distinct probe (key, day, network) that a row reaches `least` with: the best row, ties to the smallest `tie`.

    The title scores 70, 45 or up to 40; the same day adds 35, one within two weeks 15; a common word
    of the networks 25. Equal to scoring each probe with every row, without their product: see
    candidate_pairs. `may(p, r)` excludes pairs. The arg-max combines before its shuffle.
    """
    none = {"day": F.lit(None).cast("date"), "network": F.lit("")}
    ready = lambda d: d.withColumns({c: v for c, v in none.items() if c not in d.columns}).withColumn("network", F.coalesce("network", F.lit("")))
    probes, rows = ready(probes).filter("key != ''"), ready(rows).filter("key != ''")
    units = rows.groupBy("key", "day", "network").agg(F.min_by(F.struct(*keep), F.struct(col(tie))).alias("kept"), F.min(F.struct(col(tie).alias("tie"))).alias("t"))
    pairs = candidate_pairs(probes, rows, least, dated, networked)
    p, r = F.col("p"), F.col("r")
    score = scoring.key_score(p["key"], r["key"])
    if dated:
        score = score + F.coalesce(scoring.date_bonus(p["day"], r["day"]), F.lit(0))
    if networked:
        score = score + F.when(F.arrays_overlap(tokens(title_key(p["network"])), tokens(title_key(r["network"]))), NETWORK).otherwise(0)
    scored = pairs.withColumn("score", score).filter(F.col("score") >= least)
    if may is not None:
        scored = scored.filter(may(p, r))
    met = scored.distinct().join(units.select(F.struct("key", "day", "network").alias("r"), "kept", "t"), "r")
    best = met.groupBy("p").agg(F.min_by(F.struct("kept", "score"), F.struct((-F.col("score")).alias("s"), "t")).alias("b"))
    return best.select("p.key", "p.day", "p.network", *(F.col(f"b.kept.{c}").alias(c) for c in keep), F.col("b.score").alias("score"))


def similarity_bound(a: Column, b: Column) -> Column:
    """What the matching-block similarity of two strings can be at most, times 100: twice the characters they have in common, whatever their order, by both lengths."""
    letters = lambda c: _numbered(F.array_sort(F.split(c, "")))
    common = F.size(F.array_intersect(letters(a), letters(b)))
    both = F.length(a) + F.length(b)
    return F.when(both == 0, 100.0).otherwise(200.0 * common / both)


def _numbered(letters: Column) -> Column:
    """Sorted letters, each with how many equal ones come before it, so that sets count repeats."""
    return F.transform(letters, lambda x, i: F.concat(x, (i - F.array_position(letters, x)).cast("string")))


def length_classes(length: Column, least: float, around: bool) -> Column:
    """Classes of lengths such that two strings of a similarity of `least` or more are in the same or neighbouring ones."""
    wide = math.log((200 - least) / least)
    own = F.floor(F.log(F.greatest(length, F.lit(1))) / wide * (1 - 1e-9)).cast("int")
    return F.array(own - 1, own, own + 1) if around else F.array(own)


def similar_pairs(probes: DataFrame, answers: DataFrame, least: float, on: list[str] | None = None, bonus: Callable[[], Column] | None = None, most_bonus: int = 0) -> DataFrame:
    """Pairs of strings `probe` and `answer` with `similarity` by matching blocks, times 100, and `score`, with the bonus, of at least `least`.

    Columns `on` must be equal, as with the answers to one question; else strings meet by classes of
    their lengths. What lengths and shared characters already rule out never reaches Python: the
    exact recursion runs on distinct pairs that can still make it.
    """
    on, extra = on or [], bonus() if bonus is not None else F.lit(0)
    sure = least - most_bonus
    if sure <= 0 and not on:
        raise ValueError("a limit that the bonus alone reaches accepts all pairs; say which columns are equal")
    p, a = F.col("probe"), F.col("answer")
    if on:
        met = probes.join(answers, on)
    else:
        met = probes.withColumn("__class", F.explode(length_classes(F.length(p), sure, True))).join(answers.withColumn("__class", F.explode(length_classes(F.length(a), sure, False))), "__class").drop("__class")
    short = 200.0 * F.least(F.length(p), F.length(a)) >= (F.lit(least) - extra) * (F.length(p) + F.length(a)) - 1e-6
    near = met.filter(short).filter(similarity_bound(p, a) + extra >= least - 1e-6)
    exact = near.select("probe", "answer").distinct().withColumn("similarity", scoring.sequence_ratio("probe", "answer"))
    return near.join(exact, ["probe", "answer"]).withColumn("score", F.col("similarity") + extra).filter(F.col("score") >= least)
