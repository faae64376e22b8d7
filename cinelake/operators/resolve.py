"""Entity resolution: rows meet catalogue candidates on exploded keys in an equi-join, and the best score wins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinelake.functions.text import col


def with_keys(df: DataFrame, *keys: Column | str, name: str = "key") -> DataFrame:
    """A row for each distinct, non-empty key: what an OR over key columns would need a nested-loop join for."""
    found = F.array_distinct(F.filter(F.array(*map(col, keys)), lambda k: k.isNotNull() & (k != "")))
    return df.withColumn(name, F.explode(found))


def first_alike(candidates: DataFrame, read: list[str], tie: str) -> DataFrame:
    """Of the candidates that are equal in all that a score reads (`read`, keys included) the one with the smallest `tie`: none of the others can be a best match.

    How many meet a probe is then bounded by the different values, not by the rows of the catalogue.
    """
    return candidates.groupBy(*read).agg(F.min(tie).alias(tie))


def best_match(probes: DataFrame, candidates: DataFrame, on: list[str], probe_id: list[str], score: Callable[[], Column], tie: Column | str, least: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """probe_id, the columns `keep` of the best candidate and its score, null where none matches.

    Candidates join on `on`; the highest score wins, ties go to the smallest `tie`. The arg-max is
    an aggregation with partial results, so no key's candidates gather in one place before it.
    Scores below `least` don't count. `probes` should be distinct: repeated rows are scored again.
    """
    keep = keep or [c for c in candidates.columns if c not in on]
    joined = probes.join(candidates, on, "left").withColumn("__score", score())
    reached = F.col("__score").isNotNull() & (F.lit(True) if least is None else F.col("__score") >= least)
    packed = F.struct(*(F.col(c) for c in keep), F.col("__score").alias("score"))
    # min_by over (-score, tie): the first of the best
    best = joined.groupBy(*probe_id).agg(F.min_by(F.when(reached, packed), F.when(reached, F.struct((-F.col("__score")).alias("s"), col(tie).alias("t")))).alias("__b"))
    return best.select(*probe_id, *(F.col(f"__b.{c}").alias(c) for c in keep), F.col("__b.score").alias("score"))


def lookup_with_fallback(df: DataFrame, by_first: DataFrame, by_second: DataFrame, first: str, second: str, value: str) -> DataFrame:
    """value by the first key, else by the second."""
    one = by_first.select(F.col(first), F.col(value).alias("__one"))
    two = by_second.select(F.col(second), F.col(value).alias("__two"))
    return df.join(one, first, "left").join(two, second, "left").withColumn(value, F.coalesce("__one", "__two")).drop("__one", "__two")


def enrich_codes(rows: DataFrame, codes: DataFrame, key: str, existing: Column | str, code: str = "code") -> DataFrame:
    """The code that a row has, else the one found for its key, else empty."""
    found = codes.select(F.col(key), F.col(code).alias("__found"))
    return rows.join(found, key, "left").withColumn(code, F.coalesce(F.nullif(col(existing), F.lit("")), "__found", F.lit(""))).drop("__found")


def merge_candidates(primary: Column, secondary: Column, fields: list[str], id_field: str = "imdb_id", date_field: str = "release_date", precision: str = "precision", source: str = "source") -> Column:
    """Field by field the first that is set. The id prefers the second candidate; the precision follows the date; sources are joined."""
    has = lambda c: F.nullif(c.cast("string"), F.lit("")).isNotNull()
    first = lambda a, b, f: F.when(has(a[f]), a[f]).otherwise(b[f]).alias(f)
    out = [first(primary, secondary, f) for f in fields if f not in (id_field, precision, source)]
    out.append(first(secondary, primary, id_field))
    out.append(F.when(has(primary[date_field]), primary[precision]).otherwise(secondary[precision]).alias(precision))
    out.append(F.concat_ws(" + ", F.nullif(primary[source], F.lit("")), F.nullif(secondary[source], F.lit(""))).alias(source))
    return F.struct(*out)


def code_status(provided: Column | str, matched: Column | str) -> Column:
    given, found = F.coalesce(col(provided), F.lit("")), F.coalesce(col(matched), F.lit(""))
    return F.when(found == "", "No match").when((given != "") & (given != found), "Code mismatch").otherwise("Matched")


def known_for(ids: DataFrame, titles: DataFrame, owner: str, listed: str, title_id: str, label: Column | str, separator: str = "; ") -> DataFrame:
    """Labels of the ids in an owner's list, in its order, missing ones skipped."""
    placed = ids.select(owner, F.posexplode(listed).alias("pos", title_id))
    named = placed.join(titles.select(F.col(title_id), col(label).alias("__label")), title_id)
    return named.groupBy(owner).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "__label"))), lambda s: s["__label"]), separator).alias("labels"))
