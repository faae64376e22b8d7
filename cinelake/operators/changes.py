"""Release-schedule diffs between the current rows and earlier snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinelake.functions.dates import change_label
from cinelake.functions.text import box_office_key, release_identity, squash
from cinelake.operators.resolve import with_keys


def first_entries(earlier: DataFrame) -> DataFrame:
    """(key, first, other, limited) of a history (key, o, date, scale): its first entry, the first one of another date than that, and the first Limited one.

    Whatever a film's date is now, the first entry that differs from it is one of the two. A key's
    dates are reduced to an entry each before they meet.
    """
    entry = F.struct("o", "date", "scale")
    limited = F.contains(F.lower("scale"), F.lit("limited"))
    by_date = earlier.groupBy("key", "date").agg(F.min(entry).alias("e"), F.min(F.when(limited, entry)).alias("l"))
    both = by_date.groupBy("key").agg(F.array_sort(F.collect_list("e")).alias("e"), F.min("l").alias("limited"))
    return both.select("key", F.get("e", F.lit(0)).alias("first"), F.get("e", F.lit(1)).alias("other"), "limited")


def release_changes(current: DataFrame, previous: DataFrame, order: str = "snapshot_order") -> DataFrame:
    """Moved dates and Limited to Wide expansions of current (title, url, release_date, scale; all text).

    Earlier rows count under their release identity and their title; a current row looks under its
    identity, and only if nothing is there under its title. The old date is the first differing one
    in snapshot order, of a Limited run if the film now opens wide. Rows that repeat a change go.
    A history meets the rows as one row a key.
    """
    rows = current.select(
        squash("title").alias("title"), squash("release_date").alias("new_date"), squash("scale").alias("new_scale"),
        release_identity("url", "title").alias("identity"), box_office_key("title").alias("title_id"),
    ).filter("identity != '' and new_date != ''").distinct()
    earlier = with_keys(
        previous.select(F.col(order).alias("o"), squash("release_date").alias("date"), squash("scale").alias("scale"), release_identity("url", "title").alias("k1"), box_office_key("title").alias("k2")).filter("date != '' and k1 != ''"),
        "k1", "k2",
    )
    return changed(rows, first_entries(earlier))


def changed(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """The changes of rows (title, new_date, new_scale, identity, title_id) against first_entries of their history."""
    met = rows
    for name, key in (("own", "identity"), ("named", "title_id")):
        met = met.join(entries.select(F.col("key").alias(key), F.struct("first", "other", "limited").alias(name)).filter(F.col(key) != ""), key, "left")
    return change_rows(met.withColumn("h", F.coalesce("own", "named")).drop("own", "named"))


def change_rows(seen: DataFrame) -> DataFrame:
    """The changes of rows (title, new_date, new_scale, identity) with their history h (first, other, limited)."""
    moved = F.when(F.col("h.first.date") != F.col("new_date"), F.col("h.first")).otherwise(F.col("h.other"))
    limited = F.when(F.contains(F.lower("new_scale"), F.lit("wide")), F.col("h.limited"))
    found = seen.withColumns({"moved": moved, "limited": limited}).filter("moved is not null or limited is not null")
    old = F.when(F.col("limited").isNotNull() & (F.col("limited.date") != F.col("new_date")), F.col("limited.date")).otherwise(F.col("moved.date"))
    kinds = F.concat_ws(" + ", F.when(F.col("old") != F.col("new_date"), "Date change"), F.when(F.col("limited").isNotNull(), "Limited → Wide expansion"))
    shown = found.withColumn("old", old).withColumn("change_type", kinds).select(
        "identity", "title", F.coalesce("old", "new_date").alias("old_date"), "new_date", F.coalesce("limited.scale", "moved.scale").alias("old_scale"), "new_scale", "change_type"
    )
    day = lambda c: F.try_to_date(F.col(c), "yyyy-MM-dd")
    # of rows that repeat a change the first by title, combined before the shuffle
    once = shown.groupBy("identity", "old_date", "new_date", "change_type").agg(F.min(F.struct("title", "old_scale", "new_scale")).alias("s"))
    return once.select("identity", "s.title", "old_date", "new_date", "s.old_scale", "s.new_scale", "change_type").withColumn("change", change_label(day("old_date"), day("new_date")))
