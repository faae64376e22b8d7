"""Joins on days that are near each other or lie in ranges: days are dealt into bins, bins meet in an equi-join, the exact distance is checked after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinelake.functions.text import col

#: Days of a bin where ranges meet rows; a range is as many rows as it touches bins.
RANGE_BIN = 15


def day_bin(day: Column | str, width: int) -> Column:
    return F.floor(F.datediff(col(day), F.lit("1970-01-01").cast("date")) / width).cast("int")


def near_bins(day: Column | str, within: int) -> Column:
    """The bins, of within + 1 days, that can hold a day at most `within` days away; null without a day."""
    bin_ = day_bin(day, within + 1)
    return F.when(bin_.isNotNull(), F.array(bin_ - 1, bin_, bin_ + 1))


def near_days(left: DataFrame, right: DataFrame, left_day: str, right_day: str, within: int, on: list[str] | None = None) -> DataFrame:
    """Pairs of rows at most `within` days apart, and equal in `on`, with `days_apart`; rows without a day meet none.

    Every left row is three, every right row one; a pair meets in one bin only, so nothing is found
    twice. Columns of the two sides must differ but for `on`.
    """
    keys = [*(on or []), "__bin"]
    met = left.withColumn("__bin", F.explode(near_bins(left_day, within))).join(right.withColumn("__bin", day_bin(right_day, within + 1)), keys)
    return met.withColumn("days_apart", F.abs(F.datediff(left_day, right_day))).filter(F.col("days_apart") <= within).drop("__bin")


def in_ranges(rows: DataFrame, ranges: DataFrame, day: str, start: str, end: str, on: list[str] | None = None, width: int = RANGE_BIN) -> DataFrame:
    """Rows with each range (both ends included) that their day lies in. Ranges without an end, or with one before the start, hold no day."""
    keys = [*(on or []), "__bin"]
    real = ranges.filter(F.col(start) <= F.col(end))
    binned = real.withColumn("__bin", F.explode(F.sequence(day_bin(start, width), day_bin(end, width))))
    met = rows.withColumn("__bin", day_bin(day, width)).join(binned, keys)
    return met.filter(F.col(day).between(F.col(start), F.col(end))).drop("__bin")


def range_sums(rows: DataFrame, ranges: DataFrame, day: str, start: str, end: str, by: list[str], sums: dict[str, Column], width: int = RANGE_BIN) -> DataFrame:
    """Each range with each value of `by` among the rows that its days hold, and the sums of numbers over them; ranges without rows go.

    Rows are added up by day and equal ranges are met once before they meet: the pairs grow with the
    calendar's days and the different ranges, not with the rows in each range.
    """
    daily = rows.groupBy(*by, day).agg(*(F.sum(value).alias(name) for name, value in sums.items()))
    spans = ranges.select(start, end).distinct()
    told = in_ranges(daily, spans, day, start, end, width=width).groupBy(start, end, *by).agg(*(F.sum(name).alias(name) for name in sums))
    return ranges.join(told, [start, end])
