"""Faceted search over release lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def facet_filter(df: DataFrame, search: str = "", search_in: list[str] = (), member_of: dict[str, str] | None = None, equal: dict[str, str] | None = None) -> DataFrame:
    """Rows that hold the search text in the joined columns, have the value in the array columns, and equal the others; blank facets are no condition."""
    if search.strip():
        df = df.filter(F.contains(F.lower(F.concat_ws(" ", *search_in)), F.lit(search.strip().lower())))
    for column, value in (member_of or {}).items():
        if value:
            df = df.filter(F.array_contains(column, value))
    for column, value in (equal or {}).items():
        if value:
            df = df.filter(F.col(column) == value)
    return df


def facet_values(df: DataFrame, column: str, name: str = "value") -> DataFrame:
    """Distinct non-blank values of a column, arrays flattened."""
    values = F.explode(column) if dict(df.dtypes)[column].startswith("array") else F.col(column)
    return df.select(values.alias(name)).filter(F.coalesce(F.col(name), F.lit("")) != "").distinct()


def facet_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of each value of each column in one pass (grouping sets)."""
    facet = F.lit(None).cast("string")
    for c in columns:
        facet = F.when(F.grouping(c) == 0, c).otherwise(facet)
    counted = df.groupingSets([[F.col(c)] for c in columns], *map(F.col, columns)).agg(facet.alias("facet"), F.count("*").alias("n"))
    return counted.select("facet", F.coalesce(*(F.col(c).cast("string") for c in columns), F.lit("")).alias("value"), "n")


def with_display_order(df: DataFrame, date: str, title: str, ordinal: str) -> DataFrame:
    """Sorted by date, lower-cased title and the original place."""
    return df.orderBy(date, F.lower(F.col(title)), ordinal)
