"""Rows over as many tasks as run at once, where work is heavy for the bytes that it reads."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Tasks for each one that the session runs at a time.
SHARES = 3


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt over all cores, by columns if any are given. Files and adaptive shuffles are cut by bytes: a table of a few megabytes is one task, whatever each row costs."""
    return df.repartition(SHARES * df.sparkSession.sparkContext.defaultParallelism, *by)


#: Parts in which nearly all rows are keys of their own: what a task holds of them grows with the rows, and not with what adaptive shuffles put together.
#: Up to 200 a task writes its rows as they come (spark.shuffle.sort.bypassMergeThreshold), with more it holds them to sort them.
PARTS = 200


def in_parts(df: DataFrame, *by: str) -> DataFrame:
    """df dealt by columns into PARTS tasks, before anything is added up. A task that adds up the rows as it reads them holds as many keys as it has rows."""
    return df.repartition(PARTS, *by)
