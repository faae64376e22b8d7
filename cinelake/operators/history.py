"""Run history: an append-only table, newest runs, and the odd limit-before-filter read."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_run(spark: SparkSession, path: str, run_id: int, tracker: str, title: str, created_at: str, sections: dict[str, DataFrame]) -> None:
    """One row a run, with a row count over its sections and a JSON summary; the sections' rows stay in their own tables."""
    counts = {k: v.count() for k, v in sections.items()}
    row = spark.createDataFrame([(run_id, tracker, title, created_at, sum(counts.values()), counts)], "run_id long, tracker_type string, title string, created_at string, row_count long, sections map<string,long>")
    row.withColumn("snapshot", F.to_json("sections")).drop("sections").write.mode("append").parquet(path)


def recent_runs(runs: DataFrame, k: int = 12, created: str = "created_at", run_id: str = "run_id") -> DataFrame:
    return runs.orderBy(F.col(created).desc(), F.col(run_id).desc()).limit(k)


def runs_since(runs: DataFrame, since: dt.datetime, k: int = 100, created: str = "created_at", run_id: str = "run_id") -> DataFrame:
    """Of the last k runs by id those from `since` on; runs whose time can't be read stay. The limit comes first."""
    last = runs.orderBy(F.col(run_id).desc()).limit(k)
    when = F.col(created) if dict(runs.dtypes)[created].startswith("timestamp") else F.try_to_timestamp(created)
    return last.filter(when.isNull() | (when >= F.lit(since)))


def with_sections(rows: DataFrame, day: dt.date, date: str = "release_date") -> DataFrame:
    """Each row in the section `yearly`, those of the day also in `daily`."""
    sections = F.when(F.col(date) == F.lit(day), F.array(F.lit("daily"), F.lit("yearly"))).otherwise(F.array(F.lit("yearly")))
    return rows.withColumn("section", F.explode(sections))
