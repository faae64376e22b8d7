"""Tallies of rows that the job which writes them counts, so that nothing is computed twice."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def write_tallied(rows: DataFrame, path: str, mode: str = "error", /, **tallies: Column) -> dict[str, int]:
    """Writes rows as Parquet and returns the tallies (aggregates by name), from one job.

    The numbers are those of the tasks that succeeded: what a failed attempt counted is thrown away
    with its rows.
    """
    seen = Observation(f"tallies-{uuid.uuid4().hex}")
    rows.observe(seen, *(c.alias(n) for n, c in tallies.items())).write.mode(mode).parquet(path)
    return seen.get


def status_tallies(status: str, names: list[str]) -> dict[str, Column]:
    """Aggregates for write_tallied: all rows, and those of each status."""
    return {"rows": F.count("*")} | {n.lower().replace(" ", "_"): F.count_if(F.col(status) == n) for n in names}
