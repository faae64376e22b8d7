"""Writers: CSV in two dialects and JSON payloads; workbooks are in `books`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that one workbook sheet can hold; larger exports are for CSV. Fixed value.
SHEET_ROWS = 1_048_575


def ordered(df: DataFrame, columns: list[str]) -> DataFrame:
    """Declared columns in order as text, missing ones and nulls empty, others left out."""
    return df.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns))


def insert_after(columns: list[str], name: str, anchor: str | None) -> list[str]:
    """Columns with `name` after the anchor, or at the end without one; unchanged if it is there."""
    if name in columns:
        return list(columns)
    at = columns.index(anchor) + 1 if anchor in columns else len(columns)
    return [*columns[:at], name, *columns[at:]]


def write_csv(df: DataFrame, path: str, columns: list[str], quote_all: bool = False) -> None:
    """Part files with a header each; the first header has a byte-order mark, as spreadsheets expect."""
    named = ordered(df, columns)
    named.toDF("﻿" + columns[0], *columns[1:]).write.mode("overwrite").csv(path, header=True, quoteAll=quote_all, escape='"', emptyValue="", lineSep="\n", encoding="UTF-8")


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(name))


def column_widths(df: DataFrame, columns: list[str], most: int = 60, least: int = 12) -> DataFrame:
    """The width of each column in characters, between `least` and `most`."""
    return df.agg(*(F.greatest(F.least(F.greatest(F.coalesce(F.max(F.length(F.col(f"`{c}`").cast("string"))), F.lit(0)), F.lit(len(c))) + 2, F.lit(most)), F.lit(least)).alias(c) for c in columns))
