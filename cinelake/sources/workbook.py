"""Uploaded sheets: CSV and XLSX files of which the header row must be found."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.functions.text import squash
from cinelake.operators.validate import ALIASES

#: Rows in which a header may be, and known headers from which a row is taken at once. Fixed values.
HEADER_ROWS, ENOUGH = 20, 4
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
SCHEMA = "path string, sheet string, row_no int, cells array<string>"


def _column(reference: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def sheet_names(z: zipfile.ZipFile) -> list[str]:
    """A workbook's sheets in order, without reading them."""
    return [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")]


def sheet_rows(z: zipfile.ZipFile, name: str):
    """(row number, cells) of a sheet's values, a row at a time."""
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    sheet = next(s for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet") if s.get("name") == name)
    target = links[sheet.get(_LINK)].lstrip("/")
    with z.open(target if target.startswith("xl/") else f"xl/{target}") as part:
        seen = 0
        for _, row in ElementTree.iterparse(part):
            if row.tag != f"{_MAIN}row":
                continue
            seen += 1
            cells: list[str] = []
            for c in row.iter(f"{_MAIN}c"):
                at = _column(c.get("r")) if c.get("r") else len(cells)
                cells += [""] * (at - len(cells))
                kind, v = c.get("t"), c.find(f"{_MAIN}v")
                if kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                else:
                    text = (v.text or "") if v is not None else ""
                    text = shared[int(text)] if kind == "s" and text else text
                cells.append(text)
            yield int(row.get("r") or seen), cells
            row.clear()


def xlsx_rows(data: bytes):
    """(sheet, row number, cells) of a workbook's values."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for name in sheet_names(z):
            for no, cells in sheet_rows(z, name):
                yield name, no, cells


def csv_rows(data: bytes):
    for i, cells in enumerate(csv.reader(io.StringIO(data.decode("utf-8-sig", "replace"))), 1):
        yield "CSV", i, cells


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row_no, cells) of all CSV and XLSX files under a path, a file per task step."""

    def run(frames):
        for frame in frames:
            for name, data in zip(frame["path"], frame["content"]):
                read = xlsx_rows if name.lower().endswith((".xlsx", ".xlsm")) else csv_rows
                rows = [(name, sheet, no, [str(c) for c in cells]) for sheet, no, cells in read(bytes(data))]
                yield pd.DataFrame(rows, columns=["path", "sheet", "row_no", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)


def header_rows(cells: DataFrame) -> DataFrame:
    """(path, sheet, header_row, headers): the first of the first rows with enough known headers, else the one with most, the first of equals."""
    known = F.array(*(F.lit(a) for aliases in ALIASES.values() for a in aliases))
    keys = F.transform("cells", lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "_", " "), r"(?U)\s+", " ")))
    scored = cells.filter(f"row_no <= {HEADER_ROWS}").withColumn("keys", keys).withColumn("score", F.size(F.array_intersect("keys", known)))
    rank = F.struct((F.col("score") < ENOUGH).alias("few"), F.when(F.col("score") < ENOUGH, -F.col("score")).otherwise(0).alias("less"), "row_no")
    return scored.groupBy("path", "sheet").agg(F.min_by(F.struct(F.col("row_no").alias("header_row"), F.col("keys").alias("headers"), "score"), rank).alias("h")).filter("h.score > 0").select("path", "sheet", "h.header_row", "h.headers")


def parsed_rows(cells: DataFrame) -> DataFrame:
    """(path, sheet, row_no, values): rows below the header as header-to-value maps, blank rows left out; of repeated headers the first counts."""
    below = cells.join(header_rows(cells), ["path", "sheet"]).filter("row_no > header_row")
    pairs = F.filter(F.arrays_zip(F.col("headers").alias("k"), F.transform("cells", squash).alias("v")), lambda p: F.coalesce(p["k"], F.lit("")) != "")
    first = F.filter(F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), F.coalesce(p["v"], F.lit("")).alias("v"), i.alias("i"))), lambda p: F.array_position(F.transform(pairs, lambda q: q["k"]), p["k"]) == p["i"] + 1)
    values = F.map_from_entries(F.transform(first, lambda p: F.struct(p["k"], p["v"])))
    return below.withColumn("values", values).filter(F.exists(F.map_values("values"), lambda v: v != "")).select("path", "sheet", "row_no", "values")


def as_columns(rows: DataFrame) -> DataFrame:
    """sheet, row_no and a column for each alias that validation knows; the aliases are a fixed list, so no pass over the data finds them."""
    aliases = [a for group in ALIASES.values() for a in group]
    return rows.select("sheet", "row_no", *(F.try_element_at("values", F.lit(a)).alias(a) for a in aliases))


def pasted_inputs(lines: DataFrame, column: str = "value") -> DataFrame:
    """(name, kind, year, code) of lines `name|kind|year|code`; lines without a name go."""
    parts = F.split(column, r"\|")
    field = lambda i: F.trim(F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit("")))
    return lines.select(field(1).alias("name"), field(2).alias("kind"), field(3).alias("year"), field(4).alias("code")).filter("name != ''")
