"""A data source for landed sheets: `spark.read.format("landed")` reads gzip TSV, CSV and workbooks, a partition a file or sheet."""

from __future__ import annotations

import csv
import gzip
import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull
from pyspark.sql.types import StringType, StructType

from cinelake.sources.workbook import sheet_names, sheet_rows

#: Rows of a batch that goes to Spark.
BATCH_ROWS = 4_096
#: What a row is made of where no columns are asked for.
CELLS = "path string, sheet string, row_no int, cells array<string>, bad string"
#: Columns that tell where a row comes from, and what is wrong with it.
PLACES, BAD = ("_path", "_sheet", "_row_no"), "_bad"
WORKBOOKS = (".xlsx", ".xlsm")


@dataclass
class Piece(InputPartition):
    """A file, or a sheet of a workbook."""

    path: str
    sheet: str


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    """The files at a path or under it, with names that begin neither with a dot nor an underscore."""
    system, inner = _opened(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else [f for f in system.get_file_info(fs.FileSelector(inner, recursive=True)) if f.is_file]
    head = path[: len(path) - len(inner)] if path.endswith(inner) else path[: path.index(":") + 1] + "//"
    return sorted(head + f.path for f in found if f.base_name[0] not in "._")


def _text_rows(path: str, stream) -> Iterator[tuple[int, list[str], str | None]]:
    """(row number, cells, what is wrong) of a CSV or TSV file, gzip or not; TSV knows no quotes."""
    name = path.lower()
    raw = gzip.GzipFile(fileobj=stream) if name.endswith(".gz") else stream
    text = io.TextIOWrapper(raw, "utf-8-sig", errors="surrogateescape", newline="")
    tabs = name.removesuffix(".gz").endswith(".tsv")
    reader = csv.reader(text, delimiter="\t", quoting=csv.QUOTE_NONE) if tabs else csv.reader(text)
    no = 0
    while True:
        no += 1
        try:
            cells = next(reader)
        except StopIteration:
            return
        except (csv.Error, EOFError, gzip.BadGzipFile) as e:
            yield no, [], f"{type(e).__name__}: {e}"
            if not isinstance(e, csv.Error):
                return  # a torn file: what came before it is whole
            continue
        wrong = "not UTF-8" if any("\udc80" <= ch <= "\udcff" for cell in cells for ch in cell) else None
        yield no, [c.encode("utf-8", "surrogateescape").decode("utf-8", "replace") for c in cells] if wrong else cells, wrong


def _rows(piece: Piece) -> Iterator[tuple[int, list[str], str | None]]:
    system, inner = _opened(piece.path)
    if not piece.path.lower().endswith(WORKBOOKS):
        with system.open_input_stream(inner, compression=None) as stream:
            yield from _text_rows(piece.path, stream)
        return
    try:
        with system.open_input_file(inner) as stream:
            for no, cells in sheet_rows(zipfile.ZipFile(stream), piece.sheet):
                yield no, cells, None
    except (zipfile.BadZipFile, KeyError, SyntaxError, ValueError) as e:
        yield 0, [], f"{type(e).__name__}: {e}"


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType, headed: bool):
        self.path, self.schema, self.headed = options["path"], schema, headed
        self.sheets: set[str] | None = None
        self.wanted: dict[str, set] = {}
        self.needed: set[str] = set()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality, IN and IS NOT NULL on texts are applied before rows are made; sheets that aren't asked for are never opened."""
        for f in filters:
            own = self.headed and getattr(f, "attribute", ("",))[0] in set(self.schema.names) - {*PLACES, BAD} and len(f.attribute) == 1
            if isinstance(f, IsNotNull) and own:
                self.needed.add(f.attribute[0])
                continue
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            name = f.attribute[0] if values is not None and len(f.attribute) == 1 else None
            if name in ("sheet", "_sheet") and name in self.schema.names:
                self.sheets = values if self.sheets is None else self.sheets & values
            elif name is not None and own:
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f

    def partitions(self) -> list[Piece]:
        pieces: list[Piece] = []
        for path in _files(self.path):
            if not path.lower().endswith(WORKBOOKS):
                pieces.append(Piece(path, "CSV"))
                continue
            system, inner = _opened(path)
            with system.open_input_file(inner) as stream:
                try:
                    pieces += [Piece(path, name) for name in sheet_names(zipfile.ZipFile(stream))]
                except (zipfile.BadZipFile, KeyError, SyntaxError, ValueError):
                    pieces.append(Piece(path, ""))  # read() reports it
        return [p for p in pieces if self.sheets is None or p.sheet in self.sheets] or [Piece("", "")]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([(f.name, pa.list_(pa.string()) if f.name == "cells" and not self.headed else pa.int32() if f.dataType.simpleString() == "int" else pa.string()) for f in self.schema.fields])
        columns: list[list] = [[] for _ in kinds]
        for row in self._made(piece) if piece.path else ():
            for column, value in zip(columns, row):
                column.append(value)
            if len(columns[0]) == BATCH_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, kinds)], schema=kinds)
                columns = [[] for _ in kinds]
        if columns[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, kinds)], schema=kinds)

    def _made(self, piece: Piece) -> Iterator[list]:
        if not self.headed:
            for no, cells, bad in _rows(piece):
                value = {"path": piece.path, "sheet": piece.sheet, "row_no": no, "cells": cells, "bad": bad}
                yield [value[n] for n in self.schema.names]
            return
        header: list[str] | None = None
        for no, cells, bad in _rows(piece):
            if header is None and bad is None:
                header = cells
                continue
            if bad is None and len(cells) != len(header):
                bad = f"{len(cells)} cells under {len(header)} headers"
            if bad is not None and BAD not in self.schema.names:
                raise ValueError(f"{piece.path}, row {no}: {bad}; ask for a column {BAD} to have such rows reported")
            value = dict(zip(header or [], cells)) | {"_path": piece.path, "_sheet": piece.sheet, "_row_no": no, BAD: bad}
            value = {n: None if v == r"\N" else v for n, v in value.items()}
            if all(value.get(n) in wanted for n, wanted in self.wanted.items()) and all(value.get(n) is not None for n in self.needed):
                yield [value.get(n) for n in self.schema.names]


class Landed(DataSource):
    """Files `*.tsv`, `*.csv`, each also with `.gz`, `*.xlsx` and `*.xlsm` at a path or under it.

    Without a schema rows are (path, sheet, row_no, cells, bad). With one, the first row of each
    piece holds the headers, and only the columns asked for are made, all as text; `\\N` is null. The
    places _path, _sheet and _row_no (int) may be among them, and _bad: what is wrong with a row
    (cells more or fewer than headers, bytes that aren't UTF-8, a torn file). Without it such a row
    is an error, never dropped in silence.
    """

    @classmethod
    def name(cls) -> str:
        return "landed"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema: StructType) -> DataSourceReader:
        headed = "cells" not in schema.names
        odd = [f.name for f in schema.fields if headed and f.name != "_row_no" and f.dataType != StringType()]
        if odd:
            raise ValueError(f"columns of sheets are texts: {', '.join(odd)}")
        return _Reader(self.options, schema, headed)


def register(spark: SparkSession) -> None:
    """Makes format("landed") known to a session, with filters pushed into it."""
    spark.dataSource.register(Landed)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
