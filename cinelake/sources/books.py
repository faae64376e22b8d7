"""Workbooks that tasks write: each task deflates its rows, the driver passes the pieces on and adds the archive's directory."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.functions.text import let
from cinelake.operators.validate import ALIASES
from cinelake.sources.scratch import scratch_path, written
from cinelake.sources.sinks import SHEET_ROWS, column_widths, ordered

# Fills and font colours of headers, errors and suggestions, and what the book of validated sheets adds.
HEADER_FILL, ERROR_FILL, ERROR_FONT, SUGGESTION_FILL, SUGGESTION_FONT = "EAF0F6", "FFC7CE", "9C0006", "FFF2CC", "7F6000"
SUMMARY_SHEET = "Validation Summary"
SUMMARY_COLUMNS = ["Sheet", "Row", "Column", "Cell", "Rule", "Message", "Value"]
COMMENT_AUTHOR, COMMENT_MOST = "Validator", 30_000
NOT_BLANK_RULES = {"Title required", "Approved category", "Sub-category required"}
NEW_ENTRY_SHEET = "Artist100 New Entries"
NEW_ENTRY_COLUMNS = ["Rank", "Artist Name", "Last Week", "Peak Position", "Weeks on Chart", "Chart Date", "IMDb nmcode", "IMDb URL", "Wikipedia URL", "Billboard Artist URL"]
NEW_ENTRY_WIDTHS = [8, 32, 10, 14, 16, 14, 16, 40, 48, 48]

#: Numbers of the cell styles of every book.
PLAIN, HEADER, ERROR, SUGGESTION, WRAPPED, BOLD = range(6)
#: Bytes of text that a task deflates into one piece.
PIECE_BYTES = 1 << 20
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'


@dataclass
class Sheet:
    """A sheet: `rows` has a column `cells` (texts) and maybe `styles` (a number for each cell), in the order of `order`; comments are (ref, row, col, text)."""

    name: str
    rows: DataFrame
    order: list[str | Column]
    header: list[str] | None = None
    header_style: int = HEADER
    style: int = PLAIN
    widths: list[int] = field(default_factory=list)
    filtered: bool = False
    comments: DataFrame | None = None
    number: str | None = None  # column of row numbers, where rows may be missing in between


def letters(i: int) -> str:
    """The name of column i, counted from 0."""
    out = ""
    while i >= 0:
        out, i = chr(65 + i % 26) + out, i // 26 - 1
    return out


# Checksums of pieces make that of the whole: a checksum is a polynomial's remainder, and putting n bytes behind it multiplies it by x to the 8n.


def _times(a: int, b: int) -> int:
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def joined_crc(first: int, second: int, size: int) -> int:
    """The CRC-32 of two byte strings one after the other, from theirs and the second one's size."""
    shift, power = 1 << 31, 1 << 23  # 1 and x to the 8th
    while size:
        if size & 1:
            shift = _times(shift, power)
        power, size = _times(power, power), size >> 1
    return _times(shift, first) ^ second


def deflated(text: bytes, last: bool = False) -> bytes:
    """A piece of a raw deflate stream that ends at a byte and may stand after any other."""
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    return c.compress(text) + c.flush(zlib.Z_FINISH if last else zlib.Z_FULL_FLUSH)


PIECES = "part int, seq int, size long, crc long, data binary"


def pieces(rows: DataFrame, render: Callable[[dict], str]) -> DataFrame:
    """(part, seq, size, crc, data): the rows' texts in order, deflated by the tasks that hold them; rows are ordered over their partitions."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def piece():
            text = "".join(held).encode("utf-8", "surrogatepass")
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "size": pa.array([len(text)]), "crc": pa.array([zlib.crc32(text)]), "data": pa.array([deflated(text)], pa.binary())})

        for batch in batches:
            for row in batch.to_pylist():
                held.append(render(row))
                size += len(held[-1])
                if size >= PIECE_BYTES:
                    yield piece()
                    seq, held, size = seq + 1, [], 0
        if held:
            yield piece()

    return rows.mapInArrow(run, PIECES)


#: Control signs, which XML can't hold.
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")
_OPEN = [f'<c t="inlineStr"{f" s={quoteattr(str(style))}" if style else ""}><is><t xml:space="preserve">' for style in range(6)]


def _clean(text: str) -> str:
    """Text that XML can hold: control signs go."""
    return escape(_CONTROL.sub("", text))


def _cell(value, style: int) -> str:
    return f'{_OPEN[style]}{_clean("" if value is None else str(value))}</t></is></c>'


def _row(cells: list, styles: list[int] | None, style: int, number: int | None = None) -> str:
    return (f'<row r="{number}">' if number else "<row>") + "".join(_cell(v, (styles[i] if styles and i < len(styles) and styles[i] else 0) or style) for i, v in enumerate(cells)) + "</row>"


class _Archive:
    """A zip archive written from front to back: texts, and members of pieces that are deflated already."""

    def __init__(self, out):
        self.out, self.at, self.members = out, 0, []

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, head: str, body: Iterable = (), tail: str = "") -> None:
        """A member of a text, pieces (size, crc, data) and a text; sizes and checksum stand behind it."""
        start, raw = self.at, name.encode()
        self._write(struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 20, 8, 8, 0, 0x21, 0, 0, 0, len(raw), 0) + raw)
        first, begin = self.at, head.encode()
        self._write(deflated(begin))
        total, crc = len(begin), zlib.crc32(begin)
        for size, piece_crc, data in body:
            self._write(data)
            total, crc = total + size, joined_crc(crc, piece_crc, size)
        end = tail.encode()
        self._write(deflated(end, last=True))
        total, crc = total + len(end), joined_crc(crc, zlib.crc32(end), len(end))
        packed = self.at - first
        if max(total, packed, self.at) >= 1 << 32:
            raise ValueError("a workbook's part ends at 4 GiB; write CSV instead")
        self._write(struct.pack("<4sIII", b"PK\x07\x08", crc, packed, total))
        self.members.append((raw, crc, packed, total, start))

    def close(self) -> None:
        start = self.at
        for raw, crc, packed, total, at in self.members:
            self._write(struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 20, 20, 8, 8, 0, 0x21, crc, packed, total, len(raw), 0, 0, 0, 0, 0, at) + raw)
        self._write(struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, len(self.members), len(self.members), self.at - start, start, 0))


def _stored(rows: DataFrame, render: Callable[[dict], str], tag: str) -> Callable[[], Iterator[tuple]]:
    """Pieces of rows in the shared folder, and a way to read them one after the other, never all at once."""
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, tag)
    pieces(rows, render).write.parquet(path)

    def read():
        table = spark.read.schema(PIECES).parquet(path)
        for row in table.orderBy("part", "seq").toLocalIterator():
            yield row.size, row.crc, bytes(row.data)

    return read


_STYLES = (
    f'{_XML}<styleSheet xmlns="{_MAIN}"><fonts count="4"><font/><font><b/></font><font><color rgb="FF{ERROR_FONT}"/></font><font><color rgb="FF{SUGGESTION_FONT}"/></font></fonts>'
    + '<fills count="5"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>'
    + "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="FF{c}"/><bgColor rgb="FF{c}"/></patternFill></fill>' for c in (HEADER_FILL, ERROR_FILL, SUGGESTION_FILL))
    + '</fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="6"><xf/><xf fontId="1" fillId="2" applyFont="1" applyFill="1"/><xf fontId="2" fillId="3" applyFont="1" applyFill="1"/>'
    + '<xf fontId="3" fillId="4" applyFont="1" applyFill="1"/><xf applyAlignment="1"><alignment vertical="top" wrapText="1"/></xf><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>'
)


def write_book(spark: SparkSession, path: str, sheets: list[Sheet]) -> None:
    """A workbook at a path, local or of a store that pyarrow opens. The driver holds one piece at a time, whatever the sheets' size; more rows than a sheet can hold are an error."""
    system, inner = fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)
    bodies = []
    for i, sheet in enumerate(sheets, 1):
        if sheet.rows.count() > SHEET_ROWS:
            raise ValueError(f"a sheet holds {SHEET_ROWS} rows; write CSV instead")
        styles = F.col("styles") if "styles" in sheet.rows.columns else F.lit(None).cast("array<int>")
        style = sheet.style
        number = F.col(sheet.number) if sheet.number else F.lit(None)
        rows = sheet.rows.orderBy(*sheet.order).select(F.col("cells").cast("array<string>").alias("cells"), styles.alias("styles"), number.cast("int").alias("number"))
        body = _stored(rows, lambda r, s=style: _row(r["cells"] or [], r["styles"], s, r["number"]), f"sheet{i}")
        notes = None
        if sheet.comments is not None:
            told = sheet.comments.orderBy("row", "col").select("ref", "row", "col", "text")
            notes = (
                _stored(told, lambda r: f'<comment ref="{r["ref"]}" authorId="0"><text><t xml:space="preserve">{_clean(r["text"])}</t></text></comment>', f"comments{i}"),
                _stored(told, lambda r: f'<v:shape type="#n" style="visibility:hidden"><x:ClientData ObjectType="Note"><x:Row>{r["row"] - 1}</x:Row><x:Column>{r["col"]}</x:Column></x:ClientData></v:shape>', f"notes{i}"),
            )
        bodies.append((sheet, body, notes))
    with system.open_output_stream(inner) as out:
        archive = _Archive(out)
        parts = "".join(
            f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' + (f'<Override PartName="/xl/comments{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.comments+xml"/>' if notes else "")
            for i, (_, _, notes) in enumerate(bodies, 1)
        )
        archive.add("[Content_Types].xml", f'{_XML}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Default Extension="vml" ContentType="application/vnd.openxmlformats-officedocument.vmlDrawing"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{parts}</Types>')
        rel = lambda i, kind, target: f'<Relationship Id="rId{i}" Type="{_RELS}/{kind}" Target="{target}"/>'
        rels = lambda text: f'{_XML}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{text}</Relationships>'
        archive.add("_rels/.rels", rels(rel(1, "officeDocument", "xl/workbook.xml")))
        names = "".join(f'<sheet name={quoteattr(s.name[:31])} sheetId="{i}" r:id="rId{i}"/>' for i, (s, _, _) in enumerate(bodies, 1))
        archive.add("xl/workbook.xml", f'{_XML}<workbook xmlns="{_MAIN}" xmlns:r="{_RELS}"><sheets>{names}</sheets></workbook>')
        archive.add("xl/_rels/workbook.xml.rels", rels("".join(rel(i, "worksheet", f"worksheets/sheet{i}.xml") for i in range(1, len(bodies) + 1)) + rel(len(bodies) + 1, "styles", "styles.xml")))
        archive.add("xl/styles.xml", _STYLES)
        for i, (sheet, body, notes) in enumerate(bodies, 1):
            pane = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>' if sheet.header else ""
            cols = "<cols>" + "".join(f'<col min="{j}" max="{j}" width="{w}" customWidth="1"/>' for j, w in enumerate(sheet.widths, 1)) + "</cols>" if sheet.widths else ""
            head = f'{_XML}<worksheet xmlns="{_MAIN}" xmlns:r="{_RELS}">{pane}{cols}<sheetData>' + (_row(sheet.header, None, sheet.header_style) if sheet.header else "")
            tail = "</sheetData>" + (f'<autoFilter ref="A1:{letters(len(sheet.header) - 1)}1"/>' if sheet.filtered and sheet.header else "") + ('<legacyDrawing r:id="rId1"/>' if notes else "") + "</worksheet>"
            archive.add(f"xl/worksheets/sheet{i}.xml", head, body(), tail)
            if notes:
                archive.add(f"xl/worksheets/_rels/sheet{i}.xml.rels", rels(rel(1, "vmlDrawing", f"../drawings/notes{i}.vml") + rel(2, "comments", f"../comments{i}.xml")))
                archive.add(f"xl/comments{i}.xml", f'{_XML}<comments xmlns="{_MAIN}"><authors><author>{COMMENT_AUTHOR}</author></authors><commentList>', notes[0](), "</commentList></comments>")
                archive.add(f"xl/drawings/notes{i}.vml", '<xml xmlns:v="urn:schemas-microsoft-com:vml" xmlns:x="urn:schemas-microsoft-com:office:excel"><v:shapetype id="n" coordsize="21600,21600" path="m,l,21600r21600,l21600,xe"/>', notes[1](), "</xml>")
        archive.close()


def table_sheet(df: DataFrame, columns: list[str], order: list[str | Column], name: str = "Export", widths: list[int] | None = None) -> Sheet:
    """A sheet of declared columns under a header; widths are those of the longest texts, up to 60, unless given."""
    named = ordered(df, columns)
    told = widths or list(column_widths(named, columns, 60, 0).first())
    keyed = df.select(*(F.col(o) if isinstance(o, str) else o for o in order), F.array(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) if c in df.columns else F.lit("") for c in columns)).alias("cells"))
    return Sheet(name, keyed, [F.col(c) for c in keyed.columns[:-1]], list(columns), widths=told)


def new_entries_sheet(entries: DataFrame, order: list[str | Column]) -> Sheet:
    """New entries of a chart in the ten columns of their workbook."""
    return table_sheet(entries, NEW_ENTRY_COLUMNS, order, NEW_ENTRY_SHEET, NEW_ENTRY_WIDTHS)


# The book of validated sheets


def issue_cells(issues: DataFrame, headers: DataFrame) -> DataFrame:
    """Issues with `col`, the place (from 0) of the first header of their sheet (sheet, headers) that is an alias of their column, and `ref`; null and empty where there is none."""
    known = F.create_map(*(F.lit(x) if isinstance(x, str) else F.split(F.lit("\x1f".join(x)), "\x1f") for pair in ALIASES.items() for x in pair))
    accepted = F.concat(F.coalesce(F.try_element_at(known, F.col("column")), F.array().cast("array<string>")), F.array(F.col("column"), F.replace("column", F.lit("_"), F.lit(" "))))
    joined = issues.join(headers.select("sheet", F.col("headers").alias("__headers")), "sheet", "left")
    place = let(accepted, lambda accepted: F.array_min(F.filter(F.transform("__headers", lambda h, i: F.when(F.array_contains(accepted, h), i)), lambda i: i.isNotNull())))
    first, second = F.col("col") % 26, F.floor(F.col("col") / 26) - 1
    name = F.concat(F.when(F.col("col") >= 26, F.char(second + 65)).otherwise(""), F.char(first + 65))
    return joined.withColumn("col", place).drop("__headers").withColumns({"letter": F.coalesce(name, F.col("column")), "ref": F.coalesce(F.concat(name, F.col("row_no").cast("string")), F.lit(""))})


def rule_slug(rule: Column | str = "rule") -> Column:
    """The name of a rule in the summary."""
    name = F.col(rule) if isinstance(rule, str) else rule
    slug = F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(name.isin(*sorted(NOT_BLANK_RULES)), "not_blank_and_not_in").when(name == "Talent sub-category", "talent_subcategory_format").otherwise(F.coalesce(F.nullif(slug, F.lit("")), F.lit("validation_issue")))


def cell_comments(placed: DataFrame) -> DataFrame:
    """(sheet, row, col, ref, text): the comment of each cell, its issues' texts in order without those that it holds already, 30,000 characters at most."""
    body = F.array_join(F.filter(F.array("rule", "message", "suggestion"), lambda x: F.coalesce(x, F.lit("")) != ""), "\n")
    listed = placed.filter("col is not null").groupBy("sheet", F.col("row_no").alias("row"), "col", "ref").agg(F.array_sort(F.collect_list(F.struct("issue_no", body.alias("body")))).alias("b"))
    more = lambda text, b: F.when(F.contains(text, b["body"]), text).otherwise(F.substring(F.when(text == "", b["body"]).otherwise(F.concat(text, F.lit("\n"), b["body"])), 1, COMMENT_MOST))
    return listed.select("sheet", "row", "col", "ref", F.aggregate("b", F.lit(""), more).alias("text")).filter("text != ''")


def cell_styles(placed: DataFrame) -> DataFrame:
    """(sheet, row_no, styles): the style of each cell of a row that has issues, that of the cell's last issue."""
    level = F.when(F.col("level") == "error", ERROR).otherwise(SUGGESTION)
    last = placed.filter("col is not null").groupBy("sheet", "row_no", "col").agg(F.max_by(level, "issue_no").alias("style"))
    rows = last.groupBy("sheet", "row_no").agg(F.map_from_entries(F.collect_list(F.struct("col", "style"))).alias("m"), F.max("col").alias("most"))
    return rows.select("sheet", "row_no", F.transform(F.sequence(F.lit(0), F.col("most")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(PLAIN))).alias("styles"))


def summary_rows(placed: DataFrame) -> DataFrame:
    """The rows of the summary sheet, in the order of sheets, rows and issues; one that says so where there is no issue."""
    rows = placed.select("sheet", "row_no", "issue_no", F.array("sheet", F.col("row_no").cast("string"), "letter", "ref", rule_slug(), "message", "value").alias("cells"))
    none = placed.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit("Workbook").alias("sheet"), F.lit(0).alias("row_no"), F.lit(0).alias("issue_no"), F.array(*map(F.lit, ["Workbook", "", "", "", "validation_complete", "No validation issues found.", ""])).alias("cells"))
    return rows.unionByName(none)


def _further(name: str, i: int, taken: set[str]) -> str:
    """The name of a sheet's i-th continuation, 31 characters at most and none that is taken; its own for 0."""
    out = name
    while i and (out == name or out in taken):
        end = f" ({i + 1})"
        out, i = name[: 31 - len(end)] + end, i + 1
    taken.add(out)
    return out


def summary_parts(rows: DataFrame, most: int) -> list[DataFrame]:
    """Summary rows in parts of at most `most`, one after the other, cut between blocks of a sheet's rows; the driver gets a number for each block."""
    block = F.floor(F.col("row_no") / max(1, most // 1000))
    counts = rows.groupBy("sheet", block.alias("block")).agg(F.count("*").alias("n")).orderBy("sheet", "block").collect()
    firsts, held = [], 0
    for r in counts:
        if held + r.n > most and held:
            firsts.append((r.sheet, r.block))
            held = 0
        held += r.n
    starts = [(F.col("sheet") > sheet) | ((F.col("sheet") == sheet) & (block >= b)) for sheet, b in firsts]
    return [rows.filter(reduce(Column.__and__, [*starts[i - 1 : i] * (i > 0), *(~x for x in starts[i : i + 1])], F.lit(True))) for i in range(len(starts) + 1)]


def write_validated(cells: DataFrame, headers: DataFrame, issues: DataFrame, path: str) -> list[str]:
    """The book of uploaded sheets (sheet, row_no, cells) with fills and comments where issues (of validate.report) are, and a summary; returns the names of the summary's sheets.

    headers is (sheet, headers), header keys of each sheet; there are as many sheets as names among
    them. What is more than a sheet can hold goes on in further ones, `name (2)` and so on, whose rows
    are counted from 1 again; the summary tells the upload's own rows.
    """
    spark, most = cells.sparkSession, SHEET_ROWS
    placed = written(issue_cells(issues, headers), "placed")
    styled = written(cells.join(cell_styles(placed), ["sheet", "row_no"], "left"), "styled")
    comments = written(cell_comments(placed), "comments")
    names = [r.sheet for r in headers.select("sheet").distinct().orderBy("sheet").collect()]  # a book's sheets
    taken, sheets = {*names, SUMMARY_SHEET}, []
    lasts = {r.sheet: r.last for r in styled.groupBy("sheet").agg(F.max("row_no").alias("last")).collect()}
    for name in (n for n in names if n != SUMMARY_SHEET):
        for i in range(max(1, -(-(lasts.get(name) or 0) // most))):
            own = lambda df, c: df.filter((F.col("sheet") == name) & (F.floor((F.col(c) - 1) / most) == i)).withColumn(c, F.col(c) - i * most)  # noqa: B023, E731
            notes = own(comments, "row").withColumn("ref", F.concat(F.regexp_extract("ref", "^[A-Z]+", 0), "row"))
            sheets.append(Sheet(_further(name, i, taken), own(styled, "row_no"), ["row_no"], comments=notes, number="row_no"))
    rows = written(summary_rows(placed), "summary")
    widths = rows.agg(*(F.greatest(F.least(F.greatest(F.coalesce(F.max(F.length(F.get("cells", F.lit(i)))), F.lit(0)), F.lit(len(c))) + 2, F.lit(48)), F.lit(12)) for i, c in enumerate(SUMMARY_COLUMNS))).first()
    summaries = [Sheet(_further(SUMMARY_SHEET, i, taken), part, ["sheet", "row_no", "issue_no"], SUMMARY_COLUMNS, BOLD, WRAPPED, list(widths), filtered=True) for i, part in enumerate(summary_parts(rows, most))]
    write_book(spark, path, [*sheets, *summaries])
    return [s.name for s in summaries]
