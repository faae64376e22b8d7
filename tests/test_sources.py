"""Workbooks that tasks write, landed sheets as a data source, and what they hold after a round trip."""

import gzip
import random
import re
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from cinelake.operators import validate
from cinelake.sources import books, index, landed, tsv, workbook


def test_checksums_and_streams_join():
    rng = random.Random(1)
    parts = [rng.randbytes(n) for n in (0, 1, 70_000, 5, 1 << 16)]
    crc, packed = 0, b""
    for i, part in enumerate(parts):
        crc = books.joined_crc(crc, zlib.crc32(part), len(part))
        packed += books.deflated(part, last=i == len(parts) - 1)
    whole = b"".join(parts)
    assert crc == zlib.crc32(whole) and zlib.decompress(packed, -15) == whole


def test_books_hold_what_was_written(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(books, "PIECE_BYTES", 2_000)
    odd = ["<&>\"'", "naïve 東京 🎉", "  two  spaces ", "a\nb", "\x07bell", None, ""]
    rows = [(i, f"title {i}", odd[i % len(odd)]) for i in range(3_000)]
    df = spark.createDataFrame(rows, "no int, title string, note string").repartition(7)
    path = str(tmp_path / "b.xlsx")
    books.write_book(spark, path, [books.table_sheet(df, ["title", "note", "lacking"], ["no"], "A & B"), books.table_sheet(df.limit(0), ["title"], ["no"], "Empty")])
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and workbook.sheet_names(z) == ["A & B", "Empty"]
        got = list(workbook.sheet_rows(z, "A & B"))
        assert list(workbook.sheet_rows(z, "Empty")) == [(1, ["title"])]
        head = z.read("xl/worksheets/sheet1.xml")[:900].decode()
    assert got[0] == (1, ["title", "note", "lacking"]) and 'state="frozen"' in head and 'width="12"' in head
    assert got[1:] == [(i + 2, [t, (n or "").replace("\x07", ""), ""]) for i, t, n in rows]
    with pytest.raises(ValueError):
        monkeypatch.setattr(books, "SHEET_ROWS", 10)
        books.write_book(spark, path, [books.table_sheet(df, ["title"], ["no"])])


def test_new_entries_have_their_ten_columns(spark, tmp_path):
    df = spark.createDataFrame([(2, "B"), (1, "A")], "Rank int, `Artist Name` string")
    books.write_book(spark, str(tmp_path / "n.xlsx"), [books.new_entries_sheet(df, ["Rank"])])
    with zipfile.ZipFile(tmp_path / "n.xlsx") as z:
        assert workbook.sheet_names(z) == [books.NEW_ENTRY_SHEET]
        got = list(workbook.sheet_rows(z, books.NEW_ENTRY_SHEET))
    assert [c[:2] for _, c in got] == [["Rank", "Artist Name"], ["1", "A"], ["2", "B"]] and len(got[0][1]) == 10


def test_validated_books_mark_their_cells(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text('report\n\nTitle,Category,Sub Category,Genre,Primary Genre,Company,Brand Set,Twitter Search Terms\n,nonsense,Film,Drama,Comedy,Acme,Competitive View,x\nDune,TV Shows,Film,Drama,Drama,Acme,Competitive View,\n')
    cells = workbook.read_cells(spark, str(tmp_path / "in")).cache()
    headers = workbook.header_rows(cells)
    issues = validate.report(workbook.as_columns(workbook.parsed_rows(cells)))
    path = str(tmp_path / "out.xlsx")
    books.write_validated(cells.select("sheet", "row_no", "cells"), headers.select("sheet", "headers"), issues, path)
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None
        sheet, notes, vml = (z.read(n).decode() for n in ("xl/worksheets/sheet1.xml", "xl/comments1.xml", "xl/drawings/notes1.vml"))
        rows = dict(workbook.sheet_rows(z, "CSV"))
        summary = [c for _, c in workbook.sheet_rows(z, books.SUMMARY_SHEET)]
    assert rows[1] == ["report"] and rows[4][1] == "nonsense" and rows[5][0] == "Dune"
    styles = {int(n): [int(s or 0) for s in re.findall(r'<c t="inlineStr"(?: s="(\d)")?>', body)] for n, body in re.findall(r'<row r="(\d+)">(.*?)</row>', sheet)}
    assert styles[4][0] == styles[4][1] == books.ERROR and styles[4][4] == books.SUGGESTION and styles[4][5] == books.PLAIN and styles[5][7] == books.ERROR and not any(styles[3])
    assert 'ref="A4"' in notes and 'ref="H5"' in notes and notes.count("<comment ") == vml.count("<x:Row>")
    assert summary[0] == books.SUMMARY_COLUMNS
    assert ["CSV", "4", "A", "A4", "not_blank_and_not_in"] in [s[:5] for s in summary] and ["CSV", "5", "H", "H5", "twitter_terms_required"] in [s[:5] for s in summary]
    # an issue about a column that the sheet hasn't got names the column
    assert ["CSV", "5", "twitter_search_term_keywords", ""] in [s[:4] for s in summary]


def test_comments_leave_out_what_they_hold(spark):
    issue = lambda no, rule, message, col="A": ("s", 2, no, rule, message, "", 0, "A2", "error" if no < 3 else "suggestion")
    placed = spark.createDataFrame([issue(1, "R", "long text"), issue(2, "R", "long"), issue(3, "Q", "x" * 40_000)], "sheet string, row_no int, issue_no int, rule string, message string, suggestion string, col int, ref string, level string")
    text = books.cell_comments(placed).first().text
    assert text.startswith("R\nlong text\nQ\nxxx") and len(text) == 30_000
    assert books.cell_styles(placed).first().styles == [books.SUGGESTION]
    assert [r.cells[4] for r in books.summary_rows(placed.withColumn("letter", F.lit("A")).withColumn("value", F.lit("")).limit(0)).collect()] == ["validation_complete"]


def test_landed_sheets_are_a_data_source(spark, tmp_path):
    landed.register(spark)
    with gzip.open(tmp_path / "t.tsv.gz", "wt") as f:
        f.write("id\tname\tyear\n" + "".join(f"t{i}\tName \"{i}\t{'1999' if i % 2 else chr(92) + 'N'}\n" for i in range(10_000)) + "torn\n")
    wanted = "id string, year string, _row_no int, _bad string"
    df = spark.read.format("landed").schema(wanted).load(str(tmp_path / "t.tsv.gz"))
    assert df.filter("year = '1999'").count() == 5_000 and df.filter("_bad is not null").select("_bad").first()[0] == "1 cells under 3 headers"
    assert df.filter("id in ('t7', 't8')").orderBy("id").select("year", "_row_no").collect() == [("1999", 9), (None, 10)]
    plan = df.filter("year = '1999'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter isnotnull" not in plan and "Filter (" not in plan
    with pytest.raises(Exception, match="1 cells under 3 headers"):
        spark.read.format("landed").schema("id string").load(str(tmp_path / "t.tsv.gz")).collect()
    with pytest.raises(Exception, match="texts"):
        spark.read.format("landed").schema("id int").load(str(tmp_path / "t.tsv.gz")).collect()


def test_landed_books_are_a_partition_a_sheet(spark, tmp_path):
    landed.register(spark)
    df = spark.createDataFrame([(i, f"n{i}") for i in range(5)], "no int, name string")
    books.write_book(spark, str(tmp_path / "b.xlsx"), [books.table_sheet(df, ["no", "name"], ["no"], s) for s in ("One", "Two", "Three")])
    (tmp_path / "c.csv").write_bytes(b"\xef\xbb\xbfno,name\n1,\"a,b\"\n2,caf\xe9\n")
    (tmp_path / "broken.xlsx").write_bytes(b"no archive")
    (tmp_path / "_ignored.csv").write_text("x")
    cells = spark.read.format("landed").load(str(tmp_path))
    assert cells.rdd.getNumPartitions() == 5
    two = cells.filter("sheet = 'Two'")
    assert two.rdd.getNumPartitions() == 1 and [r.cells for r in two.orderBy("row_no").collect()] == [["no", "name"]] + [[str(i), f"n{i}"] for i in range(5)]
    assert sorted((r.sheet, r.row_no) for r in cells.filter("bad is not null").collect()) == [("", 0), ("CSV", 3)]
    assert [r.cells for r in cells.filter("sheet = 'CSV' and bad is null").orderBy("row_no").collect()] == [["no", "name"], ["1", "a,b"]]
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("landed").load(str(tmp_path / "nowhere")).collect()


def dumps(tmp_path, shows):
    """Three gzip dumps: titles that are shows and films by turns, names, and episodes of all."""
    lines = {
        "titles": ["\t".join(tsv.TITLE_COLUMNS)] + ["\t".join([f"tt{i}", "tvSeries" if i % 2 else "movie", f"Title {i % 40}", f"Original {i}", "0", "2020", "\\N", "\\N", "Drama"]) for i in range(shows)],
        "names": ["\t".join(tsv.NAME_COLUMNS)] + [f"nm{i}\tName {i}\t1980\t\\N\tactor\ttt1,tt2" for i in range(30)] + ["nm99\t\\N\t\\N\t\\N\t\\N\t\\N"],
        "episodes": ["\t".join(tsv.EPISODE_COLUMNS)] + [f"e{i}\ttt{i % shows}\t{i % 3 + 1}\t{i}" for i in range(300)],
    }
    for name, rows in lines.items():
        with gzip.open(tmp_path / f"{name}.tsv.gz", "wt") as f:
            f.write("\n".join(rows) + "\n")
    return [str(tmp_path / f"{n}.tsv.gz") for n in ("titles", "names", "episodes")]


def test_a_build_that_dies_leaves_the_index_as_it_was(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/index"
    assert index.current(spark, root) is None
    first = index.build(spark, root, *dumps(tmp_path, 50), buckets=4)
    assert index.current(spark, root) == first and first.rows == {"titles": 100, "names": 30, "episodes": 150}
    pinned = index.current(spark, root).table(spark, "titles")
    monkeypatch.setattr(index.tsv, "episodes", lambda *a: (_ for _ in ()).throw(RuntimeError("dies")))
    with pytest.raises(RuntimeError):
        index.build(spark, root, *dumps(tmp_path, 60), buckets=4)
    assert index.current(spark, root) == first and pinned.count() == 100
    monkeypatch.undo()
    second = index.build(spark, root, *dumps(tmp_path, 60), buckets=4)
    assert index.current(spark, root) == second and second.rows["titles"] == 120
    # a reader of the version before keeps it; one of another number is not current
    assert pinned.count() == 100
    monkeypatch.setattr(index, "INDEX_VERSION", 99)
    assert index.current(spark, root) is None


def test_lookups_move_the_asked_side_only(spark, tmp_path):
    found = index.build(spark, f"file://{tmp_path}/index", *dumps(tmp_path, 50), buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = spark.createDataFrame([("title 3",), ("original 7",), ("no such",)], "key string").repartition(3)
        met = asked.join(found.table(spark, "titles"), "key", "left")
        plan = met._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scan = plan[plan.rindex("BucketedScan") if "BucketedScan" in plan else plan.index("Bucketed: true") :]
    assert "Bucketed: true" in plan and plan.count("hashpartitioning(key") == 1, plan
    assert scan and sorted((r.key, r.tconst) for r in met.collect() if r.tconst) == [("original 7", "tt7"), ("title 3", "tt3"), ("title 3", "tt43")]


def test_validated_books_go_on_in_further_sheets(spark, tmp_path, monkeypatch):
    """More rows, and more issues, than a sheet can hold are all there; before, that was an error."""
    monkeypatch.setattr(books, "SHEET_ROWS", 40)
    cells = spark.createDataFrame([("Up", i, [f"t{i}", "x"]) for i in range(1, 101)], "sheet string, row_no int, cells array<string>")
    headers = spark.createDataFrame([("Up", ["title", "genre"])], "sheet string, headers array<string>")
    told = [("Up", i, n, "title" if n else "genre") for i in range(2, 101) for n in range(i % 4)]
    issues = spark.createDataFrame([(s, i, n, "Some rule", c, "error", "v", f"m{i}.{n}", "") for s, i, n, c in told], "sheet string, row_no int, issue_no int, rule string, column string, level string, value string, message string, suggestion string")
    path = str(tmp_path / "out.xlsx")
    summaries = books.write_validated(cells, headers, issues, path)
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and workbook.sheet_names(z) == ["Up", "Up (2)", "Up (3)", *summaries]
        rows = [r for n in ("Up", "Up (2)", "Up (3)") for r in workbook.sheet_rows(z, n)]
        parts = [list(workbook.sheet_rows(z, n)) for n in summaries]
        notes = [z.read(f"xl/comments{i}.xml").decode() for i in (1, 2, 3)]
    assert [c[0] for _, c in rows] == [f"t{i}" for i in range(1, 101)] and [n for n, _ in rows] == [(i - 1) % 40 + 1 for i in range(1, 101)]
    assert len(summaries) == 4 and all(p[0][1] == books.SUMMARY_COLUMNS and len(p) <= 41 for p in parts)
    assert [(c[1], c[5]) for p in parts for _, c in p[1:]] == [(str(i), f"m{i}.{n}") for _, i, n, _ in told]
    assert 'ref="B1"' in notes[1] and 'ref="A42"' not in notes[1] and sum(n.count("<comment ") for n in notes) == len({(i, c) for _, i, _, c in told})
