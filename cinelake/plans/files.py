"""Queries over files that are written from the tables and read back: dumps and their index, uploaded sheets, workbooks, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinelake.functions.text import title_key
from cinelake.operators import validate
from cinelake.plans.pages import _of
from cinelake.plans.registry import _BROKEN_SHEET, _BROKEN_SQL, KEY, Table, _broken_sheet, query
from cinelake.sources import books, index, landed, sinks, tsv, workbook
from cinelake.sources.scratch import scratch_path, written

_TYPES = "list_value('movie', 'tvSeries', 'tvMiniSeries', 'short', 'tvMovie')[p_partkey % 5 + 1]"
_TITLES = f"""select 'tt' || p_partkey as tconst, {_TYPES} as title_type, p_name as primary_title, case when p_partkey % 3 = 0 then '' else p_name || ' & Co (uncut)' end as original_title,
cast(1950 + p_size as varchar) as start_year, case when p_partkey % 4 = 0 then '' else p_brand end as genres, p_partkey % 7 = 0 as adult from part"""


def _dump(df: DataFrame, tag: str) -> str:
    """A dump's gzip files: a header each, no quotes, \\N for null."""
    path = scratch_path(df.sparkSession, tag)
    df.write.option("quote", "").csv(path, sep="\t", header=True, nullValue="\\N", emptyValue="", compression="gzip")
    return path


def _title_dump(t: Table) -> str:
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, ["movie", "tvSeries", "tvMiniSeries", "short", "tvMovie"])), (k % 5 + 1).cast("int"))
    values = {
        "tconst": _of("tt", k), "titleType": kind, "primaryTitle": F.col("p_name"), "originalTitle": F.when(k % 3 != 0, F.concat("p_name", F.lit(" & Co (uncut)"))), "isAdult": F.when(k % 7 == 0, "1").otherwise("0"),
        "startYear": (F.col("p_size") + 1950).cast("string"), "endYear": F.lit(None).cast("string"), "runtimeMinutes": F.lit(None).cast("string"), "genres": F.when(k % 4 != 0, F.col("p_brand")),
    }
    return _dump(t("part").select(*(values[c].alias(c) for c in tsv.TITLE_COLUMNS)), "titles")


def _name_dump(t: Table) -> str:
    k = F.col("c_custkey")
    values = {"nconst": _of("nm", k), "primaryName": F.when(k % 10 != 0, F.col("c_name")), "birthYear": (k % 60 + 1940).cast("string"), "deathYear": F.lit(None).cast("string"), "primaryProfession": F.lit("actor,producer"), "knownForTitles": _of("tt", k)}
    return _dump(t("customer").select(*(values[c].alias(c) for c in tsv.NAME_COLUMNS)), "names")


def _episode_dump(t: Table) -> str:
    values = {"tconst": _of("e", F.col("l_orderkey"), "_", F.col("l_linenumber")), "parentTconst": _of("tt", F.col("l_partkey")), "seasonNumber": F.col("l_linenumber").cast("string"), "episodeNumber": F.col("l_suppkey").cast("string")}
    return _dump(t("lineitem").select(*(values[c].alias(c) for c in tsv.EPISODE_COLUMNS)), "episodes")


@query(f"""with t as ({_TITLES}) select tconst, title_type, primary_title, original_title, start_year, '' as end_year, genres, {KEY.format('primary_title')} as normalized_primary, {KEY.format('original_title')} as normalized_original
from t where title_type <> 'short' and not adult""")
def title_dump(t: Table) -> DataFrame:
    return tsv.titles(t("part").sparkSession, _title_dump(t))


@query(f"select 'nm' || c_custkey as nconst, c_name as primary_name, cast(1940 + c_custkey % 60 as varchar) as birth_year, {KEY.format('c_name')} as normalized_name from customer where c_custkey % 10 <> 0")
def name_dump(t: Table) -> DataFrame:
    return tsv.names(t("customer").sparkSession, _name_dump(t)).select("nconst", "primary_name", "birth_year", "normalized_name")


@query(f"""with t as ({_TITLES}), kept as (select * from t where title_type <> 'short' and not adult),
keyed as (select tconst, start_year, unnest(list_distinct(list_filter([{KEY.format('primary_title')}, {KEY.format('original_title')}], lambda x: x <> ''))) as key from kept),
asked as (select distinct {KEY.format('p_name')} as key from part union select 'no such ' || n_name from nation),
shows as (select 'tt' || l_partkey as tconst, count(*) as n from lineitem join kept on kept.tconst = 'tt' || l_partkey and title_type in ('tvSeries', 'tvMiniSeries') group by 1)
select key, k.tconst, k.start_year, s.n as n_episodes from asked left join keyed k using (key) left join shows s on s.tconst = k.tconst""")
def index_lookup(t: Table) -> DataFrame:
    """The index is built from dumps; asked titles meet its bucketed tables."""
    spark = t("part").sparkSession
    root = scratch_path(spark, "index")
    index.build(spark, root, _title_dump(t), _name_dump(t), _episode_dump(t), buckets=16)
    found = index.current(spark, root)
    asked = t("part").select(title_key("p_name").alias("key")).union(t("nation").select(_of("no such ", F.col("n_name")))).distinct()
    counts = found.table(spark, "episodes").groupBy(F.col("parent").alias("tconst")).agg(F.count("*").alias("n_episodes"))
    return asked.join(found.table(spark, "titles"), "key", "left").join(counts, "tconst", "left").select("key", "tconst", "start_year", "n_episodes")


@query("select s_nationkey as nation, count(*) as n_rows from supplier group by 1")
def uploaded_headers(t: Table) -> DataFrame:
    """Rows under the header of each uploaded sheet, a file a nation."""
    spark = t("supplier").sparkSession
    path = scratch_path(spark, "sheets")
    line = F.array_join(F.array_sort(F.collect_list(F.struct("s_suppkey", _of('"', F.col("s_name"), '","Movies, x"').alias("line"))))["line"], "\n")
    sheets = t("supplier").groupBy("s_nationkey").agg(line.alias("body"))
    text = _of("﻿Report,,\n,,\nTitle_Name, Category\n", F.col("body"), "\n,\n")
    sheets.select("s_nationkey", text.alias("value")).repartition("s_nationkey").write.partitionBy("s_nationkey").text(path)
    cells = workbook.read_cells(spark, f"{path}/*/*.txt")
    rows = workbook.parsed_rows(cells)
    nation = F.regexp_extract("path", r"s_nationkey=(\d+)", 1).cast("int")
    return rows.filter(F.try_element_at("values", F.lit("title name")).isNotNull()).groupBy(nation.alias("nation")).agg(F.count("*").alias("n_rows"))


@query("select r_name as sheet, cast(row_number() over (partition by r_name order by c_custkey) + 1 as int) as row_no, c_name as name, cast(c_custkey as varchar) as id from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey")
def landed_workbook(t: Table) -> DataFrame:
    """A workbook with a sheet a region, written by tasks and read as a data source, a partition a sheet."""
    spark = t("customer").sparkSession
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    rows = written(t("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("r_name", "c_name", "c_custkey"), "customers")
    names = [r.r_name for r in rows.select("r_name").distinct().orderBy("r_name").collect()]  # the sheets of one workbook
    path = scratch_path(spark, "books") + ".xlsx"
    books.write_book(spark, path, [books.table_sheet(rows.filter(F.col("r_name") == n), ["c_name", "c_custkey"], ["c_custkey"], n, [30, 12]) for n in names])
    landed.register(spark)
    read = spark.read.format("landed").schema("_sheet string, _row_no int, c_name string, c_custkey string").load(path)
    return read.select(F.col("_sheet").alias("sheet"), F.col("_row_no").alias("row_no"), F.col("c_name").alias("name"), F.col("c_custkey").alias("id"))


_LETTERS = "chr(cast(64 + list_position([" + ", ".join(f"'{c}'" for c in _BROKEN_SHEET) + "], \"column\") as int))"


@query(_BROKEN_SQL + f"""select 'customers' as sheet, cast(row_no + 2 as varchar) as row_no, case when "column" = 'youtube_channel_company' then "column" else {_LETTERS} end as letter, case when "column" = 'youtube_channel_company' then '' else {_LETTERS} || (row_no + 2) end as cell,
case when rule in ('Title required', 'Approved category', 'Sub-category required') then 'not_blank_and_not_in' when rule = 'Talent sub-category' then 'talent_subcategory_format' else trim(regexp_replace(lower(rule), '[^a-z0-9]+', '_', 'g'), '_') end as rule from issues""")
def validated_workbook(t: Table) -> DataFrame:
    """The summary of the validated workbook, read from the sheets that it takes."""
    spark = t("customer").sparkSession
    sheet = _broken_sheet(t).withColumn("row_no", F.col("row_no") + 2)
    issues = written(validate.report(sheet), "issues")
    columns = [*_BROKEN_SHEET]
    head = t("region").limit(1).select(F.lit("customers").alias("sheet"), F.lit(1).alias("row_no"), F.array(*map(F.lit, columns)).alias("cells"))
    cells = written(head.unionByName(sheet.select("sheet", "row_no", F.array(*columns).alias("cells"))), "cells")
    headers = head.select("sheet", F.transform("cells", lambda c: F.replace(c, F.lit("_"), F.lit(" "))).alias("headers"))
    path = scratch_path(spark, "validated") + ".xlsx"
    summaries = books.write_validated(cells, headers, issues, path)
    landed.register(spark)
    kept = spark.read.format("landed").load(path).filter(F.col("sheet").isin(summaries) & (F.col("row_no") > 1)).select("cells")
    return kept.select(*(F.col("cells")[i].alias(n) for i, n in enumerate(["sheet", "row_no", "letter", "cell", "rule"])))


@query("""select '"' || s_name || '","' || replace(s_name, '#', '""') || '","","' || s_nationkey || '"' as line from supplier""")
def client_csv(t: Table) -> DataFrame:
    """Lines below the header of an export in which every cell is quoted, a declared column that the rows lack is empty and quotes are doubled."""
    spark = t("supplier").sparkSession
    path = scratch_path(spark, "client")
    rows = t("supplier").select(F.col("s_name").alias("Title"), F.replace("s_name", F.lit("#"), F.lit('"')).alias("Said"), F.col("s_nationkey").alias("Nation"))
    sinks.write_csv(rows, path, ["Title", "Said", "Lacking", "Nation"], quote_all=True)
    return spark.read.text(path).select(F.col("value").alias("line")).filter('''line not like '%"Said","Lacking"%' ''')


@query("""select s_suppkey, '{"title":"' || s_name || '","genres":["Drama"],"note":null}' as json from supplier""")
def json_payload(t: Table) -> DataFrame:
    rows = t("supplier").select("s_suppkey", F.col("s_name").alias("title"), F.array(F.lit("Drama")).alias("genres"), F.lit(None).cast("string").alias("note"))
    return rows.select("s_suppkey", F.to_json(F.struct("title", "genres", "note"), {"ignoreNullFields": "false"}).alias("json"))
