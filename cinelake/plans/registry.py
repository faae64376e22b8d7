"""Queries on the test tables, each with the SQL that says the same; tables stand in for titles, seasons, schedules and runs."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinelake.functions import classify, dates, scoring, text
from cinelake.operators import bands, candidates, changes, dedupe, facets, history, ingest, resolve, rollup, validate
from cinelake.operators.numbering import running_totals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

Table = Callable[[str], DataFrame]


def query(sql: str | None = None):
    """Registers a function of a table reader under its own name, with its SQL if there is one."""

    def register(f: Callable[[Table], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# SQL pieces: the same keys and scores in the other dialect.
KEY = r"trim(regexp_replace(regexp_replace(replace(lower(trim(regexp_replace({0}, '\s+', ' ', 'g'))), '&', ' and '), '\[[^\]]+\]|\([^)]*\)', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"
SCORE = (
    "case when {0} = '' or {1} = '' then 0 when {0} = {1} then 70 when contains({0}, {1}) or contains({1}, {0}) then 45 "
    "else cast(trunc(len(list_intersect(list_distinct(string_split({0}, ' ')), list_distinct(string_split({1}, ' ')))) "
    "/ greatest(len(list_distinct(string_split({0}, ' '))), len(list_distinct(string_split({1}, ' ')))) * 40) as int) end"
)
PREFERRED = ["PROMO", "STANDARD", "SMALL"]


def _catalogue(t: Table) -> DataFrame:
    return t("part").select(F.col("p_partkey").alias("code"), text.title_key("p_name").alias("key"), "p_type", (F.col("p_size") + 1960).alias("year"))


def _verified(t: Table) -> DataFrame:
    parts = t("part")
    asked = parts.select("p_name", (F.col("p_partkey") % 7 + 1990).alias("wanted")).distinct().withColumn("key", text.title_key("p_name"))
    kinds = parts.select("p_type").distinct()
    preferred = kinds.agg(F.sort_array(F.collect_set("p_type")).alias("preferred"))  # six values
    probes = asked.crossJoin(F.broadcast(preferred))
    zero = F.lit("")
    best = resolve.best_match(
        probes, resolve.first_alike(_catalogue(t), ["key", "p_type", "year"], "code"), ["key"], ["p_name", "wanted"],
        lambda: scoring.lookup_score(F.col("p_type"), F.col("preferred"), F.col("key"), zero, F.col("key"), F.col("year").cast("int"), F.col("wanted").cast("int")), "code", keep=["code"],
    )
    given = F.when(F.col("wanted") % 3 == 0, "").when(F.col("wanted") % 3 == 1, F.col("code").cast("string")).otherwise("0")
    return best.withColumn("provided", given).withColumn("status", text_status("provided", "code"))


def text_status(provided: str, code: str):
    return resolve.code_status(provided, F.col(code).cast("string"))


_VERIFIED = f"""
with kinds as (select list_sort(list(distinct p_type)) as preferred from part),
asked as (select distinct p_name, p_partkey % 7 + 1990 as wanted from part),
scored as (
  select a.p_name, a.wanted, c.p_partkey as code,
    case when list_position(k.preferred, c.p_type) > 0 then 81 - list_position(k.preferred, c.p_type) else 0 end + 20
    + case when abs(c.p_size + 1960 - a.wanted) = 0 then 50 when abs(c.p_size + 1960 - a.wanted) = 1 then 15 else 0 end as score
  from asked a join part c on {KEY.format('a.p_name')} = {KEY.format('c.p_name')}, kinds k),
best as (select *, row_number() over (partition by p_name, wanted order by score desc, code) as r from scored),
given as (select p_name, wanted, code, score, case when wanted % 3 = 0 then '' when wanted % 3 = 1 then cast(code as varchar) else '0' end as provided from best where r = 1),
verified as (select *, case when code is null then 'No match' when provided <> '' and provided <> cast(code as varchar) then 'Code mismatch' else 'Matched' end as status from given)
"""


@query(_VERIFIED + "select p_name, wanted, code, score, provided, status from verified")
def verify_bulk(t: Table) -> DataFrame:
    return _verified(t)


@query(_VERIFIED + "select count(*) filter (status = 'Matched') as matched, count(*) filter (status = 'Code mismatch') as code_mismatch, count(*) filter (status = 'No match') as no_match from verified")
def verify_status_counts(t: Table) -> DataFrame:
    return rollup.status_counts(_verified(t), "status", ["Matched", "Code mismatch", "No match"])


@query(f"select s_suppkey as id, {KEY.format('s_name')} as key from supplier union all select c_custkey, {KEY.format('c_name')} from customer")
def normalize_title_key(t: Table) -> DataFrame:
    return t("supplier").select(F.col("s_suppkey").alias("id"), text.title_key("s_name").alias("key")).union(t("customer").select("c_custkey", text.title_key("c_name")))


@query("select p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) as name_key, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) as brand_key from part")
def box_office_key(t: Table) -> DataFrame:
    return t("part").select("p_partkey", text.box_office_key("p_name").alias("name_key"), text.box_office_key("p_brand").alias("brand_key"))


START, END = dt.date(1995, 1, 1), dt.date(1995, 12, 31)


@query(f"select o_orderkey, o_orderdate from orders where cast(o_orderdate as date) between date '{START}' and date '{END}'")
def date_window(t: Table) -> DataFrame:
    return t("orders").filter(dates.in_window(F.to_date("o_orderdate"), START, END)).select("o_orderkey", "o_orderdate")


@query(f"""with w as (select o_orderkey, cast(o_orderdate as date) as day from orders where cast(o_orderdate as date) between date '{START}' and date '{END}')
select o_orderkey, day, 'yearly' as section from w union all select o_orderkey, day, 'daily' from w where day = date '1995-06-01'""")
def daily_and_window_sections(t: Table) -> DataFrame:
    rows = t("orders").select("o_orderkey", F.to_date("o_orderdate").alias("day")).filter(dates.in_window("day", START, END))
    return history.with_sections(rows, dt.date(1995, 6, 1), "day")


@query("select min(doc_id) as doc_id, lang, lower(text) as start, count(*) as copies from documents where text is not null and text <> '' group by lang, lower(text)")
def dedupe_keep_first(t: Table) -> DataFrame:
    """Of each language the first document with a text, told by whole texts, and how many have it."""
    rows = t("documents").select("doc_id", "lang", F.lower("text").alias("start"))
    return dedupe.first_of_texts(rows, ["lang"], "start", "doc_id", ["doc_id"], "copies")


_LINE_ORDER = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query(f"select l_orderkey, l_linenumber, l_partkey, l_extendedprice from (select *, row_number() over (partition by l_orderkey, l_linenumber order by {', '.join(c + ' desc' for c in _LINE_ORDER)}) as r from lineitem) where r = 1")
def dedupe_keep_last(t: Table) -> DataFrame:
    return dedupe.keep_last(t("lineitem"), ["l_orderkey", "l_linenumber"], _LINE_ORDER).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


def _episodes(t: Table) -> DataFrame:
    return t("lineitem").select(F.col("l_orderkey").alias("parent"), F.col("l_linenumber").cast("string").alias("season"), F.col("l_partkey").cast("string").alias("episode"))


_LATEST = "latest as (select l_orderkey as parent, l_linenumber as season, count(distinct l_partkey) as n_episodes from lineitem join (select l_orderkey as k, max(l_linenumber) as m from lineitem group by 1) on k = l_orderkey and m = l_linenumber group by 1, 2)"


@query(f"with {_LATEST} select parent, season, n_episodes from latest")
def latest_group_rollup(t: Table) -> DataFrame:
    return rollup.latest_season(_episodes(t), "parent", "season", "episode")


@query("select l_orderkey as parent, count(*) as n_episodes, count(distinct l_linenumber) as n_seasons from lineitem group by 1")
def series_totals(t: Table) -> DataFrame:
    return rollup.series_totals(_episodes(t), "parent", "season")


@query("select l_orderkey as parent, cast(l_linenumber as varchar) as season, count(distinct l_partkey) as n_episodes from lineitem group by 1, 2")
def season_counts(t: Table) -> DataFrame:
    return rollup.season_counts(_episodes(t), "parent", "season", "episode")


@query(f"""with {_LATEST}, own as (select l_orderkey as parent, l_linenumber as season, count(distinct l_partkey) as n from lineitem group by 1, 2)
select o_orderkey as parent, o_orderkey % 7 + 1 as preferred, case when own.n is not null then o_orderkey % 7 + 1 else latest.season end as season, coalesce(own.n, latest.n_episodes, 0) as n_episodes
from orders left join own on own.parent = o_orderkey and own.season = o_orderkey % 7 + 1 left join latest on latest.parent = o_orderkey""")
def preferred_or_latest(t: Table) -> DataFrame:
    wanted = t("orders").select(F.col("o_orderkey").alias("parent"), (F.col("o_orderkey") % 7 + 1).alias("preferred"))
    return rollup.preferred_or_latest(wanted, _episodes(t), "parent", "season", "episode", "preferred")


@query("""select o_orderkey, cast(o_orderdate as date) as start, case when n = 1 then cast(o_orderdate as date) + 30 when n > 1 then last else null end as season_end
from orders left join (select l_orderkey, count(distinct cast(l_shipdate as date)) as n, max(cast(l_shipdate as date)) as last from lineitem group by 1) on l_orderkey = o_orderkey""")
def season_end_date(t: Table) -> DataFrame:
    shipped = t("lineitem").groupBy("l_orderkey").agg(F.collect_set(F.to_date("l_shipdate")).alias("days"))
    rows = t("orders").select("o_orderkey", F.to_date("o_orderdate").alias("start")).join(shipped, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select("o_orderkey", "start", dates.season_end("start", F.coalesce("days", F.array().cast("array<date>"))).alias("season_end"))


@query("select o_orderkey, cast(o_orderdate as date) + cast(7 - isodow(o_orderdate) as int) as sunday from orders")
def opening_weekend(t: Table) -> DataFrame:
    return t("orders").select("o_orderkey", dates.opening_sunday(F.to_date("o_orderdate")).alias("sunday"))


@query("""with spent as (select o_custkey, sum(o_totalprice) as total from orders group by 1), ranked as (select o_custkey, rank() over (order by cast(round(total * 100) as bigint) desc) as rank from spent),
segments as (select c_mktsegment, min(rank) as rank from ranked join customer on c_custkey = o_custkey group by 1)
select c_custkey, c_mktsegment, coalesce(r.rank, s.rank) as rank from customer left join ranked r on r.o_custkey = c_custkey left join segments s using (c_mktsegment)""")
def weekend_rank_lookup(t: Table) -> DataFrame:
    # rank over all customers: pre-aggregated, and as many rows as customers
    spent = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice") * 100).cast("long").alias("cents"))
    tied = spent.groupBy("cents").agg(F.count("*").alias("n"))
    ranks = running_totals(tied, "cents", "n", "above", descending=True).select("cents", (F.col("above") + 1).cast("int").alias("rank"))
    ranked = spent.join(ranks, "cents").select("c_custkey", "rank")
    customers = t("customer").select("c_custkey", "c_mktsegment")
    segments = ranked.join(customers, "c_custkey").groupBy("c_mktsegment").agg(F.min("rank").alias("rank"))
    return resolve.lookup_with_fallback(customers, ranked, segments, "c_custkey", "c_mktsegment", "rank").select("c_custkey", "c_mktsegment", "rank")


@query("""select o_orderkey, cast(o_orderdate as date) as old_date, s as new_date,
case when date_diff('day', cast(o_orderdate as date), s) = 0 then 'No change' else 'Moved ' || case when s > cast(o_orderdate as date) then 'later' else 'earlier' end || ' by ' || abs(date_diff('day', cast(o_orderdate as date), s))
 || case when abs(date_diff('day', cast(o_orderdate as date), s)) = 1 then ' day' else ' days' end end as change
from orders join (select l_orderkey, min(cast(l_shipdate as date)) as s from lineitem group by 1) on l_orderkey = o_orderkey""")
def release_changes(t: Table) -> DataFrame:
    first = t("lineitem").groupBy("l_orderkey").agg(F.min(F.to_date("l_shipdate")).alias("new_date"))
    rows = t("orders").select("o_orderkey", F.to_date("o_orderdate").alias("old_date")).join(first, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select("o_orderkey", "old_date", "new_date", dates.change_label("old_date", "new_date").alias("change"))


@query("""with cur as (select distinct 'Release ' || o_orderkey as title, strftime(o_orderdate, '%Y-%m-%d') as new_date, case when o_orderkey % 3 = 0 then 'Wide' else 'Limited' end as new_scale, o_orderkey as k from orders),
prev as (select l_orderkey as k, l_linenumber as o, strftime(l_shipdate, '%Y-%m-%d') as d, case when l_linenumber % 2 = 0 then 'Limited' else 'Wide' end as s from lineitem),
moved as (select k, new_date, arg_min(struct_pack(d := d, s := s), (o, d, s)) as m from cur join prev using (k) where d <> new_date group by 1, 2),
lim as (select k, arg_min(struct_pack(d := d, s := s), (o, d, s)) as l from prev where s = 'Limited' group by 1),
j as (select cur.*, m, case when new_scale = 'Wide' then l end as l from cur left join moved using (k, new_date) left join lim using (k)),
x as (select *, case when l is not null and l.d <> new_date then l.d else m.d end as old from j where m is not null or l is not null)
select title, coalesce(old, new_date) as old_date, new_date, coalesce(l.s, m.s) as old_scale, new_scale,
concat_ws(' + ', case when old <> new_date then 'Date change' end, case when l is not null then 'Limited → Wide expansion' end) as change_type from x""")
def schedule_diff(t: Table) -> DataFrame:
    current = t("orders").select(F.concat(F.lit("Release "), "o_orderkey").alias("title"), F.lit("").alias("url"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("release_date"), F.when(F.col("o_orderkey") % 3 == 0, "Wide").otherwise("Limited").alias("scale"))
    previous = t("lineitem").select(F.concat(F.lit("Release "), "l_orderkey").alias("title"), F.lit("").alias("url"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("release_date"), F.when(F.col("l_linenumber") % 2 == 0, "Limited").otherwise("Wide").alias("scale"), F.col("l_linenumber").alias("snapshot_order"))
    return changes.release_changes(current, previous).select("title", "old_date", "new_date", "old_scale", "new_scale", "change_type")


@query("""with f as (select n_name, count(*) as n, min(o_orderkey) as first from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey group by 1)
select n_name as distributor, n, row_number() over (order by n desc, first) as rank from f qualify rank <= 12""")
def top12_distributors(t: Table) -> DataFrame:
    named = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation").select("n_nationkey", "n_name"), F.col("n_nationkey") == F.col("c_nationkey"))
    return rollup.top_counts(named, "n_name", ["o_orderkey"], 12, "distributor").select("distributor", "n", "rank")


@query("select coalesce(nullif(p_type, ''), 'Unknown') as scale, count(*) as n from part group by 1")
def scale_counts(t: Table) -> DataFrame:
    return rollup.tally(t("part"), "p_type", "scale")


@query("select p_partkey, p_name, p_type from part where contains(lower(concat_ws(' ', p_name, p_brand)), 'widget') and p_type = (select min(p_type) from part) and list_contains(string_split(p_name, ' '), 'red')")
def facet_filter(t: Table) -> DataFrame:
    parts = t("part").withColumn("words", F.split("p_name", " "))
    kind = parts.agg(F.min("p_type")).first()[0]
    return facets.facet_filter(parts, "Widget", ["p_name", "p_brand"], {"words": "red"}, {"p_type": kind, "p_brand": ""}).select("p_partkey", "p_name", "p_type")


@query("select distinct unnest(string_split(p_name, ' ')) as value from part")
def facet_values(t: Table) -> DataFrame:
    return facets.facet_values(t("part").withColumn("words", F.split("p_name", " ")), "words")


@query("select 'p_type' as facet, p_type as value, count(*) as n from part group by 2 union all select 'p_size', cast(p_size as varchar), count(*) from part group by 2")
def facet_counts(t: Table) -> DataFrame:
    return facets.facet_counts(t("part"), ["p_type", "p_size"])


@query("with m as (select o_custkey, date_trunc('month', min(o_orderdate)) as a, date_trunc('month', max(o_orderdate)) as b from orders group by 1) select o_custkey, cast(unnest(generate_series(a, b, interval 1 month)) as date) as month from m")
def month_starts(t: Table) -> DataFrame:
    spans = t("orders").groupBy("o_custkey").agg(F.min(F.to_date("o_orderdate")).alias("a"), F.max(F.to_date("o_orderdate")).alias("b"))
    return spans.select("o_custkey", F.explode(dates.month_starts("a", "b")).alias("month"))


@query("""with m as (select user_id, cast(min(ts) as date) as a, cast(max(ts) as date) as b from events group by 1),
s as (select user_id, b, list_transform(generate_series(cast(a as timestamp), cast(b as timestamp), interval 7 day), lambda x: cast(x as date)) as days from m),
w as (select user_id, case when days[-1] < b then list_append(days, b) else days end as days from s)
select user_id, unnest(days[1:27]) as week from w""")
def weekly_dates(t: Table) -> DataFrame:
    spans = t("events").groupBy("user_id").agg(F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b"))
    return spans.select("user_id", F.explode(dates.weekly_dates("a", "b")).alias("week"))


def _names(t: Table, alias: str) -> DataFrame:
    return t("part").select(text.title_key("p_name").alias(alias)).distinct()


@query(f"with n as (select distinct {KEY.format('p_name')} as k from part) select x.k as a, y.k as b, {SCORE.format('x.k', 'y.k')} as score from n x, n y")
def title_score_pairs(t: Table) -> DataFrame:
    # every distinct name scored against every distinct name is what this report is
    return _names(t, "a").join(_names(t, "b"), F.lit(True)).select("a", "b", scoring.key_score(F.col("a"), F.col("b")).alias("score"))


@query(f"""with n as (select {KEY.format('p_name')} as k, min(p_partkey) as id, date '2024-01-01' + cast(min(p_partkey) % 40 as int) as day from part group by 1),
s as (select x.k as probe, y.k as match, y.id, {SCORE.format('x.k', 'y.k')} + case when abs(date_diff('day', x.day, y.day)) = 0 then 35 when abs(date_diff('day', x.day, y.day)) <= 14 then 15 else 0 end as score from n x, n y where x.k <> y.k)
select probe, match, score from s where score >= 45 qualify row_number() over (partition by probe order by score desc, id) = 1""")
def fuzzy_best(t: Table) -> DataFrame:
    named = t("part").groupBy(text.title_key("p_name").alias("k")).agg(F.min("p_partkey").alias("id")).withColumn("day", F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") % 40).cast("int")))
    titles = named.withColumnRenamed("k", "key")
    found = candidates.best_titles(titles, titles.withColumn("match", F.col("key")), 45, "id", ["match"], networked=False, may=lambda p, r: p["key"] != r["key"])
    return found.select(F.col("key").alias("probe"), "match", "score")


@query()
def sequence_ratio_best(t: Table) -> DataFrame:
    """Matching-block similarity has no SQL; tests compare it with the standard library's over all pairs."""
    pairs = candidates.similar_pairs(_names(t, "probe"), _names(t, "answer"), 45).filter("probe != answer")
    return pairs.groupBy("probe").agg(F.min_by(F.struct(F.col("answer").alias("match"), "score"), F.struct((-F.col("score")).alias("s"), "answer")).alias("b")).select("probe", "b.match", "b.score")


_BLANKS = ["", "N/A", "#NA", "none", " nan ", "Null"]


@query("""select c_custkey, coalesce(case when not (replace(lower(trim(a)), ' ', '') in ('', '#na', '#n/a', 'n/a', 'na', 'nan', 'none', 'null')) then trim(a) end, case when not (replace(lower(trim(b)), ' ', '') in ('', '#na', '#n/a', 'n/a', 'na', 'nan', 'none', 'null')) then trim(b) end) as value
from (select c_custkey, case when c_custkey % 3 = 0 then c_name else list_extract(['', 'N/A', '#NA', 'none', ' nan ', 'Null'], cast(c_custkey % 6 + 1 as int)) end as a, case when c_custkey % 2 = 0 then c_mktsegment else 'n/a' end as b from customer)""")
def alias_first_nonblank(t: Table) -> DataFrame:
    blank = F.get(F.array(*map(F.lit, _BLANKS)), (F.col("c_custkey") % 6).cast("int"))
    rows = t("customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(blank).alias("a"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("n/a").alias("b"))
    return rows.select("c_custkey", text.first_nonblank("a", "b").alias("value"))


@query("""select c_custkey, v as value, replace(lower(trim(v)), ' ', '') in ('', '#na', '#n/a', 'n/a', 'na', 'nan', 'none', 'null') as blank
from (select c_custkey, list_extract(['', 'N/A', '#NA', 'none', ' nan ', 'Null', 'x', '0 ', 'n a'], cast(c_custkey % 9 + 1 as int)) as v from customer)""")
def blankish_flags(t: Table) -> DataFrame:
    value = F.get(F.array(*map(F.lit, [*_BLANKS, "x", "0 ", "n a"])), (F.col("c_custkey") % 9).cast("int"))
    return t("customer").select("c_custkey", value.alias("value")).withColumn("blank", text.is_blankish("value"))


# A sheet of titles made of customers: every column is a rule of the key.
_SHEET = {
    "title": "case when k % 11 = 0 then 'N/A' when k % 5 = 0 then c_name || ' - DAR' else c_name end",
    "title_category": "case when k % 4 = 0 then 'movies' when k % 4 = 1 then 'TV Shows' when k % 4 = 2 then 'Talent' else c_mktsegment end",
    "title_sub_category": "case when k % 7 = 0 then '' when k % 7 = 1 then 'Female Actor' else 'Actor' end",
    "genre": "case when k % 3 = 0 then '' else 'Drama, Sci-Fi' end",
    "primary_genre": "case when k % 5 = 0 then '' when k % 5 = 1 then 'science fiction' else 'Comedy' end",
    "companies": "case when k % 6 = 0 then 'none' when k % 6 = 1 then 'Pristine Film' else 'Acme' end",
    "brand_set": "case when k % 8 = 0 then '' when k % 8 = 1 then 'Pristine DAR Brands' else 'Competitive View' end",
}


def _sheet(t: Table) -> DataFrame:
    rows = t("customer").withColumn("k", F.col("c_custkey"))
    return rows.select(F.lit("customers").alias("sheet"), F.col("c_custkey").cast("int").alias("row_no"), *(F.expr(e).alias(c) for c, e in _SHEET.items()))


_RULES_SQL = f"""
with raw as (select c_custkey as row_no, c_custkey as k, * from customer), sheet as (select row_no, {', '.join(f'{e} as {c}' for c, e in _SHEET.items())} from raw),
s as (select *, trim(title) in ('N/A', '') as no_title, title like '% - DAR' as dar, case when title_category = 'movies' then 'Movies' when title_category in ('TV Shows', 'Talent') then title_category when lower(title_category) = 'automotive' then 'Automotive' else '' end as cat from sheet),
issues as (
  select row_no, 'Title required' as rule, 'error' as level from s where no_title
  union all select row_no, 'Approved category', 'error' from s where cat = ''
  union all select row_no, 'Sub-category required', 'error' from s where title_sub_category = ''
  union all select row_no, 'Talent sub-category', 'error' from s where cat = 'Talent' and title_sub_category = 'Actor'
  union all select row_no, 'Genre required', 'error' from s where cat in ('Movies', 'TV Shows') and genre = ''
  union all select row_no, 'Primary genre required', 'error' from s where genre <> '' and primary_genre = ''
  union all select row_no, 'Primary genre consistency', 'suggestion' from s where genre <> '' and primary_genre = 'Comedy'
  union all select row_no, 'DAR companies', 'error' from s where dar and companies <> 'Pristine Film'
  union all select row_no, 'Companies required', 'error' from s where not dar and companies = 'none'
  union all select row_no, 'Brand set required', 'error' from s where brand_set = ''
  union all select row_no, 'DAR brand set', 'error' from s where dar and brand_set = 'Competitive View'
  union all select row_no, 'Competitive brand set', 'error' from s where not dar and brand_set = 'Pristine DAR Brands')
"""
_ROW_RULES = [
    "Title required", "Approved category", "Sub-category required", "Talent sub-category", "Genre required", "Primary genre required", "Primary genre consistency",
    "DAR companies", "Companies required", "Brand set required", "DAR brand set", "Competitive brand set",
]


@query(_RULES_SQL + "select row_no, rule, level from issues")
def rule_report(t: Table) -> DataFrame:
    return validate.report(_sheet(t)).filter(F.col("rule").isin(_ROW_RULES)).select("row_no", "rule", "level")


@query(_RULES_SQL + "select rule, count(*) filter (level = 'error') as errors, count(*) filter (level = 'suggestion') as suggestions from issues group by 1")
def issue_counts(t: Table) -> DataFrame:
    return validate.issue_counts(validate.report(_sheet(t)).filter(F.col("rule").isin(_ROW_RULES)), "rule")


_FORMATS = ["yyyy-MM-dd", "dd-MM-yyyy", "MM/dd/yyyy", "yyyy/MM/dd", "yyyyMMdd"]


@query("""select o_orderkey, raw, coalesce(case when regexp_matches(raw, '^\\d{4}-') then try_cast(raw as date) end, case when regexp_matches(raw, '^\\d{8}$') then try_strptime(raw, '%Y%m%d')::date end, try_strptime(raw, '%d-%m-%Y')::date, try_strptime(raw, '%m/%d/%Y')::date, try_strptime(raw, '%d/%m/%Y')::date, try_strptime(raw, '%Y/%m/%d')::date) as day
from (select o_orderkey, case o_orderkey % 5 when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then strftime(o_orderdate, '%d-%m-%Y') when 2 then strftime(o_orderdate, '%m/%d/%Y') when 3 then strftime(o_orderdate, '%Y/%m/%d') else strftime(o_orderdate, '%Y%m%d') end as raw from orders)""".replace("\\\\", "\\"))
def date_ladder(t: Table) -> DataFrame:
    raw = F.when(F.lit(False), "")
    for i, f in enumerate(_FORMATS):
        raw = raw.when(F.col("o_orderkey") % 5 == i, F.date_format("o_orderdate", f))
    return t("orders").select("o_orderkey", raw.alias("raw")).withColumn("day", dates.parse_date("raw"))


@query(r"""select page_id, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) as host, regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1) as path, coalesce(list_extract(list_filter(string_split(regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1), '/'), lambda x: x <> ''), -1), '') as last_segment from pages""")
def url_parts(t: Table) -> DataFrame:
    return t("pages").select("page_id", text.url_host("url").alias("host"), text.url_path("url").alias("path"), text.last_segment("url").alias("last_segment"))


@query(r"""select page_id, trim(regexp_extract(html, '(?i)<title>([^<]*)</title>', 1)) as title, len(regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"', 1)) as n_links, coalesce(regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"', 1)[1], '') as first_link from pages""")
def html_title_links(t: Table) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1))
    return t("pages").select("page_id", F.trim(F.regexp_extract("html", "(?i)<title>([^<]*)</title>", 1)).alias("title"), F.size(links).alias("n_links"), F.coalesce(F.get(links, F.lit(0)), F.lit("")).alias("first_link"))


@query()
def html_lines(t: Table) -> DataFrame:
    """Visible lines of pages come from an HTML parser; a test compares them with hand-made pages."""
    from cinelake.sources import html

    return html.lines(t("pages"), "page_id", "html")


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def json_walk(t: Table) -> DataFrame:
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def _carried(t: Table) -> DataFrame:
    from cinelake.sources import html

    opened = html.carry_forward(t("conversations"), ["conv_id"], "turn", F.when(F.col("role") == "user", F.col("text")), "heading")
    items = html.item_numbers(opened, ["conv_id"], "turn", F.col("role") == "user", "item")
    return items.select("conv_id", "turn", "role", "heading", "item")


@query("""with w as (select conv_id, turn, role, last_value(case when role = 'user' then text end ignore nulls) over (partition by conv_id order by turn rows unbounded preceding) as heading, sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn rows unbounded preceding) as item from conversations)
select conv_id, turn, role, heading, item from w""")
def heading_carry_forward(t: Table) -> DataFrame:
    return _carried(t)


@query("select conv_id, turn, n as next_role from (select conv_id, turn, role, lead(role) over (partition by conv_id order by turn) as n from conversations) where role = 'user' and n = 'assistant'")
def pairwise_lines(t: Table) -> DataFrame:
    ahead = F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    return t("conversations").select("conv_id", "turn", "role", ahead.alias("next_role")).filter("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", "next_role")


@query("select event_id, case when h between 5 and 8 then 'Early Morning' when h between 9 and 15 then 'Daytime' when h between 16 and 18 then 'Early Fringe' when h between 19 and 22 then 'Primetime' else 'Late Night' end as daypart from (select event_id, hour(ts) as h from events)")
def daypart_bucket(t: Table) -> DataFrame:
    return t("events").select("event_id", classify.daypart(F.lower(F.date_format("ts", "h:mm a"))).alias("daypart"))


@query(r"""select l_orderkey, l_linenumber, l_partkey, regexp_extract(s, '\$[0-9,]+(?:\.[0-9]+)?', 0) as money, regexp_extract(s, '(?i)([0-9,]+)\s*theaters?', 1) as theaters, lower(regexp_extract(s, '(?i)tt[0-9]{7,12}', 0)) as code
from (select *, 'Opened to $' || cast(cast(floor(l_extendedprice) as bigint) as varchar) || ' in ' || cast(cast(floor(l_quantity) as int) as varchar) || ' theaters, TT' || lpad(cast(l_partkey as varchar), 7, '0') as s from lineitem)""")
def regex_extractors(t: Table) -> DataFrame:
    s = F.concat(F.lit("Opened to $"), F.floor("l_extendedprice").cast("long").cast("string"), F.lit(" in "), F.floor("l_quantity").cast("int").cast("string"), F.lit(" theaters, TT"), F.lpad(F.col("l_partkey").cast("string"), 7, "0"))
    return t("lineitem").withColumn("s", s).select("l_orderkey", "l_linenumber", "l_partkey", text.money("s").alias("money"), text.theaters("s").alias("theaters"), text.imdb_code("s").alias("code"))


@query("""with b as (select p_partkey, p_name as title, 'Movies' as title_category, case when p_type = 'SMALL' then '' else p_brand end as network from part where p_name <> '')
select p_partkey, 0 as twin, title, title_category, case when lower(network) in ('n/a', 'na', 'unknown', '-', 'tbd') then '' else network end as network, '' as twitter_handle from b union all select p_partkey, 1, title || ' - DAR', title_category, case when lower(network) in ('n/a', 'na', 'unknown', '-', 'tbd') then '' else network end, '' from b""")
def ingest_profile_dar(t: Table) -> DataFrame:
    profile = ingest.Profile("Movies", ["Title Name", "p_name"], {"network": (["Distributor"], ingest.distributor)})
    rows = t("part").select("p_partkey", F.col("p_name").alias("Title Name"), F.when(F.col("p_type") == "SMALL", "").otherwise(F.col("p_brand")).alias("Distributor"))
    return ingest.ingest_rows(rows, profile, "p_partkey")


@query("select event_id, ts from events order by ts desc, event_id desc limit 12")
def recent_runs(t: Table) -> DataFrame:
    return history.recent_runs(t("events").select("event_id", "ts"), 12, "ts", "event_id")


@query("select event_id, ts from (select event_id, ts from events order by event_id desc limit 100) where ts >= (select max(ts) - interval 10 day from events)")
def limit_then_since(t: Table) -> DataFrame:
    since = t("events").agg(F.max("ts") - F.expr("interval 10 days")).first()[0]
    return history.runs_since(t("events").select("event_id", "ts"), since, 100, "ts", "event_id")


@query("select p.p_partkey, coalesce(case when p.p_partkey % 4 = 0 then 'tt' || p.p_partkey end, c.code, '') as code from part p left join (select p_name, 'tt' || min(p_partkey) as code from part where p_size > 10 group by 1) c using (p_name)")
def enrich_existing_code(t: Table) -> DataFrame:
    codes = t("part").filter("p_size > 10").groupBy("p_name").agg(F.concat(F.lit("tt"), F.min("p_partkey")).alias("code"))
    rows = t("part").select("p_partkey", "p_name", F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("tt"), "p_partkey")).alias("own"))
    return resolve.enrich_codes(rows, codes, "p_name", "own").select("p_partkey", "code")


@query("""select s_suppkey, coalesce(case when s_suppkey % 2 = 0 then s_name end, 'other ' || s_name) as name, case when s_suppkey % 3 = 0 then 'tt' || s_suppkey when s_suppkey % 5 = 0 then 'pp' || s_suppkey end as imdb_id,
case when s_suppkey % 2 = 0 then '2024-01-01' else '2025' end as release_date, case when s_suppkey % 2 = 0 then 'day' else 'year' end as precision, 'index + page' as source from supplier""")
def merge_candidates(t: Table) -> DataFrame:
    even, k = F.col("s_suppkey") % 2 == 0, F.col("s_suppkey")
    some = lambda c, v: F.when(c, v)
    primary = F.struct(some(even, F.col("s_name")).alias("name"), some(k % 5 == 0, F.concat(F.lit("pp"), k)).alias("imdb_id"), some(even, F.lit("2024-01-01")).alias("release_date"), F.lit("day").alias("precision"), F.lit("index").alias("source"))
    secondary = F.struct(F.concat(F.lit("other "), "s_name").alias("name"), some(k % 3 == 0, F.concat(F.lit("tt"), k)).alias("imdb_id"), F.lit("2025").alias("release_date"), F.lit("year").alias("precision"), F.lit("page").alias("source"))
    rows = t("supplier").select("s_suppkey", primary.alias("a"), secondary.alias("b"))
    return rows.select("s_suppkey", resolve.merge_candidates(F.col("a"), F.col("b"), ["name", "release_date"]).alias("m")).select("s_suppkey", "m.name", "m.imdb_id", "m.release_date", "m.precision", "m.source")


@query("select l_orderkey, string_agg(p_name || ' (' || p_size || ')', '; ' order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as labels from lineitem join part on p_partkey = l_partkey group by 1")
def known_for_titles(t: Table) -> DataFrame:
    listed = t("lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))), lambda s: s["l_partkey"]).alias("ids"))
    return resolve.known_for(listed, t("part"), "l_orderkey", "ids", "p_partkey", F.concat("p_name", F.lit(" ("), "p_size", F.lit(")")))


@query(f"""with v as (select p_partkey, {KEY.format('p_name')} as k, case p_partkey % 4 when 0 then ' official trailer' when 1 then ' teaser' when 2 then ' official trailer reaction' else ' clip' end as tail, case when p_partkey % 3 = 0 then 'Netflix' else 'Some Uploads' end as channel from part),
s as (select p_partkey, 35 as title_part, case p_partkey % 4 when 0 then 25 when 2 then 25 when 1 then 18 else 0 end as trailer_part, case when channel = 'Netflix' then 45 else 0 end as official_part, case when p_partkey % 4 = 2 then 25 else 0 end as penalty from v),
x as (select *, greatest(0, least(100, title_part + trailer_part + official_part - penalty)) as score from s)
select p_partkey, score, case when score >= 75 and title_part >= 18 and trailer_part >= 12 and official_part >= 25 then 'Confirmed' when score >= 55 and title_part >= 18 and trailer_part >= 10 then 'Review' else 'Not found' end as verdict from x""")
def youtube_score(t: Table) -> DataFrame:
    tail = F.when(F.col("p_partkey") % 4 == 0, " official trailer").when(F.col("p_partkey") % 4 == 1, " teaser").when(F.col("p_partkey") % 4 == 2, " official trailer reaction").otherwise(" clip")
    rows = t("part").select("p_partkey", "p_name", F.lit("Netflix").alias("network"), F.lit("").alias("year"), F.concat("p_name", tail).alias("video"), F.lit("").alias("about"), F.when(F.col("p_partkey") % 3 == 0, "Netflix").otherwise("Some Uploads").alias("channel"), F.lit("").alias("channel_text"))
    parts = scoring.trailer_scores("p_name", "network", "year", "video", "about", "channel", "channel_text")
    return rows.select("p_partkey", parts["score"].alias("score"), parts["verdict"].alias("verdict"))


@query("select c_custkey, case when lower(c_mktsegment) in ('tv', 'tv show', 'tv shows', 'tv series', 'series') then 'TV Shows' else 'Movies' end as category, 'title' as kind from customer")
def category_router(t: Table) -> DataFrame:
    return t("customer").select("c_custkey", classify.title_category("c_mktsegment").alias("category"), classify.input_kind("c_mktsegment", F.lit("")).alias("kind"))


@query("select o_orderkey from orders where exists (select 1 from lineitem join part on p_partkey = l_partkey where l_orderkey = o_orderkey and not regexp_matches(lower(p_name || ' ' || p_type), '\\$|rent/buy|movie|special|promo'))".replace("\\\\", "\\"))
def exclude_semi(t: Table) -> DataFrame:
    eligible = t("part").filter(classify.series_eligible("p_name", "p_type") & ~F.contains(F.lower("p_type"), F.lit("promo"))).select(F.col("p_partkey").alias("l_partkey"))
    kept = t("lineitem").select("l_orderkey", "l_partkey").join(eligible, "l_partkey", "left_semi")
    return t("orders").join(kept.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").select("o_orderkey")


@query(r"""with v as (select p_partkey, list_filter(list_transform(regexp_split_to_array(p_name || case p_partkey % 3 when 0 then ', ' when 1 then ' / ' else ';' end || p_brand || '|' || upper(p_name), '[,;/|]+'), lambda x: trim(x)), lambda x: x <> '') as vs from part)
select p_partkey, array_to_string(list_filter(vs, lambda x, i: list_position(list_transform(vs, lambda y: lower(y)), lower(x)) = i), '; ') as vals from v""")
def multi_value_split(t: Table) -> DataFrame:
    mark = F.when(F.col("p_partkey") % 3 == 0, ", ").when(F.col("p_partkey") % 3 == 1, " / ").otherwise(";")
    raw = F.concat("p_name", mark, "p_brand", F.lit("|"), F.upper("p_name"))
    return t("part").select("p_partkey", F.array_join(text.distinct_by_key(text.split_values(raw)), "; ").alias("vals"))


@query("select o_orderkey, case when year(o_orderdate) >= 2000 then o_orderdate::date end as day, case when year(o_orderdate) >= 2000 then strftime(o_orderdate, '%Y-%m-%d') end as of_iso from orders")
def spelled_dates(t: Table) -> DataFrame:
    """Days of texts that name a year of this century, spelled or in ISO form."""
    from cinelake.sources import box_office

    spelled = F.date_format("o_orderdate", "EEEE, MMMM d, yyyy")
    return t("orders").select("o_orderkey", box_office.spelled_date(spelled).alias("day"), box_office.spelled_date(F.date_format("o_orderdate", "yyyy-MM-dd")).cast("string").alias("of_iso"))


@query("select p_partkey, greatest(p_size, 6) as told, case when p_size % 2 = 0 then 12 else 6 end as of_season from part")
def episode_counts_told(t: Table) -> DataFrame:
    """`six episodes` and a count in digits: the larger one; `12 S2 episodes` counts for season 2 alone."""
    from cinelake.functions import seasons

    said = F.concat(F.lit("six episodes, then "), F.col("p_size").cast("string"), F.lit(" episodes"))
    own = F.concat(F.lit("six episodes; 12 S0"), (F.col("p_size") % 2).cast("string"), F.lit(" episodes"))
    return t("part").select("p_partkey", seasons.told_episodes(said, F.lit(1)).alias("told"), seasons.told_episodes(own, F.lit(0)).alias("of_season"))


@query(
    "select p_partkey, p_name as title, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) as key, "
    "'https://www.metacritic.com/' || case when p_size % 3 = 0 then 'movie' else 'tv' end || '/' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') || '/' as page_url from part"
)
def calendar_titles(t: Table) -> DataFrame:
    """A calendar's titles come clean of score, price mark and trailer, with the key and address that they have."""
    from cinelake.sources import calendars

    written = F.concat(F.lit("tbd ($) "), F.col("p_name"), F.lit(" - Trailer2 and more"))
    kind = F.when(F.col("p_size") % 3 == 0, "Movie").otherwise("TV Series")
    return t("part").select("p_partkey", calendars.clean_title(written).alias("title"), calendars.calendar_key(written).alias("key"), calendars.page_url(written, F.lit(""), kind, F.lit(""), "tv").alias("page_url"))


@query(
    "select o_orderkey, case o_orderkey % 4 when 0 then 'Streaming (Netflix)' when 1 then 'Limited/VOD; IMAX' when 2 then 'RENT/BUY' else 'WIDE; LA/NY' end as availability, "
    "case o_orderkey % 4 when 0 then 'Streaming Movie' when 1 then 'VOD Movie' when 2 then 'VOD Movie' else 'Movie' end as content_format from orders"
)
def availability_terms(t: Table) -> DataFrame:
    from cinelake.sources import calendars

    texts = ["Drama streaming (netflix)", "Drama Limited/VOD and imax", "rent/buy from now", "LA/NY first, then wide"]
    said = F.when(F.lit(False), "")
    for i, x in enumerate(["Drama Streaming (Netflix)", *texts[1:]]):
        said = said.when(F.col("o_orderkey") % 4 == i, F.lit(x))
    found = F.array_join(calendars.availability_values(said), "; ")
    return t("orders").select("o_orderkey", found.alias("availability"), classify.movie_content_format(found).alias("content_format"))


@query()
def page_blocks(t: Table) -> DataFrame:
    """Text, headings, table rows and links of pages in order; hand-made pages test them."""
    from cinelake.sources import blocks

    return blocks.blocks(t("pages")).select("page_id", "pos", "kind", "table_no", "line", F.size("cells").alias("n_cells"), F.size("links").alias("n_links"))


@query(
    "select event_id, greatest(k, 1) as season, 8 as episodes from (select event_id, cast(json_extract(props, '$.k') as int) as k from events) where k is not null"
)
def season_answers(t: Table) -> DataFrame:
    """Season fields of catalogue answers: the preferred season where the answer has it, else its latest."""
    from cinelake.sources import lookups

    wanted = F.get_json_object("props", "$.k").cast("int")
    body = F.concat(F.lit('{"seasons": [{"season_number": 0, "episode_count": 99}, {"season_number": 1, "episode_count": 8}, {"season_number": '), F.greatest(wanted, F.lit(1)).cast("string"), F.lit(', "episode_count": 8}]}'))
    answers = t("events").select("event_id", wanted.alias("wanted"), body.alias("body")).filter("wanted is not null")
    return lookups.season_fields(answers, "wanted").select("event_id", "season", "episodes")




@query("""with f as (select o_custkey, min(cast(o_orderdate as date)) as first_day from orders group by 1)
select o_orderkey, e.user_id, e.day as event_day, abs(cast(o_orderdate as date) - e.day) as days_apart from orders o join (select distinct user_id, cast(ts as date) + cast(-366 * (user_id % 30) as int) as day from events) e
  on o.o_custkey = e.user_id and abs(cast(o_orderdate as date) - e.day) <= 14""")
def near_days(t: Table) -> DataFrame:
    events = t("events").select("user_id", F.date_add(F.to_date("ts"), (F.col("user_id") % 30 * -366).cast("int")).alias("event_day")).distinct()
    orders = t("orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), F.to_date("o_orderdate").alias("day"))
    return bands.near_days(orders, events, "day", "event_day", 14, ["user_id"]).select("o_orderkey", "user_id", "event_day", "days_apart")


@query("""with w as (select c_custkey as window_id, date '1992-01-01' + cast(c_custkey * 7 % 2400 as int) as start_day, date '1992-01-01' + cast(c_custkey * 7 % 2400 + c_custkey % 60 - 5 as int) as end_day from customer where c_custkey % 3 <> 0)
select window_id, o_orderstatus, count(*) as orders, sum(case when o_orderpriority = '1-URGENT' then 1 else 0 end) as urgent from w join orders on cast(o_orderdate as date) between start_day and end_day group by 1, 2""")
def many_windows(t: Table) -> DataFrame:
    c, first = F.col("c_custkey"), F.lit("1992-01-01").cast("date")
    start = (c * 7 % 2400).cast("int")
    windows = t("customer").filter(c % 3 != 0).select(c.alias("window_id"), F.date_add(first, start).alias("start_day"), F.date_add(first, start + (c % 60 - 5).cast("int")).alias("end_day"))
    rows = t("orders").select("o_orderstatus", "o_orderpriority", F.to_date("o_orderdate").alias("day"))
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)
    told = bands.range_sums(rows, windows, "day", "start_day", "end_day", ["o_orderstatus"], {"orders": F.lit(1), "urgent": urgent})
    return told.groupBy("window_id", "o_orderstatus").agg(F.sum("orders").alias("orders"), F.sum("urgent").alias("urgent"))


# A sheet that breaks every rule: each column is a rule of the key, and so is what the lookups found.
_BASE = "case when k % 13 = 0 then '' when k % 13 = 1 then 'N/A' else 'Show ' || k end"
_PREFIX = "case when k % 5 = 4 and k % 2 = 0 then 'nm' else 'tt' end"
_BROKEN_SHEET = {
    "title": f"{_BASE} || case when k % 13 in (1, 2) then ' - DAR' else '' end",
    "title_category": "case k % 5 when 0 then '' when 1 then 'nonsense' when 2 then 'movies' when 3 then 'TV Shows' else case when k % 2 = 0 then 'Talent' else 'Media' end end",
    "title_sub_category": "case when k % 7 = 0 then '' when k % 7 = 1 then 'Actor' else 'Female Actor' end",
    "genre": "case when k % 3 = 0 then '' else 'Drama, Sci-Fi' end",
    "primary_genre": "case when k % 11 = 0 then '' when k % 11 = 1 then 'sci fi' else 'Comedy' end",
    "companies": "case when k % 6 = 0 then 'none' when k % 6 = 1 then 'Pristine Film' else 'Acme' end",
    "brand_set": "case when k % 8 = 0 then '' when k % 8 = 1 then 'Pristine DAR Brands' else 'Competitive View' end",
    "facebook_page": "case k % 9 when 0 then '' when 1 then 'https://x.com/zzz' when 2 then 'https://facebook.com/pages/b' when 3 then 'https://x.com/zzz; https://www.facebook.com/p/b' else 'https://www.facebook.com/ok' end",
    "imdb_id": f"case k % 10 when 0 then '' when 1 then 'bad' when 2 then '' else {_PREFIX} || '1234567' end",
    "imdb_url": f"case k % 10 when 0 then '' when 1 then '' when 2 then 'https://www.imdb.com/x' when 3 then 'https://www.imdb.com/t/' || {_PREFIX} || '7654321/' when 4 then '' else 'https://www.imdb.com/t/' || {_PREFIX} || '1234567/' end",
    "metacritic_url": "case k % 6 when 0 then '' when 1 then 'https://example.com/movie/a' when 2 then 'https://www.metacritic.com/browse' when 3 then 'https://www.metacritic.com/movie/other-thing' else 'https://www.metacritic.com/' || case when k % 5 = 2 then 'movie' else 'tv' end || '/show-' || k || '/' end",
    "twitter_search_terms": "case when k % 4 = 1 then '' else 'terms' end",
    "twitter_search_term_keywords": "case when k % 4 = 2 then 'N/A' else 'words' end",
    "youtube_url": "case k % 7 when 1 then 'not an address' when 2 then 'https://www.youtube.com/@a' when 3 then 'https://www.youtube.com/@a|Show ' || k else '' end",
    "youtube_channel_username": "case when k % 8 = 3 then 'a%20b' else 'ab' end",
    "wikipedia_url": "case k % 12 when 1 then 'wiki/Dune' when 2 then 'https://fr.wikipedia.org/wiki/A' when 3 then 'https://en.wikipedia.org/w/x' when 4 then 'https://en.wikipedia.org/wiki/Show_' || k when 5 then 'https://en.wikipedia.org/wiki/Show_' || k when 6 then 'https://en.wikipedia.org/wiki/Something_else' when 7 then 'https://en.wikipedia.org/wiki/Show_' || k || '_(film)' else '' end",
    "url_managers": "case k % 3 when 0 then 'Acme; Pristine Film; facebook.com/ok; x.com/zzz; facebook.com/pages/b; facebook.com/p/b' when 1 then 'Acme' else '' end",
    "release_date": "case k % 10 when 0 then '2025-05-01' when 2 then '2026-03-03' when 3 then '2026-03-04' when 5 then '2026-03-03' else '' end",
    "network": "case k % 4 when 0 then 'Hulu' when 2 then 'Netflix US' else '' end",
}
_FOUND = {
    "found_imdb": "case when k % 3 = 0 then null when k % 2 = 0 then 'tt9999999' else 'tt1234567' end",
    "found_name": "case when k % 3 = 0 then null when k % 4 = 0 then 'nm9999999' else 'nm1234567' end",
    "found_network": "case when k % 4 = 3 then '' else 'Netflix' end",
    "found_date": "case when k % 10 < 3 then date '2026-01-01' when k % 10 < 6 then date '2026-03-03' end",
    "found_precision": "case when k % 10 < 3 then 'year' when k % 10 < 6 then 'date' else '' end",
    "found_wikipedia": "case k % 12 when 4 then 'https://en.wikipedia.org/wiki/Other' when 5 then 'https://en.wikipedia.org/wiki/show_' || k end",
}


def _broken_sheet(t: Table) -> DataFrame:
    rows = t("customer").withColumn("k", F.col("c_custkey"))
    check = lambda *states: F.array(*(F.struct(F.lit(f"c{i}").alias("value"), F.lit(s).alias("state"), F.lit("note").alias("note")) for i, s in enumerate(states)))
    return rows.select(
        F.lit("customers").alias("sheet"), F.col("k").cast("int").alias("row_no"), *(F.expr(e).alias(c) for c, e in (_BROKEN_SHEET | _FOUND).items()),
        F.when(F.col("k") % 4 == 0, F.array(F.lit("Drama"), F.lit("Comedy"))).when(F.col("k") % 4 == 1, F.array(F.lit("Science Fiction"))).alias("found_genres"),
        (F.col("k") % 12 != 7).alias("wikipedia_exists"), F.when(F.col("k") % 9 == 4, check("valid", "failed")).when(F.col("k") % 9 == 5, check("missing", "valid", "missing")).alias("channel_checks"),
    )


def _rule(name: str, level: str, when: str, rule_column: str) -> str:
    return f"select k as row_no, '{name}' as rule, '{level}' as level, '{rule_column}' as \"column\" from b where {when}"


# (rule, level, column of the issue, when it fires)
_BROKEN_RULES = [
    ("Title required", "error", "title", "k % 13 = 0"), ("DAR title required", "error", "title", "k % 13 = 1"), ("Approved category", "error", "title_category", "k % 5 < 2"),
    ("Sub-category required", "error", "title_sub_category", "k % 7 = 0"), ("Talent sub-category", "error", "title_sub_category", "talent and k % 7 = 1"),
    ("Genre required", "error", "genre", "k % 5 >= 2 and not talent and k % 3 = 0"), ("Genre completeness", "suggestion", "genre", "k % 5 >= 2 and not talent and k % 3 <> 0 and k % 4 = 0"),
    ("Primary genre required", "error", "primary_genre", "k % 3 <> 0 and k % 11 = 0"), ("Primary genre consistency", "suggestion", "primary_genre", "k % 3 <> 0 and k % 11 > 1"),
    ("DAR companies", "error", "companies", "dar and k % 6 <> 1"), ("Companies required", "error", "companies", "not dar and k % 6 = 0"),
    ("Brand set required", "error", "brand_set", "k % 8 = 0"), ("DAR brand set", "error", "brand_set", "dar and k % 8 > 1"), ("Competitive brand set", "error", "brand_set", "not dar and k % 8 = 1"),
    ("Facebook URL", "error", "facebook_page", "k % 9 in (1, 3)"), ("Facebook URL path", "error", "facebook_page", "k % 9 in (2, 3)"),
    ("IMDb required", "error", "imdb_id", "screen and k % 10 = 0"), ("IMDb format", "error", "imdb_id", "screen and k % 10 = 1"), ("IMDb URL format", "error", "imdb_url", "screen and k % 10 = 2"),
    ("IMDb consistency", "error", "imdb_url", "screen and k % 10 = 3"), ("IMDb title.basics lookup", "error", "imdb_id", "screen and k % 10 >= 4 and k % 3 <> 0 and k % 2 = 0"),
    ("IMDb name.basics lookup", "suggestion", "imdb_id", "talent and k % 3 <> 0 and (k % 10 = 0 or k % 10 >= 4 and k % 4 = 0)"), ("IMDb name format", "error", "imdb_id", "talent and k % 10 = 1"),
    ("IMDb name URL format", "error", "imdb_url", "talent and k % 10 = 2"), ("IMDb name consistency", "error", "imdb_url", "talent and k % 10 = 3"),
    ("Metacritic URL lookup", "suggestion", "metacritic_url", "screen and k % 6 = 0"), ("Metacritic URL format", "error", "metacritic_url", "screen and k % 6 in (1, 2)"),
    ("Metacritic title match", "error", "metacritic_url", "screen and (k % 6 = 3 or k % 6 > 3 and k % 13 < 2)"),
    ("Twitter terms required", "error", "twitter_search_terms", "screen and k % 4 = 1"), ("Twitter keywords required", "error", "twitter_search_term_keywords", "screen and k % 4 = 2"),
    ("YouTube URL", "error", "youtube_url", "k % 7 = 1 or k % 7 = 3 and k % 13 < 2"), ("YouTube channel URL", "error", "youtube_channel_username", "k % 8 = 3"),
    ("YouTube channel API verification", "suggestion", "youtube_channel_company", "k % 9 = 4"), ("YouTube channel API verification", "error", "youtube_channel_company", "k % 9 = 5"),
    ("YouTube channel API verification", "error", "youtube_channel_company", "k % 9 = 5"),
    ("Wikipedia URL", "error", "wikipedia_url", "k % 12 = 1"), ("Wikipedia English URL", "error", "wikipedia_url", "k % 12 = 2"), ("Wikipedia article URL", "error", "wikipedia_url", "k % 12 = 3"),
    ("Wikidata Wikipedia URL match", "error", "wikipedia_url", "k % 12 = 4"), ("Wikipedia title match", "error", "wikipedia_url", "k % 12 = 6 or k % 12 = 7 and k % 13 < 2"),
    ("Wikipedia page verification", "error", "wikipedia_url", "k % 12 = 7 and k % 13 > 1"),
    ("URL managers completeness", "error", "url_managers", "k % 3 = 1 and (k % 6 = 1 or k % 9 <> 0) or k % 3 = 2 and (k % 6 <> 0 or k % 9 <> 0)"),
    ("IMDb release date", "error", "release_date", "k % 10 in (0, 3, 4)"), ("IMDb release date", "suggestion", "release_date", "k % 10 = 1"),
    ("IMDb network/distributor", "suggestion", "network", "k % 4 in (0, 1)"),
]
_BROKEN_SQL = (
    "with b as (select c_custkey as k, c_custkey % 5 = 4 and c_custkey % 2 = 0 as talent, c_custkey % 5 in (2, 3) as screen, c_custkey % 13 in (1, 2) as dar from customer), issues as ("
    + " union all ".join(_rule(name, level, when, column) for name, level, column, when in _BROKEN_RULES) + ") "
)


@query(_BROKEN_SQL + 'select row_no, rule, level, "column" from issues')
def rule_report_all(t: Table) -> DataFrame:
    """Every rule, with what the lookups found."""
    return validate.report(_broken_sheet(t)).select("row_no", "rule", "level", "column")


@query(_BROKEN_SQL + "select rule, count(*) filter (level = 'error') as errors, count(*) filter (level = 'suggestion') as suggestions from issues group by 1")
def issue_counts_all(t: Table) -> DataFrame:
    return validate.issue_counts(validate.report(_broken_sheet(t)), "rule")


from cinelake.plans import compositions, files, pages, trackers, values  # noqa: E402, F401  they register their queries, for which they need what is above
