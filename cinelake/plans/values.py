"""Queries of single values: keys, dates, references and predicates whose right answers SQL tells by the row's number."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinelake.functions import dates, scoring, text
from cinelake.operators import history, rollup, snapshots
from cinelake.plans.pages import _html, _of, _releases
from cinelake.plans.registry import KEY, Table, query
from cinelake.sources import html, sinks
from cinelake.sources.scratch import scratch_path

AS_OF = dt.date(2026, 3, 1)


def _pick(k, values: list[str]):
    return F.get(text.literals(values), (k % len(values)).cast("int"))


def _list(values: list[str]) -> str:
    return "list_value(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


_HEADERS = ["Title_Name", "  Release   Date ", "IMDb_ID", "X / Twitter", "genre"]


@query(f"select c_custkey as k, {_list(['title name', 'release date', 'imdb id', 'x / twitter', 'genre'])}[c_custkey % 5 + 1] as header from customer")
def header_keys(t: Table) -> DataFrame:
    return t("customer").select(F.col("c_custkey").alias("k"), text.header_key(_pick(F.col("c_custkey"), _HEADERS)).alias("header"))


@query("""select o_orderkey as k, case when make_date(2026, month(o_orderdate), day(o_orderdate)) < date '2026-03-01' - 45 then make_date(2027, month(o_orderdate), day(o_orderdate)) else make_date(2026, month(o_orderdate), day(o_orderdate)) end as day
from orders where not (month(o_orderdate) = 2 and day(o_orderdate) = 29)""")
def calendar_days(t: Table) -> DataFrame:
    """A day without a year is of the next year if this year's lies over 45 days back."""
    rows = t("orders").filter("not (month(o_orderdate) = 2 and day(o_orderdate) = 29)")
    return rows.select(F.col("o_orderkey").alias("k"), dates.article_date(F.date_format("o_orderdate", "MMM d"), 2026, AS_OF).alias("day"))


@query("select o_orderkey as k, strftime(o_orderdate, '%d-%m-%Y') as shown from orders")
def display_dates(t: Table) -> DataFrame:
    return t("orders").select(F.col("o_orderkey").alias("k"), dates.display_date(F.to_date("o_orderdate")).alias("shown"))


_CHANNELS = ["", "https://www.youtube.com/channel/UCabc", "https://youtube.com/@Net", "https://m.youtube.com/user/net", "https://www.youtube.com/c/net", "@net", "UC1234567890123456789012", "https://example.com/@net", "some name"]
_CHANNEL_KINDS = ["invalid", "id", "handle", "user", "search", "handle", "id", "invalid", "search"]
_CHANNEL_VALUES = ["", "UCabc", "Net", "net", "net", "net", "UC1234567890123456789012", "https://example.com/@net", "some name"]


@query(f"select c_custkey as k, {_list(_CHANNEL_KINDS)}[c_custkey % 9 + 1] as kind, {_list(_CHANNEL_VALUES)}[c_custkey % 9 + 1] as value from customer")
def channel_references(t: Table) -> DataFrame:
    found = text.channel_reference(_pick(F.col("c_custkey"), _CHANNELS))
    return t("customer").select(F.col("c_custkey").alias("k"), found["kind"].alias("kind"), found["value"].alias("value"))


@query("select p_partkey as k, upper(p_name[1]) || substr(p_name, 2, instr(p_name, ' ') - 1) || upper(p_name[instr(p_name, ' ') + 1]) || substr(p_name, instr(p_name, ' ') + 2) as title, p_brand || case when p_size % 2 = 0 then '; ' || p_type else '' end as joined from part")
def titles_and_joins(t: Table) -> DataFrame:
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    return t("part").select(F.col("p_partkey").alias("k"), text.titleize(name).alias("title"), text.join_nonblank("; ", "p_brand", F.lit(" "), F.when(F.col("p_size") % 2 == 0, F.col("p_type"))).alias("joined"))


@query(f"""with p as (select p_partkey as k, {KEY.format('p_name')} as key, lower(p_brand) as brand from part)
select k, contains(key, 'small') as one, contains(key, 'small') or contains(key, 'ring') as any_of, contains(key, split_part(key, ' ', 2)) and key <> '' as either, split_part(key, ' ', 1) in ('blue', 'ring') or split_part(key, ' ', 2) in ('blue', 'ring') as shares from p""")
def key_predicates(t: Table) -> DataFrame:
    key = text.title_key("p_name")
    return t("part").select(
        F.col("p_partkey").alias("k"), text.holds_value("p_name", "Small!").alias("one"), text.holds_values("p_name", ["SMALL", "Ring"]).alias("any_of"),
        text.contains_either(F.get(F.split(key, " "), F.lit(1)), key).alias("either"), text.shares_token("p_name", F.lit("Ring & Blue")).alias("shares"),
    )


_TIMES = ["2026-01-02T03:04:05", "2026-01-02T03:04:05Z", "2026-01-02T05:04:05+02:00", "no time", "2026-01-02 03:04:05"]


@query("select c_custkey as k, case when c_custkey % 5 <> 3 then timestamp '2026-01-02 03:04:05' end as at from customer")
def iso_times(t: Table) -> DataFrame:
    """Times without a zone are UTC; what can't be read is null."""
    return t("customer").select(F.col("c_custkey").alias("k"), F.try_to_timestamp(_pick(F.col("c_custkey"), _TIMES)).alias("at"))


@query("""select r_regionkey as k, list_value('current', 'next_7', 'one_year', 'custom', 'current')[r_regionkey + 1] as kind, date '2026-03-01' + list_value(0, 0, 0, 4, 0)[r_regionkey + 1] as first, date '2026-03-01' + list_value(0, 7, 365, 9, 0)[r_regionkey + 1] as last from region""")
def windows(t: Table) -> DataFrame:
    found = {k: dates.window(k, AS_OF) for k in ("current", "next_7", "one_year")} | {"custom": dates.window("custom", AS_OF, AS_OF + dt.timedelta(4), AS_OF + dt.timedelta(9))}
    kinds = ["current", "next_7", "one_year", "custom", "current"]
    kind = F.get(text.literals(kinds), F.col("r_regionkey").cast("int"))
    of = lambda i: F.coalesce(*(F.when(kind == k, F.lit(w[i])) for k, w in found.items()))
    return t("region").select(F.col("r_regionkey").alias("k"), kind.alias("kind"), of(0).alias("first"), of(1).alias("last"))


@query("select o_orderkey as k, o_orderdate from orders where cast(o_orderdate as date) between date '1998-07-25' and date '1998-08-01'")
def default_windows(t: Table) -> DataFrame:
    """The window of a season snapshot where none is asked for: a week up to today."""
    start, end = snapshots.default_window(snapshots.SEASON_DAYS, dt.date(1998, 8, 1))
    return t("orders").filter(dates.in_window(F.to_date("o_orderdate"), start, end)).select(F.col("o_orderkey").alias("k"), "o_orderdate")


@query("select count(*) filter (c_mktsegment = 'BUILDING') as confirmed, count(*) filter (c_mktsegment = 'MACHINERY') as review, count(*) filter (c_mktsegment not in ('BUILDING', 'MACHINERY')) as not_found from customer")
def confirmation_tallies(t: Table) -> DataFrame:
    """Whatever is neither confirmed nor for review counts as not found."""
    status = F.when(F.col("c_mktsegment") == "BUILDING", "Confirmed").when(F.col("c_mktsegment") == "MACHINERY", "Review").otherwise(F.col("c_mktsegment"))
    return rollup.status_counts(t("customer").withColumn("status", status), "status", ["Confirmed", "Review"], rest="not_found")


@query("""select 7 as run_id, 'tv' as tracker_type, (select count(*) from supplier) + (select count(*) from customer) as row_count, (select count(*) from supplier) as daily, (select count(*) from customer) as yearly""")
def appended_runs(t: Table) -> DataFrame:
    spark = t("supplier").sparkSession
    path = scratch_path(spark, "runs")
    history.append_run(spark, path, 7, "tv", "TV", "2026-03-01T00:00:00", {"daily": t("supplier"), "yearly": t("customer")})
    return spark.read.parquet(path).select(
        F.col("run_id").cast("int").alias("run_id"), "tracker_type", "row_count", *(F.get_json_object("snapshot", f"$.{n}").cast("long").alias(n) for n in ("daily", "yearly"))
    )


@query("select greatest(least(max(len(c_name)) + 2, 60), 12) as c_name, greatest(least(greatest(max(len(c_mktsegment)), 12) + 2, 60), 12) as c_mktsegment, 12 as lacking from customer")
def export_widths(t: Table) -> DataFrame:
    named = sinks.ordered(t("customer"), ["c_name", "c_mktsegment", "lacking"])
    return sinks.column_widths(named, ["c_name", "c_mktsegment", "lacking"])


@query("select c_name, '' as note, c_mktsegment, 'c_name' as title_column from customer")
def export_columns(t: Table) -> DataFrame:
    """A column put after another, filled where the rows lack it; the title's column among those that are known."""
    columns = sinks.insert_after(["c_name", "c_mktsegment"], "note", "c_name")
    rows = sinks.ordered(t("customer"), sinks.insert_after(columns, "note", "c_mktsegment"))
    title = snapshots.title_column(["x", "Input Title"], ["title"])
    return rows.withColumn("title_column", F.lit({"Input Title": "c_name"}[title]))


@query("""with r as (select p_partkey as k, p_partkey // 10 as page_id, 'Story ' || p_partkey as title, p_partkey % 4 as kind from part), l as (select page_id, k, unnest([title || ' & more', 'Part ' || kind]) as line, unnest([0, 1]) as i from r)
select page_id, cast(row_number() over (partition by page_id order by k, i) - 1 as int) as pos, line from l""")
def page_lines(t: Table) -> DataFrame:
    """Visible lines: blocks apart, inline elements together, scripts, styles, templates and hidden parts gone."""
    line = _of("<script>var x = '<p>no</p>';</script><div><b>", F.col("title"), "</b> &amp;\n  more<style>p {}</style></div><template><p>no</p></template><ul><li>Part <i>", F.col("kind"), "</i></li></ul><noscript>no</noscript><svg><text>no</text></svg>")
    return html.lines(_html(_releases(t), line))


@query("""with p as (select p_partkey as k, p_partkey % 4 as m from part) select k, round(case m when 0 then 100.0 when 1 then 200.0 * 5 / 11 when 2 then 0.0 else 200.0 * 6 / 14 end, 6) as ratio, case m when 0 then 25 when 1 then 10 else 0 end as bonus from p""")
def similarity_values(t: Table) -> DataFrame:
    """Matching blocks of pairs whose measure is known: equal, one within the other, nothing in common, two blocks in the same order."""
    m = (F.col("p_partkey") % 4).cast("int")
    a = F.get(text.literals(["river", "river", "river", "abcxyz"]), m)
    b = F.get(text.literals(["river", "rivers", "qqqqq", "abc--xyz"]), m)
    year = F.get(F.array(F.lit(2026), F.lit(2025), F.lit(2020), F.lit(None).cast("int")), m)
    return t("part").select(F.col("p_partkey").alias("k"), F.round(scoring.sequence_ratio(a, b), 6).alias("ratio"), F.coalesce(scoring.year_bonus(year, F.lit(2026)), F.lit(0)).alias("bonus"))
