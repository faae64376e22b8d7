"""Queries of whole snapshots: calendars, catalogues and answers that are made of the tables, and SQL that says the same."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinelake.functions import classify, text
from cinelake.operators import snapshots
from cinelake.operators.tallies import status_tallies, write_tallied
from cinelake.plans.pages import RELEASES, _kind, _of, _releases
from cinelake.plans.registry import SCORE, Table, query
from cinelake.sources.scratch import scratch_path

START, END = dt.date(2026, 3, 3), dt.date(2026, 3, 15)
_CALENDAR = f"""r as ({RELEASES}), cal as (select k, kind, day, 'Show ' || k % 40 || case when kind = 0 then ' Season 2' else '' end as title, 'Show ' || k % 40 as bare from r where kind <> 3 and day between date '{START}' and date '{END}'),
shows as (select s_suppkey as code, 'Show ' || s_suppkey % 45 as title, case when s_suppkey % 2 = 0 then 'tvSeries' else 'tvMiniSeries' end as type, 2020 + s_suppkey % 7 as year from supplier),
scored as (select c.k, s.code, 60 + case when s.type = case when c.kind = 1 then 'tvMiniSeries' else 'tvSeries' end then 30 when s.type in ('tvSeries', 'tvMiniSeries') then 12 else 0 end
  + case when s.year = 2026 then 120 when s.year = 2025 then 35 else -least((2026 - s.year) * 3, 90) end as score from cal c join shows s on c.bare = s.title),
best as (select k, code from scored qualify row_number() over (partition by k order by score desc, code) = 1),
matched as (select c.*, b.code from cal c left join best b using (k))"""


def _calendar(t: Table) -> DataFrame:
    title = _of("Show ", F.col("k") % 40, F.when(F.col("kind") == 0, " Season 2").otherwise(""))
    return _releases(t).select(
        "k", title.alias("title"), F.col("day").alias("release_date"), _kind("TV Series", "Limited Series", "TV Series", "Movie").alias("release_type"), F.lit("TV Series").alias("content_format"),
        _kind("FX", "", "Netflix", "").alias("availability"), _kind("", "", "a tale through Apr 30", "").alias("details"), F.lit("Drama").alias("genre"),
    )


def _shows(t: Table) -> DataFrame:
    k = F.col("s_suppkey")
    return t("supplier").select(k.alias("code"), F.when(k % 2 == 0, "tvSeries").otherwise("tvMiniSeries").alias("kind"), _of("Show ", k % 45).alias("primary_title"), F.lit("").alias("original_title"), (k % 7 + 2020).alias("year"))


def _episodes(t: Table) -> DataFrame:
    return t("lineitem").select(F.col("l_suppkey").alias("code"), F.col("l_linenumber").cast("string").alias("season"), F.col("l_partkey").cast("string").alias("episode"))


@query(f"""with {_CALENDAR}, totals as (select l_suppkey as code, count(*) as episodes, count(distinct l_linenumber) as seasons from lineitem group by 1)
select k, title, day as release_date, coalesce(cast(m.code as varchar), '') as code, seasons as total_seasons, episodes as total_episodes, case when kind = 2 then date '2026-04-30' else day + 30 end as end_date,
case when m.code is null then 'Manual review' else 'Matched' end as note from matched m left join totals t on t.code = m.code""")
def series_snapshot(t: Table) -> DataFrame:
    found = snapshots.series_snapshot(_calendar(t), _shows(t), _episodes(t), START, END)
    return found.select("k", "title", "release_date", "code", "total_seasons", "total_episodes", "end_date", "note")


@query(f"""with {_CALENDAR} select 'Rows from {START} through {END}: ' || count(*) || '. Matched: ' || count(code) || '. For review: ' || (count(*) - count(code)) || '.' as summary from matched""")
def snapshot_summary(t: Table) -> DataFrame:
    found = snapshots.series_snapshot(_calendar(t), _shows(t), _episodes(t), START, END)
    return snapshots.summary(found, F.col("note") == "Matched", START, END)


@query(f"""with {_CALENDAR} select count(*) as written, count(*) as rows, count(code) as matched, count(*) - count(code) as manual_review from matched""")
def tallied_snapshot(t: Table) -> DataFrame:
    """A snapshot's rows are written, and its tallies come from the same job."""
    found = snapshots.series_snapshot(_calendar(t), _shows(t), _episodes(t), START, END)
    spark, path = found.sparkSession, scratch_path(found.sparkSession, "snapshot")
    tallies = write_tallied(found, path, **status_tallies("note", ["Matched", "Manual review"]))
    return spark.read.parquet(path).agg(F.count("*").alias("written")).select("written", *(F.lit(v).alias(n) for n, v in tallies.items()))


_WIDE = _CALENDAR.replace("'Show ' || s_suppkey % 45 as title", "'Show ' || s_suppkey % 23 as title")


@query(f"""with {_WIDE} select k, coalesce(cast(m.code as varchar), '') as code, case when m.code is null then 'Manual review' else 'Matched' end as note,
case when m.code is null then '' else 'The title''s key is equal.' || case when s.type <> e.expected then ' It is a ' || s.type || ', ' || e.expected || ' was looked for.' else '' end
  || case when s.year is null then ' No start year is known.' when s.year <> 2026 then ' It starts in ' || s.year || ', not in 2026.' else '' end end as remarks
from matched m join (select k, case when kind = 1 then 'tvMiniSeries' else 'tvSeries' end as expected from cal) e using (k) left join shows s on s.code = m.code""")
def series_remarks(t: Table) -> DataFrame:
    """What a match differs in: another type, another year; titles without a series are for review."""
    shows = _shows(t).withColumn("primary_title", _of("Show ", F.col("code") % 23))
    found = snapshots.series_snapshot(_calendar(t), shows, _episodes(t), START, END)
    return found.select("k", "code", "note", "remarks")


@query(f"""with {_CALENDAR}, one as (select lower('Show ' || s_suppkey % 35) as key, s_suppkey as place, 100 + case s_suppkey % 4 when 0 then 25 when 1 then 10 else 0 end as score, case when s_suppkey % 6 = 0 then '' else 'tt' || s_suppkey end as code,
  s_suppkey % 5 as seasons, s_suppkey % 11 as episodes from supplier where s_suppkey % 4 <> 2),
b1 as (select * from one qualify row_number() over (partition by key order by score desc, place) = 1),
b2 as (select lower('Show ' || c_custkey % 37) as key, 'om' || c_custkey as code, c_custkey % 4 as seasons, 0 as episodes from customer where c_custkey % 3 <> 0 qualify row_number() over (partition by c_custkey % 37 order by c_custkey) = 1)
select k, title, coalesce(nullif(b1.code, ''), b2.code, '') as code, coalesce(nullif(b1.seasons, 0), case when coalesce(b1.code, '') = '' then nullif(b2.seasons, 0) end) as total_seasons, nullif(b1.episodes, 0) as total_episodes,
case when b1.code <> '' then 'Matched' when b2.code is not null then 'Matched by the second source' when b1.key is not null then 'Matched without a code' else 'No confident match' end as note
from cal c left join b1 on b1.key = lower(c.bare) left join b2 on b2.key = lower(c.bare)""")
def series_snapshot_of_answers(t: Table) -> DataFrame:
    """Two sources: names that aren't like the asked one, other years, answers without a code, and questions that neither answers."""
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    year = F.when(s % 4 == 0, 2026).when(s % 4 == 1, 2025).otherwise(2020)
    first = t("supplier").select(text.title_key(_of("Show ", s % 35)).alias("key"), s.alias("place"), F.when(s % 4 == 2, "qqqq").otherwise(_of("Show ", s % 35)).alias("name"), year.alias("year"), F.when(s % 6 == 0, "").otherwise(_of("tt", s)).alias("code"), (s % 5).alias("seasons"), (s % 11).alias("episodes"))
    second = t("customer").select(text.title_key(_of("Show ", c % 37)).alias("key"), c.alias("place"), F.when(c % 3 == 0, "zzzz").otherwise(_of("Show ", c % 37)).alias("name"), F.lit(None).cast("int").alias("year"), _of("om", c).alias("code"), (c % 4).alias("seasons"), F.lit(0).alias("episodes"))
    return snapshots.series_snapshot_of_answers(_calendar(t), first, second, START, END).select("k", "title", "code", "total_seasons", "total_episodes", "note")


@query(f"""with {_CALENDAR}, a as (select lower('Show ' || s_suppkey % 30) as key, min(s_suppkey) as s from supplier group by 1),
p as (select distinct lower('Show ' || c_custkey % 35) as key, c_custkey % 3 + 1 as season from customer),
j as (select c.*, a.s, case when kind = 0 then 2 end as told from cal c left join a on a.key = lower(c.bare)),
x as (select j.*, case when s is null then told when told is not null and s % 2 = 0 then told else 3 end as season from j),
y as (select x.*, case when s is not null then case when x.season = 2 then date '2026-02-02' else date '2026-02-03' end end as season_date, p.season is not null as has_page from x left join p on p.key = lower(x.bare) and p.season = x.season)
select k, title, case when s is null then '' else 'tt' || s end as code, cast(season as int) as season, nullif(greatest(coalesce(case when s is not null then season + 5 end, 0), case when has_page or (told is not null and exists (select 1 from p where p.key = lower(y.bare) and p.season = told)) then 9 else 0 end), 0) as season_episodes,
coalesce(season_date, case when has_page then date '2026-01-05' end, day) as start_date,
case when kind = 2 then date '2026-04-30' when s is not null then date '2026-03-30' when has_page then date '2026-03-09' else null end as end_date from y where kind <> 99""")
def season_snapshot_of_answers(t: Table) -> DataFrame:
    """Answers with and without the told season, season pages, and titles that neither knows."""
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    listed = F.when(s % 2 == 0, '{"season_number": 2, "episode_count": 7, "air_date": "2026-02-02"}, ').otherwise("")
    body = _of('{"seasons": [', listed, '{"season_number": 3, "episode_count": 8, "air_date": "2026-02-03"}], "last_episode_to_air": {"air_date": "2026-03-30"}}')
    answers = t("supplier").select(text.title_key(_of("Show ", s % 30)).alias("key"), s.alias("place"), _of("Show ", s % 30).alias("name"), F.lit(2026).alias("year"), _of("tt", s).alias("code"), body.alias("body"))
    said = "Episode 1 Jan 5, 2026 The start. Episode 2 Mar 9, 2026 More. 9 episodes"
    pages = t("customer").select(text.title_key(_of("Show ", c % 35)).alias("key"), (c % 3 + 1).cast("int").alias("season"), F.lit(said).alias("text")).distinct()
    return snapshots.season_snapshot_of_answers(_calendar(t), answers, pages, START, END).select("k", "title", "code", "season", "season_episodes", "start_date", "end_date")


@query(f"""with {_CALENDAR}, counted as (select l_suppkey as code, l_linenumber as season, count(distinct l_partkey) as n from lineitem group by 1, 2), latest as (select code, max(season) as season, arg_max(n, season) as n from counted group by 1),
own as (select m.*, c.n as own_n, l.season as latest, l.n as latest_n from matched m left join counted c on c.code = m.code and m.kind = 0 and c.season = 2 left join latest l on l.code = m.code)
select k, title, coalesce(cast(code as varchar), '') as code, cast(case when own_n is not null then 2 else coalesce(latest, case when kind = 0 then 2 end) end as int) as season, coalesce(own_n, latest_n) as season_episodes,
case when kind = 2 then date '2026-04-30' else day + 30 end as end_date from own""")
def season_episode_snapshot(t: Table) -> DataFrame:
    found = snapshots.season_snapshot(_calendar(t), _shows(t), _episodes(t), START, END)
    return found.select("k", "title", "code", "season", "season_episodes", "end_date")


@query(f"""with r as ({RELEASES}), a as (select k, case when kind = 2 and k % 5 = 0 then 'Unlisted ' || k else 'Show ' || k % 60 end as title, list_value('TV Shows', 'Movies', 'TV Shows', 'Other')[kind + 1] as category,
case when kind <> 2 or k % 5 = 0 then day end as release_date, case when k % 3 = 0 then 'Hulu Originals' when kind = 2 then 'Netflix' else '' end as network from r),
c as (select s_suppkey, 'tt' || s_suppkey as code, list_value('tvSeries', 'movie', 'videoGame')[s_suppkey % 3 + 1] as type, 'Show ' || s_suppkey % 45 as title, 2020 + s_suppkey % 7 as year, case when s_suppkey % 4 <> 0 then 'Drama' end as genres from supplier),
scored as (select a.k, c.code, c.year, c.genres, case when category = 'TV Shows' and type = 'tvSeries' then 80 when category = 'Movies' and type = 'movie' then 80 when category = 'Other' then case type when 'movie' then 80 when 'tvSeries' then 78 else 76 end end + 20
  + case when release_date is null then least(c.year - 1900, 125) when c.year = 2026 then 50 when c.year = 2025 then 15 else 0 end as score from a join c on a.title = c.title),
best as (select * from scored where score is not null qualify row_number() over (partition by k order by score desc, code) = 1),
shown as (select distinct 'Show ' || c_custkey % 70 || case when c_custkey % 9 = 0 then ' Returns' else '' end as title, date '2026-03-01' + cast(c_custkey % 50 as int) as day, case when c_custkey % 5 = 0 then '' else 'https://x.example.com/' || c_custkey % 400 end as url,
  case c_custkey % 4 when 0 then 'Hulu' when 1 then 'Netflix' when 2 then '' else 'FX' end as network from customer),
asked as (select distinct lower(title) as key, release_date, network from a where category = 'TV Shows'),
rated as (select a.key, a.release_date, a.network, s.title, s.day, s.url, s.network as shown_network, {SCORE.format('a.key', 'lower(s.title)')} + case when s.day = a.release_date then 35 when abs(s.day - a.release_date) <= 14 then 15 else 0 end
  + case when list_has_any(list_filter(string_split(lower(a.network), ' '), lambda x: x <> ''), string_split(lower(s.network), ' ')) then 25 else 0 end as score from asked a, shown s),
near as (select * from rated where score >= 45 qualify row_number() over (partition by key, release_date, network order by score desc, day, url, title, shown_network) = 1)
select a.k, b.code as found_imdb, coalesce(n.day, cast(make_date(b.year, 1, 1) as date)) as found_date, case when n.day is not null then 'date' when b.year is not null then 'year' else '' end as found_precision,
coalesce(b.genres, case when n.url is not null then 'Crime; Drama' end, '') as found_genres, coalesce(n.shown_network, '') as found_network,
case when n.url <> '' then n.url when n.key is not null then 'https://www.metacritic.com/tv/' || replace(lower(n.title), ' ', '-') || '/' when category = 'Movies' then 'https://www.metacritic.com/movie/' || replace(lower(a.title), ' ', '-') || '/'
  when category = 'TV Shows' then 'https://www.metacritic.com/tv/' || replace(lower(a.title), ' ', '-') || '/' end as found_metacritic,
concat_ws(' + ', case when b.code is not null then 'Index' end, case when n.key is not null then 'Calendar' when category <> 'Other' then 'Title URL' end) as found_source
from a left join best b using (k) left join near n on category = 'TV Shows' and n.key = lower(a.title) and n.release_date is not distinct from a.release_date and n.network = a.network""")
def external_candidates(t: Table) -> DataFrame:
    k, unlisted = F.col("k"), (F.col("kind") == 2) & (F.col("k") % 5 == 0)
    rows = _releases(t).select(
        "k", F.when(unlisted, _of("Unlisted ", k)).otherwise(_of("Show ", k % 60)).alias("title"), _kind("TV Shows", "Movies", "TV Shows", "Other").alias("category"), F.when((F.col("kind") != 2) | unlisted, F.col("day")).alias("release_date"),
        F.when(k % 3 == 0, "Hulu Originals").when(F.col("kind") == 2, "Netflix").otherwise("").alias("network"),
    )
    s = F.col("s_suppkey")
    kinds = F.when(s % 3 == 0, "tvSeries").when(s % 3 == 1, "movie").otherwise("videoGame")
    catalogue = t("supplier").select(_of("tt", s).alias("code"), kinds.alias("kind"), _of("Show ", s % 45).alias("title"), (s % 7 + 2020).alias("year"), F.when(s % 4 != 0, F.array(F.lit("Drama"))).alias("genres"))
    c = F.col("c_custkey")
    calendar = t("customer").select(
        _of("Show ", c % 70, F.when(c % 9 == 0, " Returns").otherwise("")).alias("title"), F.date_add(F.lit("2026-03-01").cast("date"), (c % 50).cast("int")).alias("release_date"), F.lit("Crime/Drama").alias("genre"),
        F.when(c % 4 == 0, "Hulu").when(c % 4 == 1, "Netflix").when(c % 4 == 2, "").otherwise("FX").alias("availability"), F.when(c % 5 == 0, "").otherwise(_of("https://x.example.com/", c % 400)).alias("page_url"),
    )
    return snapshots.external_candidates(rows, catalogue, calendar, ["k"]).withColumn("found_genres", F.array_join("found_genres", "; "))


@query(f"""with r as ({RELEASES}) select title, case when kind = 3 then '' when kind = 2 then 'Else' else 'Film ' || k end as matched_title, case when kind = 3 then '' else '2026' end as year, case when kind = 3 then '' when kind = 2 then 'tt2' || k else 'tt1' || k end as code,
case when kind in (0, 1) then '$' || (k + 100) else '' end as opening, case when kind in (0, 1) then cast(k + 100 as varchar) else '' end as theaters, case when kind = 3 then 'No matching film' when kind = 2 then 'No opening figures on the page' else '' end as note from r""")
def opening_figures(t: Table) -> DataFrame:
    k, rows = F.col("k"), _releases(t)
    film = _of('{"id": "tt1', k, '", "l": "Film ', k, '", "qid": "movie", "y": 2026}')
    other = _of('{"id": "tt2', k, '", "l": "Else", "qid": "tvSeries", "y": 2026}')
    listed = F.when(F.col("kind") == 3, "").when(F.col("kind") == 2, other).otherwise(F.concat(F.lit('{"l": "no id"}, '), other, F.lit(", "), film))
    details = rows.filter("kind < 2").select(_of("tt1", k).alias("code"), F.explode(F.array(F.struct(F.lit("Opening").alias("label"), _of("$", k + 100, " gross").alias("value")), F.struct(F.lit("Widest Release").alias("label"), _of(k + 100, " theaters").alias("value")))).alias("d")).select("code", "d.*")
    return snapshots.opening_figures(rows.select("title"), rows.select("title", _of('{"d": [', listed, "]}").alias("body")), details)


@query(f"with r as ({RELEASES}) select k from r where kind not in (1, 3)")
def premiere_filters(t: Table) -> DataFrame:
    rows = _releases(t).select("k", F.concat("title", _kind("", ": A Live  Event", " specialist", "")).alias("title"), _kind("FX", "FX", "VOD", "Netflix; RENT/BUY").alias("availability"))
    return snapshots.without_specials(snapshots.without_rent_buy(rows)).select("k")


@query(f"with r as ({RELEASES}) select k, case when kind = 0 then 6 else 0 end as episodes, case kind when 0 then 1 when 1 then 2 when 2 then 1 end as season from r")
def episode_overrides(t: Table) -> DataFrame:
    title = _kind("My Two Cents Season 1", "My Two Cents Season 2", "Others S01", "My Two Cents")
    season = snapshots.told_season(title)
    return _releases(t).select("k", snapshots.episode_override(snapshots.bare_title(title), season, F.year("day")).alias("episodes"), season.alias("season"))


@query(f"""with r as ({RELEASES}) select k, list_value('Video Games', 'TV Movies', 'Movies', 'TV Shows')[kind + 1] as category, list_value('videoGame', 'tvMovie', 'movie', 'tvSeries')[kind + 1] as first_type from r""")
def category_routing(t: Table) -> DataFrame:
    category = classify.routed_category(_kind("game", "imdb", "boxoffice", "tv"), _kind("", "main", "", "tv"), F.lit(""), _kind("", "TV Movie", "", "Series"))
    return _releases(t).select("k", category.alias("category"), F.get(classify.preferred_types(category), F.lit(0)).alias("first_type"))


@query(f"""with r as ({RELEASES}) select k, 'cafe-and-ete-story-' || k as slug, 'A-Name-' || k || '--..csv' as file, substr('Sheet ' || k || ' of a title that is far too long', 1, 31) as sheet, 'Plan_ ' || k || '_validated.xlsx' as workbook from r""")
def file_names(t: Table) -> DataFrame:
    return _releases(t).select(
        "k", text.ascii_slug(_of("Café & Été — Story ", F.col("k"))).alias("slug"), text.safe_filename(_of(" A/Name: ", F.col("k"), "?-."), "csv").alias("file"),
        text.safe_sheet_title(_of("Sheet/", F.col("k"), " of a title that is far too long")).alias("sheet"), text.validated_filename(_of("Plan# ", F.col("k"), "?.xlsx")).alias("workbook"),
    )


@query("select event_id, ts, event_type from events")
def merged_runs(t: Table) -> DataFrame:
    """Runs of the trackers, which event types stand for; what is of none of the named ones is the last tracker's."""
    named = ["click", "view", "purchase", "signup"]
    rows, kind = t("events").select("event_id", "ts", "event_type"), F.coalesce("event_type", F.lit(""))
    return snapshots.merged_snapshots(*(rows.filter(kind == n) for n in named), rows.filter(~kind.isin(named)), created="ts", run_id="event_id")
