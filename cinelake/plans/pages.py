"""Queries over pages and answers that are written from the test tables: what the readers find is what SQL says was put in."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinelake.functions import scoring, seasons, text
from cinelake.operators import dedupe, resolve
from cinelake.operators.spread import spread
from cinelake.plans.registry import KEY, SCORE, Table, query
from cinelake.sources import blocks, box_office, calendars, charts, html, lookups

AS_OF = dt.date(2026, 3, 1)
#: Releases: ten of a page, a page's day, a score and a kind.
RELEASES = """select p_partkey as k, p_partkey // 10 as page_id, date '2026-03-02' + cast(p_partkey // 10 % 20 as int) as day,
case when p_partkey % 7 = 0 then 'tbd' else cast(50 + p_partkey % 50 as varchar) end as score, p_partkey % 4 as kind, 'Story ' || p_partkey as title from part"""


def _releases(t: Table) -> DataFrame:
    k = F.col("p_partkey")
    return t("part").select(
        k.alias("k"), F.floor(k / 10).alias("page_id"), F.date_add(F.lit("2026-03-02").cast("date"), (F.floor(k / 10) % 20).cast("int")).alias("day"),
        F.when(k % 7 == 0, "tbd").otherwise((k % 50 + 50).cast("string")).alias("score"), (k % 4).alias("kind"), F.concat(F.lit("Story "), k).alias("title"),
    )


def _html(rows: DataFrame, line: Column, before: str = "", after: str = "", heading: Column | None = None) -> DataFrame:
    """A page for each page_id: its heading, then the lines of its rows in the order of k."""
    parts = spread(rows, "page_id").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("k", line.alias("line")))).alias("lines"), F.first(heading if heading is not None else F.lit("")).alias("heading"))
    return parts.select("page_id", F.concat(F.lit("<html><body>"), "heading", F.lit(before), F.array_join("lines.line", "\n"), F.lit(after + "</body></html>")).alias("html"))


def _of(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _kind(*values: str) -> Column:
    out = F.when(F.lit(False), "")
    for i, v in enumerate(values):
        out = out.when(F.col("kind") == i, v)
    return out


def _dated() -> Column:
    return _of("<h3>", F.date_format("day", "EEE / MMM d, yyyy"), "</h3>")


def _tv_pages(t: Table) -> DataFrame:
    rows = _releases(t)
    told = _kind("Drama: season 2 of a tale", "Crime/Drama: a limited series", "Comedy: jokes", "Reality: people")
    line = _of("<tr><td>", F.col("score"), '</td><td><a href="/tv/story-', F.col("k"), '">', F.col("title"), "</a> ", told, "</td><td>", _kind("Netflix", "FX", "Netflix", "Hulu"), "</td></tr>")
    return _html(rows, line, "<table>", "</table>", _dated())


@query(f"""with r as ({RELEASES}) select page_id, title, day as release_date, score, list_value('Drama', 'Crime/Drama', 'Comedy', 'Reality')[kind + 1] as genre,
list_value('season 2 of a tale', 'a limited series', 'jokes', 'people')[kind + 1] as details, list_value('Netflix', 'FX', 'Netflix', 'Hulu')[kind + 1] as availability,
list_value('Returning Series', 'Limited Series', 'TV Series', 'TV Series')[kind + 1] as release_type, 'https://www.metacritic.com/tv/story-' || k as page_url from r""")
def tv_calendar_tables(t: Table) -> DataFrame:
    found = calendars.tv_calendar(blocks.blocks(_tv_pages(t)), AS_OF)
    return found.select("page_id", "title", "release_date", "score", "genre", "details", "availability", "release_type", "page_url")


@query(f"""with r as ({RELEASES}) select page_id, case when score = 'tbd' then title else score || ' ' || title end as title, day as release_date, score, list_value('Drama', 'Comedy', 'Drama', 'Comedy')[kind + 1] as genre,
list_value('Netflix', 'FX', 'Netflix', 'Hulu')[kind + 1] as availability, 'https://www.metacritic.com/tv/' || case when score = 'tbd' then '' else score || '-' end || 'story-' || k || '/' as page_url from r""")
def tv_calendar_lines(t: Table) -> DataFrame:
    rows = _releases(t)
    line = _of("<p>", F.col("score"), " ", F.col("title"), "</p><p>", _kind("Drama: a tale Netflix", "Comedy: jokes FX", "Drama: a tale Netflix", "Comedy: jokes Hulu"), "</p>")
    found = calendars.tv_calendar(blocks.blocks(_html(rows, line, heading=_dated())), AS_OF)
    return found.select("page_id", "title", "release_date", "score", "genre", "availability", "page_url")


def _movie_pages(t: Table) -> DataFrame:
    line = _of("<p>", F.col("score"), "</p><p>", F.col("title"), "</p><p>-</p><p>Trailer</p><p>(Studio ", F.col("kind"), ")</p><p>", _kind("Action/Thriller WIDE; IMAX", "Drama Limited", "Horror Streaming (Netflix)", "Comedy VOD"), "</p>")
    return _html(_releases(t), line, heading=_dated())


@query(f"""with r as ({RELEASES}) select page_id, title, day as release_date, score, 'Studio ' || kind as studio, list_value('Action/Thriller', 'Drama', 'Horror', 'Comedy')[kind + 1] as genre,
list_value('WIDE; IMAX', 'Limited', 'Streaming (Netflix)', 'VOD')[kind + 1] as availability, list_value('Movie', 'Movie', 'Streaming Movie', 'VOD Movie')[kind + 1] as content_format,
'https://www.metacritic.com/movie/story-' || k || '/' as page_url from r""")
def movie_calendar_lines(t: Table) -> DataFrame:
    found = calendars.movie_calendar(blocks.blocks(_movie_pages(t)), AS_OF)
    return found.select("page_id", "title", "release_date", "score", "studio", "genre", "availability", "content_format", "page_url")


_GAMES = f"""with r as ({RELEASES}) select page_id, title, day as release_date, list_value('PC PS5', 'NS', 'PC', 'PS4')[kind + 1] as availability, 'RPG' as genre,
list_value('early access', '', 'expansion', 'port')[kind + 1] as details, case when kind = 2 then 'Expansion' else 'Game' end as release_type from r where kind <> 3"""


@query(_GAMES)
def game_calendar_lines(t: Table) -> DataFrame:
    detail = _of("RPG - ", F.date_format("day", "MMM d, yyyy"), _kind(" - early access", "", " - expansion"))
    line = _of("<p>", F.col("title"), " ", _kind("PC PS5", "NS", "PC"), "</p><p>", detail, "</p>")
    return calendars.game_calendar(blocks.blocks(_html(_releases(t).filter("kind <> 3"), line)), AS_OF).select("page_id", "title", "release_date", "availability", "genre", "details", "release_type")


def _game_pages(t: Table) -> DataFrame:
    detail = _of("RPG - ", F.date_format("day", "MMM d, yyyy"), _kind(" - early access", "", " - expansion"))
    line = _of("<tr><td>", F.col("score"), "</td><td><a href='/game/", F.col("k"), "'>", F.col("title"), "</a> ", _kind("PC PS5", "NS", "PC"), " ", detail, "</td></tr>")
    return _html(_releases(t).filter("kind <> 3"), line, "<table>", "</table>")


@query(_GAMES)
def game_calendar_tables(t: Table) -> DataFrame:
    return calendars.game_calendar(blocks.blocks(_game_pages(t)), AS_OF).select("page_id", "title", "release_date", "availability", "genre", "details", "release_type")


def _release_pages(t: Table) -> DataFrame:
    cell = _of('<a href="/release/rl', F.col("k"), '/"><h3>', F.col("title"), "</h3></a> ", _kind("Action Drama", "Comedy", "Horror", "Drama"), " With: Ann Lee, Bo ", F.col("k"), " ", F.col("kind") + 90, " min")
    line = _of("<tr><td>", cell, "</td><td>House ", F.col("kind"), "</td><td>", F.when(F.col("kind") < 2, "Wide").otherwise("Limited"), "</td></tr>")
    return _html(_releases(t), line, "", "</table>", _of("<table><tr><td>", F.date_format("day", "EEEE, MMMM d, yyyy"), "</td></tr>"))


@query(f"""with r as ({RELEASES}) select page_id, title, day as release_date, 'House ' || kind as distributor, case when kind < 2 then 'Wide' else 'Limited' end as scale, list_value('Action Drama', 'Comedy', 'Horror', 'Drama')[kind + 1] as genre,
(90 + kind) || ' min' as running_time, 'With: Ann Lee, Bo ' || k as details, 'https://www.boxofficemojo.com/release/rl' || k || '/' as source_url from r where day between date '2026-03-03' and date '2026-03-15'""")
def release_calendar_tables(t: Table) -> DataFrame:
    found = box_office.release_calendar(blocks.blocks(_release_pages(t)), dt.date(2026, 3, 3), dt.date(2026, 3, 15))
    return found.select("page_id", "title", "release_date", "distributor", "scale", "genre", "running_time", "details", "source_url")


_UPCOMING = f"""select page_id, title, day as release_date, 'tt' || (1000000 + k) as tt_code, 'rl' || k as release_id, 'Action, Drama' as genre, 'A, B' as "cast", '2 hr' as runtime,
list_value('10th Anniversary', '', 'IMAX run', 'Re-release')[kind + 1] as note, list_value('Anniversary', 'Original', 'IMAX', 'Re-release')[kind + 1] as release_type,
case when kind = 1 then 'N/A' else 'House ' || kind end as distributor, case when kind = 2 then 'Unknown' else 'Wide' end as scale from ({RELEASES})"""


def _upcoming_pages(t: Table) -> DataFrame:
    note = F.when(F.col("kind") == 1, "").otherwise(_of("<span>", _kind("10th Anniversary", "", "IMAX run", "Re-release"), "</span>"))
    cell = _of('<img src="p.jpg"><a href="/title/tt', F.col("k") + 1_000_000, '/"><h3>', F.col("title"), "</h3></a>", note, '<div class="mojo-schedule-genres">Action<br>Drama</div>With: A, B 2 hr <a href="/release/rl', F.col("k"), '/">Cast, Crew, and Company Info</a>')
    line = _of("<tr><td>", cell, "</td><td>", F.when(F.col("kind") == 1, "").otherwise(_of("House ", F.col("kind"))), "</td><td>", F.when(F.col("kind") == 2, "").otherwise("Wide"), "</td></tr>")
    return _html(_releases(t), line, "", "</table></div>", _of('<div id="table"><table><tr class="mojo-group-label"><th>', F.date_format("day", "MMMM d, yyyy"), "</th></tr>"))


def _upcoming(t: Table) -> DataFrame:
    return box_office.upcoming_releases(blocks.blocks(_upcoming_pages(t)))


@query(_UPCOMING)
def upcoming_release_pages(t: Table) -> DataFrame:
    return _upcoming(t).select("page_id", "title", "release_date", "tt_code", "release_id", "genre", "cast", "runtime", "note", "release_type", "distributor", "scale")


_CHANGES = f"""with r as ({RELEASES}), c as (select page_id, title as release, 'House ' || kind as distributor, case when kind < 2 then 'Wide' else 'Limited' end as scale,
strftime(day + 7, '%b ') || day(day + 7) || ', 2026' as old_date, strftime(day + 9, '%b ') || day(day + 9) || ', 2026' as new_date, date '2026-03-28' - cast(page_id as int) as posted from r)"""


def _changes(t: Table) -> DataFrame:
    day = lambda n: F.date_format(F.date_add("day", n), "MMM d, yyyy")
    line = _of("<tr><td>", F.col("title"), "</td><td>House ", F.col("kind"), "</td><td>", F.when(F.col("kind") < 2, "Wide").otherwise("Limited"), "</td><td>", day(7), '</td><td class="mojo-field-type-shim">-></td><td>', day(9), "</td></tr>")
    head = _of("<table><tr><th>Release</th><th>Distributor</th><th>Scale</th><th>Old Date</th><th></th><th>New Date</th></tr><tr><td colspan=6>", F.date_format(F.date_sub(F.lit("2026-03-28").cast("date"), F.col("page_id").cast("int")), "MMM d, yyyy"), "</td></tr>")
    return box_office.schedule_changes(blocks.blocks(_html(_releases(t), line, "", "</table>", head)))


@query(_CHANGES + "select * from c")
def schedule_change_pages(t: Table) -> DataFrame:
    return _changes(t).drop("pos")


@query(_CHANGES + "select * from c where posted between date '2026-03-21' and date '2026-03-26' and page_id < 12")
def schedule_change_feed(t: Table) -> DataFrame:
    return box_office.changes_feed(_changes(t), dt.date(2026, 3, 21), dt.date(2026, 3, 26)).drop("pos")


@query(f"""with r as ({RELEASES}), f as (select *, row_number() over (partition by page_id order by k) as n from r) select page_id, 'release' as key_kind, 'rl' || k as key, cast(n as varchar) as rank from f
union all select page_id, 'title', {KEY.format('title')}, cast(n as varchar) from f""")
def weekend_chart_ranks(t: Table) -> DataFrame:
    rows = _releases(t)
    first = rows.groupBy("page_id").agg(F.min("k").alias("first"))
    line = _of("<tr><td>", F.col("k") - F.col("first") + 1, '</td><td><a href="/release/rl', F.col("k"), '/">', F.col("title"), "!</a></td></tr>")
    return box_office.weekend_ranks(blocks.blocks(_html(rows.join(first, "page_id"), line, "<table>", "</table>")))


@query(f"with r as ({RELEASES}), f as (select page_id, min(k) as k from r group by 1) select page_id, unnest(list_value('Opening', 'Genres', 'Widest Release')) as label, unnest(list_value('$' || k || ',000', 'Drama', k || ' theaters')) as value from f")
def detail_page_values(t: Table) -> DataFrame:
    firsts = _releases(t).groupBy("page_id").agg(F.min("k").alias("k"))
    line = _of("<div><span>Opening</span><span>$", F.col("k"), ",000</span></div><div><span>Genres</span> <span>Drama</span></div><div><span>Widest Release</span><span>", F.col("k"), " theaters</span></div>")
    return box_office.detail_values(blocks.blocks(_html(firsts, line)), ["Opening", "Genres", "Widest Release", "Budget"])


_CHART = f"""with r as ({RELEASES}), c as (select page_id, k, cast(k % 10 + 1 as varchar) as rank, 'Artist ' || k as artist, case when kind = 0 then '-' else cast(k % 9 + 1 as varchar) end as last_week, '1' as peak, cast(kind + 2 as varchar) as weeks,
date '2026-01-03' + cast(7 * (page_id % 20) as int) as chart_date, 'https://www.billboard.com/artist/' || k as artist_url from r)"""


def _chart_pages(t: Table) -> DataFrame:
    last = F.when(F.col("kind") == 0, "-").otherwise((F.col("k") % 9 + 1).cast("string"))
    item = _of('<div class="o-chart-results-list-row-container"><span>', F.col("k") % 10 + 1, '</span><a href="/artist/', F.col("k"), '"><h3 class="c-title">Artist ', F.col("k"), "</h3></a><span>", last, "</span><span>1</span><span>LAST WEEK</span><span>", F.col("kind") + 2, "</span></div>")
    said = _of("<p>Week of ", F.date_format(F.date_add(F.lit("2026-01-03").cast("date"), (F.col("page_id") % 20 * 7).cast("int")), "MMMM d, yyyy"), "</p>")
    return _html(_releases(t), item, heading=said)


def _chart(t: Table) -> DataFrame:
    return charts.chart_rows(_chart_pages(t))


@query(_CHART + "select page_id, rank, artist, last_week, peak, weeks, chart_date, artist_url from c")
def chart_pages(t: Table) -> DataFrame:
    return _chart(t).drop("pos")


@query(_CHART + "select page_id, rank, artist, chart_date, cast(rank as int) as place from c where last_week = '-' qualify row_number() over (partition by lower(artist), chart_date order by page_id) = 1")
def chart_new_entries(t: Table) -> DataFrame:
    found = charts.new_entries(_chart(t).withColumn("requested", F.lit(AS_OF)))
    return found.select("page_id", "rank", "artist", "chart_date", charts.rank_order().alias("place"))


@query(f"""with r as ({RELEASES}) select page_id, cast(k % 10 + 1 as varchar) as rank, 'Artist ' || k as artist, cast(kind as varchar) as last_week from r where kind > 0""")
def chart_embedded_json(t: Table) -> DataFrame:
    rows = _releases(t).filter("kind > 0")
    parts = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("k", "kind"))).alias("rows"))
    items = F.to_json(F.struct(F.lit("Artist 100").alias("name"), F.transform("rows", lambda x: F.struct((x["k"] % 10 + 1).alias("rank"), F.concat(F.lit("Artist "), x["k"]).alias("artistName"), x["kind"].alias("last_week"))).alias("items")))
    return charts.chart_rows(parts.select("page_id", _of("<script>", items, "</script>").alias("html"))).select("page_id", "rank", "artist", "last_week")


@query("select p_partkey as page_id, 'An artist of ' || p_brand || ' | Sings ' || p_name || ' | Genre: Pop' as details from part")
def artist_page_details(t: Table) -> DataFrame:
    meta = _of('<meta name="description" content="An artist of ', F.col("p_brand"), '"><meta property="og:description" content="An artist of ', F.col("p_brand"), '!">')
    data = _of('<script type="application/ld+json">{"description": "Sings ', F.col("p_name"), '", "genre": ["Pop", "pop"]}</script>')
    return charts.page_details(t("part").select(F.col("p_partkey").alias("page_id"), F.concat(meta, data).alias("html")))


@query(f"""with r as ({RELEASES}), v as (select *, lpad(cast(k // 2 as varchar), 11, 'v') as video_id from r), f as (select * from v qualify row_number() over (partition by video_id order by page_id, k) = 1)
select cast(row_number() over (order by page_id, k) as int) as "#", title as "Title", list_value('Official Trailer', 'Teaser', 'Trailer', 'Clip')[kind + 1] as "Trailer", video_id as "YouTube Video ID", 'https://www.youtube.com/watch?v=' || video_id as "YouTube URL",
'https://img.example.com/images/story/ytimg/' || video_id || '/default.jpg' as "Thumbnail URL", cast(k as varchar) as "MovieInsider Movie ID", 'story-' || k as "MovieInsider Slug", 'https://www.movieinsider.com/m' || k || '/story-' || k || '/videos/' || (k + 5) as "MovieInsider URL",
page_id as "Source Page", 'page ' || page_id as "Page URL" from f""")
def trailer_pages(t: Table) -> DataFrame:
    video = F.lpad(F.floor(F.col("k") / 2).cast("string"), 11, "v")
    label = F.when(F.col("kind") == 2, "").otherwise(_of('<p class="small text-muted">', _kind("Official Trailer", "Teaser", "", "Clip"), "</p>"))
    link = _of('<a href="https://www.movieinsider.com/m', F.col("k"), "/story-", F.col("k"), "/videos/", F.col("k") + 5, '">')
    image = _of('<img src="https://img.example.com/images/story/ytimg/', video, '/default.jpg" alt="', F.col("title"), ' trailer">')
    line = _of('<div class="trailers">', link, image, '</a><h3 class="media-heading">', link, F.substring("title", 1, 4), "...</a></h3>", label, "</div>", F.lit(" " * 600))
    pages = _html(_releases(t), line, after="<h2>Most Viewed</h2><img src='https://img.example.com/images/no/ytimg/zzzzzzzzzzz/x.jpg' alt='No trailer'>")
    return html.feed_rows(html.trailer_feed(pages.withColumnRenamed("page_id", "page_no"), "page_no"), page_url=_of("page ", F.col("page_no")))


@query("select p_partkey as page_id, p_name as name, date '2026-01-01' + cast(p_partkey % 300 as int) as release_date, 'Drama; Crime' as genres from part")
def json_ld_titles(t: Table) -> DataFrame:
    day = F.date_add(F.lit("2026-01-01").cast("date"), (F.col("p_partkey") % 300).cast("int"))
    body = _of('<script type="application/ld+json">[{"@type": "Person", "genre": "x"}, {"@type": "Movie", "name": "', F.col("p_name"), '", "datePublished": "', day.cast("string"), '", "genre": ["Drama", "drama", "Crime"]}]</script>')
    return lookups.ld_title(t("part").select(F.col("p_partkey").alias("page_id"), body.alias("html"))).withColumn("genres", F.array_join("genres", "; "))


@query("select p_partkey, date '2026-02-01' + cast(p_partkey % 200 as int) as first, date '2026-02-01' + cast(p_partkey % 200 + 7 * (p_size % 5) as int) as last, p_size % 5 + 1 as episodes from part")
def season_pages(t: Table) -> DataFrame:
    first = F.date_add(F.lit("2026-02-01").cast("date"), (F.col("p_partkey") % 200).cast("int"))
    said = F.transform(F.sequence(F.lit(0), F.col("p_size") % 5), lambda i: F.concat(F.lit("Episode "), i + 1, F.lit(" Aired "), F.date_format(F.date_add(first, i * 7), "MMM d, yyyy")))
    return spread(t("part")).select("p_partkey", seasons.season_context(F.array_join(said, " ")).alias("c")).select("p_partkey", "c.first", "c.last", "c.episodes")


@query("select p_partkey, greatest(p_size, p_size % 7 + 1) as episodes from part")
def episode_pages(t: Table) -> DataFrame:
    said = _of("S2.E", F.col("p_size"), " S3.E99 Episode #2.", F.col("p_size") % 7 + 1, " and 300 episodes")
    return t("part").select("p_partkey", seasons.page_episodes(said, F.lit(2)).alias("episodes"))


_SAID = "date '2026-02-10' + cast(p_partkey % 15 as int)"


@query(f"select p_partkey, {_SAID} + 3 as first_day, {_SAID} + 10 as second_day, {_SAID} + 30 as stated, case when p_size % 2 = 0 then 8 else 6 end as told from part")
def season_dates_told(t: Table) -> DataFrame:
    start = F.date_add(F.lit("2026-02-10").cast("date"), (F.col("p_partkey") % 15).cast("int"))
    day = lambda n: F.date_format(F.date_add(start, n), "MMM d")
    airs, ends = _of("Airs ", day(3), " and ", day(10)), _of("six episodes, then 8 S2 episodes, through ", day(30))
    return t("part").select("p_partkey", F.get(seasons.episode_dates(airs, start), F.lit(0)).alias("first_day"), F.get(seasons.episode_dates(airs, start), F.lit(1)).alias("second_day"), seasons.stated_end(ends, start).alias("stated"), seasons.told_episodes(ends, F.when(F.col("p_size") % 2 == 0, 2).otherwise(5)).alias("told"))


@query("""select p_partkey, p_name as name, case when p_size % 2 = 0 then '2026-04-01' else '2026-05-01' end as release_date, 'Drama' as genres, case when p_size % 2 = 0 then 'A; B' else 'N' end as network,
'tt' || (1000000 + p_partkey) as imdb_id from part""")
def title_answers(t: Table) -> DataFrame:
    film = _of('{"title": "', F.col("p_name"), '", "release_date": "2026-06-01", "genres": [{"name": "Drama"}], "production_companies": [{"name": "A"}, {"name": "B"}], "external_ids": {"imdb_id": "tt', F.col("p_partkey") + 1_000_000,
               '"}, "release_dates": {"results": [{"iso_3166_1": "GB", "release_dates": []}, {"iso_3166_1": "US", "release_dates": [{"type": 1, "release_date": "2026-03-01T00:00"}, {"type": 3, "release_date": "2026-04-01T00:00"}]}]}}')
    show = _of('{"name": "', F.col("p_name"), '", "first_air_date": "2026-05-01", "genres": [{"name": "Drama"}], "networks": [{"name": "N"}], "external_ids": {"imdb_id": "tt', F.col("p_partkey") + 1_000_000, '"}}')
    rows = t("part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, "movie").otherwise("tv").alias("kind"), F.when(F.col("p_size") % 2 == 0, film).otherwise(show).alias("body"))
    return lookups.title_candidates(rows).select("p_partkey", "name", "release_date", F.array_join("genres", "; ").alias("genres"), "network", "imdb_id")


@query("select p_partkey, generate_series - 1 as place, 'tt' || (p_partkey * 10 + generate_series) as imdb_id, p_name || ' ' || generate_series as name, '2020' as year from part, generate_series(1, 3) where p_size % 3 <> 0 union all select p_partkey, 0, 'tt' || p_partkey, p_name, '1999' from part where p_size % 3 = 0 and p_size % 2 = 0")
def search_answers(t: Table) -> DataFrame:
    hits = F.array_join(F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda i: F.concat(F.lit('{"imdbID": "tt'), F.col("p_partkey") * 10 + i, F.lit('", "Title": "'), F.col("p_name"), F.lit(" "), i, F.lit('", "Year": "2020-2021"}'))), ", ")
    one = _of('{"Response": "True", "imdbID": "tt', F.col("p_partkey"), '", "Title": "', F.col("p_name"), '", "Year": "1999", "totalSeasons": "2"}')
    body = F.when(F.col("p_size") % 3 != 0, _of('{"Response": "True", "Search": [', hits, "]}")).when(F.col("p_size") % 2 == 0, one).otherwise('{"Response": "False", "Error": "none"}')
    return lookups.search_candidates(t("part").select("p_partkey", body.alias("body"))).select("p_partkey", "place", "imdb_id", "name", "year")


@query("""select p_partkey, 'Q' || p_partkey as qid, p_name as label, 'singer' as description, 'https://en.wikipedia.org/wiki/Page_' || p_partkey || '_(x)' as article, 'musician; writer' as occupations, '' as gender, '1990-01-02' as born, 'nm' || (1000000 + p_partkey) as code from part""")
def entity_answers(t: Table) -> DataFrame:
    claims = _of('{"P106": [{"mainsnak": {"datavalue": {"value": {"id": "Q5"}}}}, {"mainsnak": {"datavalue": {"value": {"id": "Q6"}}}}], "P569": [{"mainsnak": {"datavalue": {"value": {"time": "+1990-01-02T00:00:00Z"}}}}], "P345": [{"mainsnak": {"datavalue": {"value": "nm', F.col("p_partkey") + 1_000_000, '"}}}]}')
    body = _of('{"entities": {"Q', F.col("p_partkey"), '": {"labels": {"en": {"value": "', F.col("p_name"), '"}}, "descriptions": {"en": {"value": "singer"}}, "sitelinks": {"enwiki": {"title": "Page ', F.col("p_partkey"), ' (x)"}}, "claims": ', claims, "}}}")
    parts = t("part").select("p_partkey", body.alias("body"))
    labels = parts.sparkSession.createDataFrame([("Q5", "musician"), ("Q6", "writer")], "qid string, label string")
    found = lookups.with_labels(lookups.entities(parts), labels, {"occupations": "P106", "gender": "P21"})
    return found.select("p_partkey", "qid", "label", "description", "article", "occupations", "gender", lookups.claim_time("claims", "P569").alias("born"), lookups.claim_text("claims", "P345").alias("code"))


@query("select p_partkey, case when p_size % 3 = 0 then 'b' || p_partkey else 'a' || p_partkey end as channel_id from part")
def best_channels(t: Table) -> DataFrame:
    item = lambda letter, title, url: _of('{"id": "', letter, F.col("p_partkey"), '", "snippet": {"title": "', title, '", "customUrl": "', url, '"}}')
    body = _of('{"items": [', item("a", "Other", "@other"), ", ", item("b", F.col("p_name"), F.when(F.col("p_size") % 2 == 0, "@x").otherwise("@TheNet")), "]}")
    rows = t("part").select("p_partkey", F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise("nobody").alias("wanted"), body.alias("body"))
    return lookups.best_channel(lookups.channels(rows), "wanted", ["p_partkey"]).select("p_partkey", "channel_id")


@query("select p_partkey, place, 'v' || (p_partkey + place) as video_id, date '2026-01-02' as published from part, (select unnest(list_value(0, 1)) as place)")
def video_answers(t: Table) -> DataFrame:
    item = lambda i: _of('{"id": {"videoId": "v', F.col("p_partkey") + i, '"}, "snippet": {"title": "T", "publishedAt": "2026-01-02T00:00:00Z", "channelId": "c"}}')
    rows = t("part").select("p_partkey", _of('{"items": [', item(0), ", ", item(1), ', {"id": {}}]}').alias("body"))
    return lookups.videos(rows).select("p_partkey", "place", "video_id", "published")


# Lookups of people, series, encyclopedia entries and artists.

_PEOPLE = "select c_custkey as code, 'Person ' || c_custkey % 50 as name, case c_custkey % 3 when 0 then 'actor,producer' when 1 then 'writer' else 'music department' end as work, case when c_custkey % 2 = 0 then '' else '2001' end as died, cast(1900 + c_custkey % 120 as int) as born from customer"


@query(f"""with people as ({_PEOPLE}), asked as (select distinct 'Person ' || s_suppkey % 60 as name, case when s_suppkey % 2 = 0 then 'Actor' else 'Writer' end as hint from supplier),
scored as (select a.name, a.hint, p.code, case when p.work is not null and ((a.hint = 'Actor' and p.work like 'actor%') or (a.hint = 'Writer' and p.work = 'writer')) then 40 else 0 end + case when died = '' then 10 else 0 end + least(greatest(born - 1900, 0), 100) as score from asked a left join people p on p.name = a.name)
select name, hint, code, case when code is not null then score end as score from scored qualify row_number() over (partition by name, hint order by score desc, code) = 1""")
def name_lookup(t: Table) -> DataFrame:
    k = F.col("c_custkey")
    people = t("customer").select(
        k.alias("code"), text.title_key(_of("Person ", k % 50)).alias("key"), F.when(k % 3 == 0, "actor,producer").when(k % 3 == 1, "writer").otherwise("music department").alias("work"), F.when(k % 2 == 0, "").otherwise("2001").alias("died"), (k % 120 + 1900).cast("int").alias("born")
    )
    asked = t("supplier").select(_of("Person ", F.col("s_suppkey") % 60).alias("name"), F.when(F.col("s_suppkey") % 2 == 0, "Actor").otherwise("Writer").alias("hint")).distinct().withColumn("key", text.title_key("name"))
    score = lambda: F.when(F.col("code").isNotNull(), scoring.name_score(F.col("work"), F.col("hint"), F.col("died"), F.col("born")))
    return resolve.best_match(asked, people, ["key"], ["name", "hint"], score, "code", keep=["code"])


@query("""with c as (select p_partkey as code, 'show ' || p_partkey % 40 as primary_key, 'serie ' || p_partkey % 30 as original_key, case p_size % 3 when 0 then 'tvSeries' when 1 then 'tvMiniSeries' else 'tvSpecial' end as kind, p_size + 1980 as year from part),
a as (select distinct 'Show ' || s_suppkey % 45 as name, case when s_suppkey % 3 = 0 then null else cast(1990 + s_suppkey % 20 as int) end as wanted from supplier union all select 'Serie 7', 2000),
met as (select a.*, c.* from a left join c on lower(a.name) in (c.primary_key, c.original_key)),
scored as (select *, case when primary_key = lower(name) then 60 else 0 end + case when original_key = lower(name) then 50 else 0 end + case when kind = 'tvSeries' then 30 when kind = 'tvMiniSeries' then 12 else 0 end
  + case when wanted is not null then case when abs(year - wanted) = 0 then 120 when abs(year - wanted) = 1 then 35 else -least(abs(year - wanted) * 3, 90) end else least(greatest(year - 1900, 0), 125) end as s from met)
select name, wanted, code, case when code is not null then s end as score from scored qualify row_number() over (partition by name, wanted order by s desc, code) = 1""")
def series_lookup(t: Table) -> DataFrame:
    k = F.col("p_partkey")
    shows = t("part").select(k.alias("code"), text.title_key(_of("Show ", k % 40)).alias("primary_key"), text.title_key(_of("Serie ", k % 30)).alias("original_key"),
                             F.when(F.col("p_size") % 3 == 0, "tvSeries").when(F.col("p_size") % 3 == 1, "tvMiniSeries").otherwise("tvSpecial").alias("kind"), (F.col("p_size") + 1980).alias("year"))
    asked = t("supplier").select(_of("Show ", F.col("s_suppkey") % 45).alias("name"), F.when(F.col("s_suppkey") % 3 == 0, None).otherwise(F.col("s_suppkey") % 20 + 1990).cast("int").alias("wanted")).distinct()
    asked = asked.union(asked.sparkSession.createDataFrame([("Serie 7", 2000)], "name string, wanted int")).withColumn("key", text.title_key("name"))
    score = lambda: F.when(F.col("code").isNotNull(), scoring.series_score(F.col("kind"), F.lit("tvSeries"), F.col("primary_key"), F.col("original_key"), F.col("key"), F.col("year"), F.col("wanted")))
    return resolve.best_match(asked, resolve.with_keys(shows, "primary_key", "original_key"), ["key"], ["name", "wanted"], score, "code", keep=["code"])


@query(f"""with s as (select p_partkey, {KEY.format('p_name')} as k, {KEY.format("p_name || case when p_size % 2 = 0 then ' two' else '' end")} as label, p_size from part)
select p_partkey, {SCORE.format('k', 'label')} + case when p_size % 3 = 0 then 30 else 0 end + case when p_size % 5 = 0 then 20 else 0 end + case when p_size % 4 = 0 then 5 else 0 end as article,
{SCORE.format('k', 'label')} + case when p_size % 3 = 0 then 25 else 0 end as artist from s""")
def entry_scores(t: Table) -> DataFrame:
    size = F.col("p_size")
    label = F.concat("p_name", F.when(size % 2 == 0, " two").otherwise(""))
    said = F.concat_ws(" ", F.when(size % 3 == 0, "work of 2020"), F.when(size % 5 == 0, "a film"))
    work = F.when(size % 3 == 0, "American songwriter and DJ").otherwise("husband of a groupie")
    return t("part").select("p_partkey", scoring.article_score(F.col("p_name"), label, said, F.lit(2020), ["film"], size % 4 == 0).alias("article"), scoring.artist_score(F.col("p_name"), label, work).alias("artist"))


# Dedupes by their own keys.


@query(f"select min(p_partkey) as p_partkey, {KEY.format('p_name')} as key, p_size from part where p_size % 5 <> 0 group by 2, 3")
def dedupe_by_title_and_day(t: Table) -> DataFrame:
    rows = t("part").withColumn("key", F.when(F.col("p_size") % 5 == 0, "").otherwise(text.title_key("p_name")))
    return dedupe.keep_first(rows, ["key", "p_size"], ["p_partkey"], drop_blank="key").select("p_partkey", "key", "p_size")


@query("select min(p_partkey) as p_partkey, case when p_size % 5 = 0 then '' else lower(p_name) end as title, p_size from part group by 2, 3")
def dedupe_blank_titles_kept(t: Table) -> DataFrame:
    rows = t("part").withColumn("title", F.when(F.col("p_size") % 5 == 0, "").otherwise(F.lower("p_name")))
    return dedupe.keep_first(rows, ["title", "p_size"], ["p_partkey"]).select("p_partkey", "title", "p_size")


@query("with r as (select c_custkey, case when c_custkey % 7 = 0 then '' else cast(c_custkey % 120 as varchar) end as rank, 'Artist ' || c_custkey % 30 as artist from customer) select min(c_custkey) as c_custkey, rank, artist, coalesce(try_cast(nullif(rank, '') as int), 999) as place from r where rank <> '' group by rank, artist")
def dedupe_rank_and_artist(t: Table) -> DataFrame:
    rows = t("customer").select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, "").otherwise((F.col("c_custkey") % 120).cast("string")).alias("rank"), _of("Artist ", F.col("c_custkey") % 30).alias("artist"))
    return dedupe.keep_first(rows, ["rank", "artist"], ["c_custkey"], drop_blank="rank").select("c_custkey", "rank", "artist", charts.rank_order().alias("place"))


# Text and dates.


@query(r"""select p_partkey, trim(regexp_replace(p_name || '  ' || p_brand || ' ', '\s+', ' ', 'g')) as squashed, case when p_size % 3 = 0 then '/release/rl' || p_partkey else trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) end as identity,
case when p_size between 10 and 29 then cast(1900 + p_size as varchar) else '' end as year, p_size as number, case when p_size % 2 = 0 then p_name else null end as dar from part""")
def text_pieces(t: Table) -> DataFrame:
    size = F.col("p_size")
    url = F.when(size % 3 == 0, _of("https://www.boxofficemojo.com/release/rl", F.col("p_partkey"), "/?ref=x")).otherwise("")
    said = F.when(size.between(10, 29), _of("made in ", size + 1900, " or so")).otherwise("no year")
    return t("part").select(
        "p_partkey", text.squash(F.concat("p_name", F.lit(" \t "), "p_brand", F.lit(" "))).alias("squashed"), F.rtrim(text.release_identity(url, "p_name"), F.lit("/")).alias("identity"),
        text.year_text(said).alias("year"), text.safe_int(_of(size, " ")).cast("int").alias("number"), F.when(text.is_dar(F.concat("p_name", F.when(size % 2 == 0, " - DAR").otherwise(""))), text.dar_base(_of(F.col("p_name"), " - DAR"))).alias("dar"),
    )


@query("select cast(page_id as bigint) as page_id, cast(row_number() over (partition by page_id order by k) as int) as place, title from (" + RELEASES + ")")
def pasted_title_lines(t: Table) -> DataFrame:
    rows = _releases(t)
    pasted = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("k", "title"))).alias("x")).select("page_id", F.concat(F.lit("\n "), F.array_join("x.title", ",\n"), F.lit(", "), F.upper(F.get("x.title", F.lit(0)))).alias("value"))
    found = box_office.title_lines(pasted, "value", "page_id")
    return found.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy("place")).cast("int")).select("page_id", "place", "title")
