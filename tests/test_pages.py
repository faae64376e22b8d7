"""Calendars, box-office pages, charts and catalogue answers, on hand-made pages."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from cinelake.functions import seasons
from cinelake.sources import blocks, box_office, calendars, charts, lookups

AS_OF = dt.date(2026, 3, 1)


def page(spark, *html):
    return spark.createDataFrame(list(enumerate(html)), "page_id long, html string")


def rows_of(spark, *html):
    return blocks.blocks(page(spark, *html))


TV = """<html><body><article><p>2026</p><h3>MON / Mar 2</h3>
<p>Image: new series</p><p>81 Deep Water</p><p>Drama: a diver returns 9p Netflix</p><p>(also on Hulu) 6 episodes: all at once</p>
<p>Old Town Season 3 Trailer</p><p>Reality Food</p><h3>TUE / Jan 5, 2027</h3><p>advertisement</p><p>Late One</p><p>Comedy: jokes</p></article>
<a href="/tv/deep-water">Deep Water</a></body></html>"""


def test_tv_lines(spark):
    got = {r.title: r for r in calendars.tv_calendar(rows_of(spark, TV, "", None), AS_OF).collect()}
    assert got["81 Deep Water"].release_date == dt.date(2026, 3, 2)
    assert (got["81 Deep Water"].genre, got["81 Deep Water"].availability) == ("Drama", "Netflix")
    assert got["81 Deep Water"].daypart == "Primetime" and got["81 Deep Water"].score == "81"
    assert got["81 Deep Water"].details == "a diver returns 9p (also on"
    assert (got["Old Town Season 3"].release_type, got["Old Town Season 3"].availability) == ("Returning Series", "Food")
    assert got["Late One"].release_date == dt.date(2027, 1, 5)
    assert got["Late One"].page_url == "https://www.metacritic.com/tv/late-one/"


def test_tv_tables_win_over_lines(spark):
    table = """<main><h2>SUN / Feb 1</h2><table><tr><td>tbd</td><td><img alt="new series"><a href="/tv/x">X &amp; Y</a> <a href="https://youtube.com/1">Trailer</a> Crime/Drama: who did it</td><td>HBO Max</td></tr>
    <tr><td>77</td><td>Plain One Comedy: laughs</td></tr></table></main>"""
    got = {r.title: r for r in calendars.tv_calendar(rows_of(spark, table), AS_OF).collect()}
    x = got["X & Y"]
    assert (x.release_type, x.genre, x.details, x.availability, x.score) == ("New Series", "Crime/Drama", "who did it", "HBO Max", "tbd")
    assert x.source_url == x.page_url == "https://www.metacritic.com/tv/x" and x.release_date == dt.date(2026, 2, 1)
    assert (got["Plain One"].genre, got["Plain One"].score) == ("Comedy", "77")


def test_movies(spark):
    html = """<body><h3>FRI / Mar 6</h3><p>77</p><p>Big Film</p><p>-</p><p>Trailer</p><p>(Some Studio)</p><p>Action/Thriller WIDE; IMAX</p><p>more text</p>
    <p>tbd Small Film</p><p>Drama Streaming (Netflix)</p></body>"""
    got = {r.title: r for r in calendars.movie_calendar(rows_of(spark, html), AS_OF).collect()}
    assert (got["Big Film"].studio, got["Big Film"].genre, got["Big Film"].availability) == ("Some Studio", "Action/Thriller", "WIDE; IMAX")
    assert got["Big Film"].details == "more text" and got["Big Film"].score == "77"
    assert (got["Small Film"].availability, got["Small Film"].content_format) == ("Streaming (Netflix)", "Streaming Movie")


def test_availability_inside_words_counts(spark):
    got = spark.range(1).select(calendars.availability_values(F.lit("Atlanta only, Limited/VOD")).alias("v")).first().v
    assert got == ["Limited/VOD", "LA"]


@pytest.mark.parametrize("html", [
    "<body><p>88 Star Game PC PS5</p><p>RPG - March 9, 2026 - early access</p><p>noise</p></body>",
    "<body><table><tr><td>88</td><td><a href='/game/star-game'>Star Game</a> PC PS5 RPG - March 9, 2026 - early access</td></tr></table></body>",
])
def test_games(spark, html):
    (g,) = calendars.game_calendar(rows_of(spark, html), AS_OF).collect()
    assert (g.title, g.availability, g.genre, g.details, g.score) == ("Star Game", "PC PS5", "RPG", "early access", "88")
    assert g.release_date == dt.date(2026, 3, 9)


def test_box_office_calendar(spark):
    html = """<table><tr><th>Release</th><th>D</th><th>S</th></tr><tr><td>Friday, March 6, 2026</td></tr>
    <tr><td><a href="/release/rl1/?ref=x"><h3>One</h3></a> Action Drama With: A B 1 hr 40 min</td><td>Acme</td><td>Wide</td></tr>
    <tr><td>Two Comedy 95 min</td><td>Beta</td><td>Limited</td></tr><tr><td>Sunday, May 3, 2026</td></tr><tr><td>Late</td><td></td><td></td></tr></table>"""
    got = {r.title: r for r in box_office.release_calendar(rows_of(spark, html), AS_OF, dt.date(2026, 4, 1)).collect()}
    assert set(got) == {"One", "Two"}
    assert (got["One"].genre, got["One"].running_time, got["One"].details) == ("Action Drama", "1 hr 40 min", "With: A B")
    assert got["One"].source_url == "https://www.boxofficemojo.com/release/rl1/?ref=x" and got["Two"].distributor == "Beta"


def test_upcoming_releases(spark):
    html = """<div id="table"><table><tr class="mojo-group-label"><th>March 6, 2026</th></tr><tr><td><img src="p.jpg"><a href="/title/tt1234567/"><h3>One</h3></a>
    <span>10th Anniversary</span><div class="mojo-schedule-genres">Action<br>Drama</div>With: A, B 2 hr <a href="/release/rl9/">x</a></td><td>Acme</td><td></td></tr></table></div>"""
    (r,) = box_office.upcoming_releases(rows_of(spark, html)).collect()
    assert (r.title, r.tt_code, r.release_id, r.genres, r.release_type, r.scale) == ("One", "tt1234567", "rl9", ["Action", "Drama"], "Anniversary", "Unknown")
    assert (r.note, r.cast, r.runtime, r.poster_url) == ("10th Anniversary", "A, B", "2 hr", "p.jpg")


def test_schedule_changes_stop_after_the_window(spark):
    def listing(day, name):
        return f"""<table><tr><th>Release</th><th>Distributor</th><th>Scale</th><th>Old Date</th><th></th><th>New Date</th></tr><tr><td colspan="6">{day}</td></tr>
        <tr><td>{name}</td><td>Acme</td><td>Wide</td><td>Mar 1, 2026</td><td class="mojo-field-type-shim">-></td><td>Mar 8, 2026</td></tr></table>"""

    pages = rows_of(spark, listing("Mar 3, 2026", "A"), listing("Feb 1, 2026", "B"), listing("Mar 2, 2026", "never read"))
    changes = box_office.schedule_changes(pages)
    assert {r.new_date for r in changes.collect()} == {"Mar 8, 2026"}
    got = box_office.changes_feed(changes, dt.date(2026, 2, 20), dt.date(2026, 3, 4)).collect()
    assert [r.release for r in got] == ["A"]
    assert box_office.changes_feed(changes.filter("false"), AS_OF, AS_OF).count() == 0


def test_weekend_ranks_and_details(spark):
    html = "<table><tr><td>1</td><td><a href='/release/rl5/'>Some Film!</a></td></tr><tr><td>x</td><td><a href='/release/rl6/'>No</a></td></tr></table><div><span>Opening</span><span>$5,000</span></div><div><span>Genres</span> <span>Drama</span></div>"
    rows = rows_of(spark, html)
    assert {(r.key_kind, r.key): r["rank"] for r in box_office.weekend_ranks(rows).collect()} == {("release", "rl5"): "1", ("title", "some film"): "1"}
    assert {r.label: r.value for r in box_office.detail_values(rows, ["Opening", "Genres", "Widest Release"]).collect()} == {"Opening": "$5,000", "Genres": "Drama"}


def test_title_lines(spark):
    got = box_office.title_lines(spark.createDataFrame([(" One, two\nONE\n\nThree",)], "value string")).orderBy("place").collect()
    assert [r.title for r in got] == ["One", "two", "Three"]


def test_charts(spark):
    box = """<div class="o-chart-results-list-row-container"><span>1</span><a href="/artist/abc"><h3 class="c-title">ABC</h3></a><span>-</span><span>1</span><span>LAST WEEK</span><span>12</span></div>"""
    js = """<p>Week of March 7, 2026</p><script>{"name": "Artist 100", "items": [{"rank": 2, "artistName": "XYZ", "last_week": "3"}, {"rank": 2, "artistName": "XYZ"}]}</script>"""
    pages = page(spark, box, js, "<p>none</p>")
    rows = charts.chart_rows(pages)
    got = {r.artist: r for r in rows.collect()}
    assert (got["ABC"]["rank"], got["ABC"].last_week, got["ABC"].peak, got["ABC"].weeks) == ("1", "-", "1", "12")
    assert got["ABC"].artist_url == "https://www.billboard.com/artist/abc"
    assert (got["XYZ"]["rank"], got["XYZ"].last_week, got["XYZ"].chart_date) == ("2", "3", dt.date(2026, 3, 7))
    assert [r.page_id for r in charts.empty_pages(pages, rows).collect()] == [2]
    fresh = charts.new_entries(rows.withColumn("requested", F.lit(AS_OF)))
    assert [r.artist for r in fresh.collect()] == ["ABC"]


def test_page_details(spark):
    html = '<meta name="description" content="An artist"><meta property="og:description" content="An artist!"><script type="application/ld+json">{"description": "Sings", "genre": ["Pop", "pop"]}</script>'
    assert charts.page_details(page(spark, html, "")).orderBy("page_id").collect()[0].details == "An artist | Sings | Genre: Pop"


def test_title_answers(spark):
    film = {"title": "F", "release_date": "2026-05-01", "genres": [{"name": "Drama"}], "production_companies": [{"name": "A"}, {"name": "B"}], "external_ids": {"imdb_id": "tt7"},
            "release_dates": {"results": [{"iso_3166_1": "US", "release_dates": [{"type": 1, "release_date": "2026-03-01T0"}, {"type": 3, "release_date": "2026-04-01T0"}]}]}}
    show = {"name": "S", "first_air_date": "2026-01-01", "networks": [{"name": "N"}], "seasons": [{"season_number": 0, "episode_count": 9}, {"season_number": 2, "episode_count": 8, "air_date": "2026-02-02"}], "last_air_date": "2026-02-20"}
    df = spark.createDataFrame([(1, "movie", json.dumps(film), 0), (2, "tv", json.dumps(show), 5), (3, "tv", "broken", 0)], "id int, kind string, body string, preferred int")
    got = {r.id: r for r in lookups.season_fields(lookups.title_candidates(df), "preferred").collect()}
    assert (got[1].release_date, got[1].network, got[1].genres, got[1].imdb_id) == ("2026-04-01", "A; B", ["Drama"], "tt7")
    assert (got[2].season, got[2].episodes, got[2].season_date, got[2].last_date) == (2, 8, dt.date(2026, 2, 2), dt.date(2026, 2, 20))
    assert got[3].name == "" and got[3].season is None


def test_entity_answers(spark):
    claim = lambda v: [{"mainsnak": {"datavalue": {"value": v}}}]
    entity = {"entities": {"Q1": {"labels": {"en": {"value": "Ann Lee"}}, "descriptions": {"en": {"value": "singer"}}, "sitelinks": {"enwiki": {"title": "Ann Lee (singer)"}},
                                  "claims": {"P106": claim({"id": "Q5"}), "P569": claim({"time": "+1990-01-02T00:00:00Z"}), "P345": claim("nm1234567")}}}}
    found = lookups.entities(spark.createDataFrame([(json.dumps(entity),)], "body string"))
    labels = spark.createDataFrame([("Q5", "musician")], "qid string, label string")
    r = lookups.with_labels(found, labels, {"occupations": "P106", "gender": "P21"}).withColumns({"born": lookups.claim_time("claims", "P569"), "code": lookups.claim_text("claims", "P345")}).first()
    assert (r.article, r.occupations, r.gender, r.born, r.code) == ("https://en.wikipedia.org/wiki/Ann_Lee_(singer)", "musician", "", "1990-01-02", "nm1234567")


def test_search_videos_channels(spark):
    search = spark.createDataFrame([('{"Response": "True", "Search": [{"imdbID": "tt1", "Title": "A", "Year": "2020-2021"}]}',), ('{"Response": "False"}',)], "body string")
    assert [(r.imdb_id, r.year) for r in lookups.search_candidates(search).collect()] == [("tt1", "2020")]
    vids = {"items": [{"id": {"videoId": "v1"}, "snippet": {"title": "T", "publishedAt": "2026-01-02T00:00:00Z", "channelId": "c"}}, {"id": {}}]}
    assert [(r.video_id, r.published) for r in lookups.videos(spark.createDataFrame([(json.dumps(vids),)], "body string")).collect()] == [("v1", dt.date(2026, 1, 2))]
    chans = {"items": [{"id": "1", "snippet": {"title": "Other"}}, {"id": "2", "snippet": {"title": "The Net", "customUrl": "@thenet"}}]}
    found = lookups.channels(spark.createDataFrame([(1, "@TheNet", json.dumps(chans)), (2, "zzz", json.dumps(chans))], "id int, wanted string, body string"))
    assert {r.id: r.channel_id for r in lookups.best_channel(found, "wanted", ["id"]).collect()} == {1: "2", 2: "1"}


def test_json_ld(spark):
    html = """<script type="application/ld+json">[{"@type": "Person", "genre": "x"}, {"@type": "Movie", "name": "M", "datePublished": "2026-02-03", "genre": ["Drama", "drama", "Crime"]}]</script>"""
    (r,) = lookups.ld_title(page(spark, html, "<p>")).collect()
    assert (r.name, r.release_date, r.genres) == ("M", dt.date(2026, 2, 3), ["Drama", "Crime"])


def test_seasons_in_text(spark):
    text = "six episodes, then 8 S2 episodes. Airs Mar 5 and Jan. 3 through April 9"
    df = spark.createDataFrame([(text, dt.date(2026, 2, 1), 2)], "t string, start date, s int")
    r = df.select(seasons.episode_dates("t", "start").alias("days"), seasons.stated_end("t", "start").alias("end"), seasons.told_episodes("t", "s").alias("n"), seasons.told_episodes("t", F.lit(3)).alias("m"),
                  seasons.page_episodes(F.lit("S2.E7 S3.E99 Episode #2.11 300 episodes"), "s").alias("p")).first()
    assert r.days == [dt.date(2026, 3, 5), dt.date(2027, 1, 3), dt.date(2026, 4, 9)]
    assert (r.end, r.n, r.m, r.p) == (dt.date(2026, 4, 9), 8, 6, 11)
    c = df.select(seasons.season_context(F.lit("Episode 1 Mar 1, 2026 Episode 2 Mar 8, 2026 Episode 1 Mar 2, 2026")).alias("c")).first().c
    assert (c.first, c.last, c.episodes) == (dt.date(2026, 3, 2), dt.date(2026, 3, 8), 2)


def test_large_pages_are_read_in_parts(spark, monkeypatch):
    """Parts of a large page are the rows of the whole page, and none of them holds all."""
    rows = "".join(f'<tr class="r"><td>{i} &amp; <b>x</b></td><td><a href="/r{i}">Title {i}</a> text\nmore</td></tr>' for i in range(400))
    html = f"<html><head><title>T</title><script>if (a < b) '<p>'</script></head><body><p>before</p><main><h2>Head</h2><table>{rows}</table><p>last</p></main><p>after <a href='/z'>z</a></p></body></html>"
    whole = blocks.read(html)
    monkeypatch.setattr(blocks, "PIECE", 500)
    parts = list(blocks.read_parts(html))
    assert [r for p in parts for r in p] == whole and max(map(len, parts)) < 60
    assert list(blocks.read_parts(None)) == [[]]


def test_pages_details_are_made_by_more_than_one_task(spark):
    from cinelake.sources import charts

    html = '<script type="application/ld+json">{"description": "Sings", "genre": ["Pop", "", "pop", "Rock", "-"], "birthPlace": {"name": "Rome"}}</script>'
    found = charts.page_details(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string").coalesce(1))
    assert sorted(map(tuple, found.collect())) == [(1, "Sings | Genre: Pop; Rock; Birth place: Rome"), (2, "")]
    assert "RoundRobinPartitioning" in found._jdf.queryExecution().executedPlan().toString()


def test_a_feed_of_changes_parses_no_page_again_for_its_rows(spark):
    import datetime as dt

    from cinelake.sources import blocks, box_office

    html = "<table><tr><th>Release</th><th>Old Date</th><th>New Date</th></tr><tr><td colspan=5>Mar 22, 2026</td></tr><tr><td>A</td><td>H</td><td>Wide</td><td>Apr 1, 2026</td><td>Apr 8, 2026</td></tr></table>"
    changes = box_office.schedule_changes(blocks.blocks(spark.createDataFrame([(1, html)], "page_id long, html string")))
    feed = box_office.changes_feed(changes, dt.date(2026, 3, 21), dt.date(2026, 3, 26))
    assert [(r.release, r.posted) for r in feed.collect()] == [("A", dt.date(2026, 3, 22))]
    assert "MapInArrow" not in feed._jdf.queryExecution().executedPlan().toString()


def test_a_weekends_chart_comes_in_pages_of_bounded_size(spark, monkeypatch):
    from cinelake.operators import trackers as operators
    from cinelake.plans import registry, trackers  # noqa: F401 (the registry comes first)

    monkeypatch.setattr(trackers, "CHART_KEYS", 70)
    sizes = []
    for n in (210, 840):
        pages = trackers._weekends(lambda name, n=n: spark.range(n).withColumnRenamed("id", "p_partkey")).collect()
        assert sum(p.html.count("<tr>") for p in pages) == n - n // 7
        sizes.append(max(p.html.count("<tr>") for p in pages))
    assert sizes[1] <= 70
    chart = lambda *rows: "<table>" + "".join(f'<tr><td>{rank}</td><td><a href="/release/{code}/">{title}</a></td></tr>' for rank, code, title in rows) + "</table>"
    sunday = dt.date(2026, 3, 8)
    charts_ = [(sunday, 1, chart((9, "rl1", "One"), (7, "rl2", "Two"))), (sunday, 0, chart((3, "rl1", "One")))]
    day = "<table><tr><td>Friday, March 6, 2026</td></tr>"
    lines = [f'<tr><td><a href="/release/rl{k}/"><h3>{t}</h3></a> Drama</td><td>House</td><td>Wide</td></tr>' for k, t in ((1, "One"), (2, "Two"))]
    found = operators.recent_openings(
        page(spark, day + "".join(lines) + "</table>"), spark.createDataFrame([], "url string, html string"),
        spark.createDataFrame(charts_, "sunday date, part int, html string"), dt.date(2026, 3, 3), dt.date(2026, 3, 15),
    )
    assert {r.title: r["rank"] for r in found.collect()} == {"One": "3", "Two": "7"}
