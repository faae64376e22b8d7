import datetime as dt

from pyspark.sql import functions as F

from cinelake.operators import changes, dedupe, facets, history, ingest, resolve, rollup, validate
from cinelake.plans import registry
from cinelake.sources import books, html, sinks, tsv, workbook


def rows(df, *by):
    return [tuple(r) for r in (df.orderBy(*by) if by else df).collect()]


def test_first_and_last_of_a_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("A", 2, "y"), ("", 3, "z")], "k string, n int, v string")
    assert rows(dedupe.keep_first(df, [F.lower("k")], ["n"], drop_blank="k")) == [("a", 1, "x")]
    assert rows(dedupe.keep_last(df, [F.lower("k")], ["n"]), "n") == [("A", 2, "y"), ("", 3, "z")]


def test_best_match_breaks_ties_by_code_and_keeps_misses(spark):
    probes = spark.createDataFrame([("p1", "dune"), ("p2", "none")], "id string, key string")
    found = spark.createDataFrame([("dune", "tt2", 5), ("dune", "tt1", 5), ("dune", "tt0", 4)], "key string, code string, s int")
    assert rows(resolve.best_match(probes, found, ["key"], ["id"], lambda: F.col("s"), "code", keep=["code"]), "id") == [("p1", "tt1", 5), ("p2", None, None)]


def test_seasons_count_leading_digits(spark):
    df = spark.createDataFrame([("s", "2a", "1"), ("s", "2", "2"), ("s", "0", "9"), ("s", "1", "1"), ("t", "", "1")], "p string, s string, e string")
    assert rows(rollup.latest_season(df, "p", "s", "e")) == [("s", 2, 2)]


def test_limited_runs_that_go_wide(spark):
    cols = "title string, url string, release_date string, scale string"
    now = spark.createDataFrame([("Dune", "", "2024-03-01", "Wide"), ("Fox", "", "2024-01-01", "Wide"), ("New", "", "2024-01-01", "Wide")], cols)
    before = spark.createDataFrame([("Dune", "/release/rl1/", "2024-02-01", "Limited", 1), ("Fox", "", "2024-01-01", "Wide", 1)], cols + ", snapshot_order int")
    out = changes.release_changes(now, before).select("title", "old_date", "change_type", "change").collect()
    assert [tuple(r) for r in out] == [("Dune", "2024-02-01", "Date change + Limited → Wide expansion", "Moved later by 29 days")]


def test_facets(spark):
    df = spark.createDataFrame([("Dune", ["Sci-Fi"], "Wide"), ("Fox", ["Family"], "")], "t string, g array<string>, s string")
    assert rows(facets.facet_filter(df, " dune ", ["t"], {"g": ""}, {"s": "Wide"}).select("t")) == [("Dune",)]
    assert rows(facets.facet_values(df, "s")) == [("Wide",)]
    assert ("s", "Wide", 1) in rows(facets.facet_counts(df, ["s"]))


def test_limit_comes_before_the_time_filter(spark):
    df = spark.createDataFrame([(1, "2024-01-05T00:00:00"), (2, "2024-01-01T00:00:00"), (3, "bad")], "run_id int, created_at string")
    assert rows(history.runs_since(df, dt.datetime(2024, 1, 2), 2).select("run_id")) == [(3,)]


def test_twins_and_placeholders(spark):
    df = spark.createDataFrame([(0, "Dune - DAR", "N/A", "TT0000001"), (1, "  ", "x", "")], "o int, `Title Name` string, Distributor string, `IMDb URL` string")
    profile = ingest.Profile("Movies", ["Title Name"], {"network": (["distributor"], ingest.distributor), "imdb_id": (["IMDb URL"], ingest.imdb_page)})
    out = ingest.ingest_rows(df, profile, "o").select("title", "network", "imdb_id", "twitter_handle").collect()
    assert [tuple(r) for r in out] == [(t, "", "https://www.imdb.com/title/TT0000001", "") for t in ("Dune", "Dune - DAR")]
    assert ingest.profile_for("TV").category == "TV Shows" and ingest.profile_for("verifier") is None and len(ingest.PROFILES) == 26


def test_rules_stop_where_they_must(spark):
    full = {"sheet": "s", "row_no": 2, "title": "Dune", "title_category": "Movies", "title_sub_category": "Film", "genre": "Sci-Fi", "primary_genre": "Science Fiction", "companies": "Acme", "brand_set": "Competitive View", "facebook_page": "https://x.com/a; facebook.com/pages/b", "imdb_id": "tt1234567", "imdb_url": "https://www.imdb.com/title/tt7654321/", "metacritic_url": "metacritic.com/movie/dune", "twitter_search_terms": "a", "twitter_search_term_keywords": "b", "wikipedia_url": "https://fr.wikipedia.org/wiki/Dune", "url_managers": "acme, x.com/a, facebook.com/pages/b"}
    schema = "sheet string, row_no int, " + ", ".join(f"{k} string" for k in list(full)[2:])
    out = validate.report(spark.createDataFrame([tuple(full.values())], schema)).orderBy("issue_no").select("rule").collect()
    assert [r[0] for r in out] == ["Facebook URL", "Facebook URL path", "IMDb consistency", "Wikipedia English URL"]
    assert validate.missing_columns(["Title", "Category", "genres"]) == ["title_sub_category", "primary_genre", "companies", "brand_set", "facebook_page"]


def test_talent_and_lookup_rules(spark):
    df = spark.createDataFrame([("Ann", "Talent", "Actor", "", None, "nm0000009"), ("Ann", "Talent", "Female Actor", "nm0000001", None, "nm0000009")], "title string, category string, sub_category string, imdb_id string, genre string, found_name string")
    found = {r.rule for r in validate.report(df).collect()}
    assert {"Talent sub-category", "IMDb name.basics lookup"} <= found


def test_dumps_are_filtered_at_the_scan(spark, tmp_path):
    import gzip

    head = "\t".join(tsv.TITLE_COLUMNS)
    with gzip.open(tmp_path / "t.tsv.gz", "wt") as f:
        f.write(head + "\n" + "\t".join(["tt1", "movie", 'A "quoted', "A", "0", "1999", "\\N", "\\N", "Drama"]) + "\n" + "\t".join(["tt2", "movie", "B", "B", "1", "1999", "\\N", "\\N", "\\N"]) + "\n" + "\t".join(["tt3", "short", "C", "C", "0", "\\N", "\\N", "\\N", "\\N"]) + "\n")
    out = tsv.titles(spark, str(tmp_path / "t.tsv.gz")).collect()
    assert [(r.tconst, r.primary_title, r.end_year, r.normalized_primary) for r in out] == [("tt1", 'A "quoted', "", "a quoted")]


def test_workbooks_find_their_header(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿report,,\nTitle,Title_Category,genre,Title\nDune,Movies,Sci-Fi,again\n,,,\n".encode())
    sheet = books.table_sheet(spark.createDataFrame([("Fox", "TV Shows")], "title string, category string"), ["title", "category"], ["title"], "One")
    books.write_book(spark, str(tmp_path / "b.xlsx"), [sheet])
    out = workbook.as_columns(workbook.parsed_rows(workbook.read_cells(spark, str(tmp_path)))).select("sheet", "row_no", "title", F.coalesce("title category", "category").alias("c"))
    assert rows(out, "sheet") == [("CSV", 3, "Dune", "Movies"), ("One", 2, "Fox", "TV Shows")]


def card(title, slug, video, heading=None):
    return f'<a href="/m12/{slug}/videos/7"><img src="https://x.test/images/{slug}/ytimg/{video}/0.jpg" alt="{title} trailer"></a><h3 class="media-heading">{heading or title}</h3><p class="small x">Official Teaser</p>'


def test_trailer_feed_stops_at_the_first_empty_page(spark):
    pages = [(1, card("Fire &amp; Ice", "fire-ice", "a" * 11) + card("B", "b", "b" * 11) + "<h2>Most Viewed</h2>" + card("B", "b", "c" * 11)), (2, card("A long...", "long", "d" * 11, "A long one") + card("B", "b", "b" * 11)), (3, "<p>none</p>"), (4, card("E", "e", "e" * 11))]
    out = html.trailer_feed(spark.createDataFrame(pages, "page_no int, html string")).orderBy("number").select("number", "title", "label", "page_no").collect()
    assert [tuple(r) for r in out] == [(1, "Fire & Ice", "Official Teaser", 1), (2, "B", "Official Teaser", 1), (3, "A long one", "Official Teaser", 2)]


def test_lines_links_and_tables(spark):
    page = "<title>T</title><script>var a='<p>';</script><p>One <b>two</b></p><ul><li>x</li></ul><table><tr><td>a</td><td>b</td></tr></table><a href='/u'>go</a>"
    df = spark.createDataFrame([(1, page), (2, None)], "page_id int, html string")
    assert [r.line for r in html.lines(df).orderBy("pos").collect()] == ["T", "One two", "x", "a", "b", "go"]
    assert rows(html.links(df)) == [(1, 0, "/u", "go")] and rows(html.table_rows(df)) == [(1, 1, 0, ["a", "b"])]


def test_csv_has_a_mark_and_quotes(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([('say "hi"', None)], "a string, b string").coalesce(1), str(tmp_path / "o"), ["a", "b", "c"], quote_all=True)
    text = next((tmp_path / "o").glob("part-*")).read_bytes().decode()
    assert text.startswith('"﻿a"') and '"say ""hi""","",""' in text
    assert sinks.insert_after(["a", "c"], "b", "a") == ["a", "b", "c"]


def test_streams_keep_the_first_row(spark, tmp_path):
    from cinelake.streaming import feeds

    df = spark.createDataFrame([("u1", dt.datetime(2024, 1, 1)), ("u1", dt.datetime(2024, 1, 1, 0, 5)), ("u2", dt.datetime(2024, 1, 1))], "url string, ts timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = feeds.first_seen(feeds.landed(spark, str(tmp_path / "in"), df.schema), ["url"], "ts")
    feeds.append_to(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_queries_take_the_whole_tables(spark, tmp_path):
    def put(name, data, schema):
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))

    put("documents", [(3, "en", "A" * 60 + "x"), (1, "en", "a" * 60 + "X"), (2, "en", "a" * 60 + "y"), (4, "fr", "a" * 60 + "x"), (5, "en", ""), (6, "en", None)], "doc_id long, lang string, text string")
    put("conversations", [(1, 0, "user", "h" * 30), (1, 1, "assistant", "t")], "conv_id long, turn int, role string, text string")
    put("orders", [(i, i) for i in range(1100)], "o_orderkey long, o_custkey long")
    put("customer", [(i, i) for i in range(1100)], "c_custkey long, c_nationkey long")
    put("nation", [(i, "N") for i in range(1100)], "n_nationkey long, n_name string")
    run = lambda name: registry.QUERIES[name](spark, str(tmp_path))
    assert [r.doc_id for r in run("dedupe_keep_first").orderBy("doc_id").collect()] == [1, 2, 4]
    assert {r.heading for r in run("heading_carry_forward").collect()} == {"h" * 30}
    assert [(r.distributor, r.n) for r in run("top12_distributors").collect()] == [("N", 1100)]


def test_candidates_that_a_score_cannot_tell_apart_meet_a_probe_once(spark):
    """Copies of a catalogue row are one candidate, that of the smallest code."""
    from cinelake.operators import resolve

    rows = [("k", "a", 1, code) for code in range(50, 10, -1)] + [("k", "b", 1, 5), ("k", None, 1, 7), ("k", None, 1, 6)]
    found = resolve.first_alike(spark.createDataFrame(rows, "key string, kind string, year int, code long"), ["key", "kind", "year"], "code")
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([("k", "a", 1, 11), ("k", "b", 1, 5), ("k", None, 1, 6)], key=repr)


def test_a_larger_catalogue_brings_verification_no_more_candidates(spark):
    from cinelake.plans import registry

    parts = lambda n: spark.range(n).selectExpr("id as p_partkey", "'red bolt' as p_name", "concat('T', id % 2) as p_type", "cast(id % 3 as int) as p_size")
    seen = []
    best = registry.resolve.best_match
    try:
        registry.resolve.best_match = lambda probes, candidates, *a, **k: (seen.append(candidates.count()), best(probes, candidates, *a, **k))[1]
        counts = [registry._verified(lambda name, n=n: parts(n)).count() for n in (60, 600)]
    finally:
        registry.resolve.best_match = best
    assert seen == [6, 6] and counts == [7, 7]


def test_season_counts_add_nothing_up_before_rows_are_dealt(spark):
    """A task that adds up near unique rows as it reads them holds them all; blank, null and repeated episodes count as before."""
    from cinelake.operators import rollup

    rows = [(1, "1", "a"), (1, "1", "a"), (1, "1", "b"), (1, "2", ""), (1, "2x", "c"), (1, "2", None), (1, None, "d"), (None, "1", "e"), (2, "", "f"), (2, "0", "g")]
    df = spark.createDataFrame(rows, "p long, s string, e string")
    key = lambda r: str(tuple(r))
    found = rollup.season_counts(df, "p", "s", "e")
    assert sorted(map(tuple, found.collect()), key=key) == sorted([(1, "1", 2), (1, "2", 0), (1, "2x", 1), (1, None, 1), (None, "1", 1), (2, "", 1), (2, "0", 1)], key=key)
    assert sorted(map(tuple, rollup.latest_season(df, "p", "s", "e").collect()), key=key) == sorted([(1, 2, 1), (None, 1, 1)], key=key)
    assert sorted(map(tuple, rollup.series_totals(df, "p", "s").collect()), key=key) == sorted([(1, 7, 3), (None, 1, 1), (2, 2, 1)], key=key)
    for df in (found, rollup.latest_season(df, "p", "s", "e"), rollup.series_totals(df, "p", "s")):
        plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
        lowest = max(i for i, line in enumerate(plan) if "HashAggregate" in line)
        assert "Exchange" in plan[lowest + 1] and "REPARTITION_BY_NUM" in plan[lowest + 1]
