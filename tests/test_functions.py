import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from cinelake.functions import classify, dates, scoring, seasons, text


def values(spark, texts, f):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(f(F.col("t"))).collect()]


def test_title_keys_keep_what_tells_titles_apart(spark):
    assert values(spark, ["Amélie!", "Law &  Order (UK)", "[REC] 2", r"\N", None, "It's"], text.title_key) == ["am lie", "law and order", "2", "", "", "it s"]


def test_blankish_cells(spark):
    assert values(spark, ["", " n / a ", "None", "0", "x", None, " "], text.is_blankish) == [True, True, True, False, False, True, True]


def test_code_and_number_extractors(spark):
    assert values(spark, ["see TT1234567!", "nm123", "tt123456789012345", None], text.imdb_code) == ["tt1234567", "", "", ""]
    assert values(spark, ["six new episodes", "10 episodes and 4 episodes", "none"], text.episode_count) == [6, 10, None]


def test_values_are_split_and_deduped_in_order(spark):
    assert values(spark, ["a, B;a / b|c"], lambda c: text.distinct_by_key(text.split_values(c))) == [["a", "B", "c"]]


def test_urls_without_scheme(spark):
    assert values(spark, ["www.facebook.com/x/", "https://en.wikipedia.org/wiki/A_B", "bad host", ""], text.url_host) == ["www.facebook.com", "en.wikipedia.org", "", ""]


@pytest.mark.parametrize("raw, day", [("2024-01-15T10:00", "2024-01-15"), ("01/02/2024", "2024-01-02"), ("13/02/2024", "2024-02-13"), ("15-01-2024", "2024-01-15"), ("20240115", "2024-01-15"), ("2024/1/5", "2024-01-05"), ("soon", None), ("n/a", None)])
def test_date_ladder_reads_months_first(spark, raw, day):
    assert values(spark, [raw], lambda c: dates.parse_date(c).cast("string")) == [day]


def test_opening_weekend_of_a_whole_week(spark):
    week = [f"2024-01-{d:02d}" for d in range(1, 9)]  # a Monday first
    assert values(spark, week, lambda c: dates.opening_sunday(c.cast("date")).cast("string")) == ["2024-01-07"] * 7 + ["2024-01-14"]


def test_season_end_rules(spark):
    df = spark.createDataFrame([(1, []), (2, ["2024-01-05"]), (3, ["2024-01-05", "2024-03-01", "2024-03-01"])], "i int, d array<string>")
    out = df.orderBy("i").select(dates.season_end(F.lit(dt.date(2024, 1, 1)), F.col("d").cast("array<date>")).cast("string")).collect()
    assert [r[0] for r in out] == [None, "2024-01-31", "2024-03-01"]


def test_years_roll_over_after_45_days(spark):
    assert values(spark, ["Jan 5", "Dec 1"], lambda c: dates.article_date(c, 2025, dt.date(2025, 12, 20)).cast("string")) == ["2026-01-05", "2025-12-01"]


def test_windows_must_run_forward():
    assert dates.window("next_7", dt.date(2024, 1, 1)) == (dt.date(2024, 1, 1), dt.date(2024, 1, 8))
    with pytest.raises(ValueError):
        dates.window("custom", dt.date(2024, 1, 1), dt.date(2024, 2, 1), dt.date(2024, 1, 1))


def test_dayparts(spark):
    assert values(spark, ["9:30 am", "8/7c on ABC", "12 a.m.", "on Netflix", "later"], classify.daypart) == ["Daytime", "Primetime", "Late Night", "Streaming", ""]


def test_networks_in_list_order(spark):
    assert values(spark, ["Fox and Apple TV+"], classify.networks) == [["Apple TV+", "Apple TV", "Fox", "FOX"]]


@pytest.mark.parametrize("a, b, score", [("Dune", "dune", 70), ("Dune", "Dune Part Two", 45), ("red big fox", "big red dog", 26), ("", "x", 0), ("a", "b", 0)])
def test_title_scores_truncate(spark, a, b, score):
    assert spark.range(1).select(scoring.title_score(F.lit(a), F.lit(b))).first()[0] == score


def test_trailer_verdicts(spark):
    rows = [("Dune", "Warner Bros", "2021", "Dune | Official Trailer", "2021", "Warner Bros. Pictures", ""), ("Dune", "", "", "Dune trailer reaction", "", "Fan", "")]
    df = spark.createDataFrame(rows, "t string, n string, y string, v string, d string, c string, x string")
    parts = scoring.trailer_scores("t", "n", "y", "v", "d", "c", "x")
    assert [tuple(r) for r in df.select(parts["score"], parts["verdict"]).collect()] == [(100, "Confirmed"), (28, "Not found")]


def test_sequence_ratio_is_the_standard_library_s(spark):
    from difflib import SequenceMatcher

    out = spark.createDataFrame([("small ring", "large ring")], "a string, b string").select(scoring.sequence_ratio("a", "b")).first()[0]
    assert out == 100 * SequenceMatcher(None, "small ring", "large ring").ratio()


def test_long_season_page_is_read_once(spark):
    """The lambdas read the page's episodes, not the page again for each of them."""
    said = " ".join(f"Episode {i % 700} Aired Jan {i % 28 + 1}, {2000 + i // 700}" for i in range(1400))
    begun = time.monotonic()
    got = spark.createDataFrame([(said,), ("",), (None,)], "t string").select(seasons.season_context("t").alias("c")).collect()
    assert time.monotonic() - begun < 60
    assert tuple(got[0]["c"]) == (dt.date(2001, 1, 1), dt.date(2001, 1, 28), 700) and [tuple(r["c"]) for r in got[1:]] == [(None, None, 0)] * 2


def test_long_title_is_scored_once(spark):
    """The video's key is made once, not for each word of the title."""
    words = " ".join(f"word{i}" for i in range(3000))
    df = spark.createDataFrame([(words, "Netflix", words[:-1] + "x official trailer", "Netflix")], "t string, n string, v string, c string")
    begun = time.monotonic()
    got = df.select(*(v.alias(k) for k, v in scoring.trailer_scores("t", "n", F.lit(""), "v", F.lit(""), "c", F.lit("")).items())).first()
    assert time.monotonic() - begun < 60
    assert tuple(got) == (31, 25, 45, 0, 0, 100, "Confirmed")
