"""One-pass scans against a loop over the names, listings as the site shows them, and running totals."""

import random
import re

import pytest

from cinelake.functions import classify, markers
from cinelake.operators.numbering import running_totals
from cinelake.sources import html


def loop(text, names):
    return [n for n in names if re.search(rf"(?i)(?<![A-Za-z0-9]){re.escape(n)}(?![A-Za-z0-9])", text or "")]


@pytest.mark.parametrize("names", [classify.NETWORKS, classify.STREAMING, ["a b", "b c", "c", "a", "A", "b+", "b++", "(x)", "|"]])
def test_names_are_those_of_a_loop(spark, names):
    rng = random.Random(5)
    pieces = [*names, *(n.upper() for n in names), " ", ", ", "x", "+", "-", "The ", "9", "TV", "a", "b"]
    texts = [None, "", *names, *("".join(rng.choices(pieces, k=rng.randint(1, 7))) for _ in range(600))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("t", markers.named("t", names).alias("found"), markers.names_any("t", names).alias("some"), markers.holds_any("t", names).alias("held")).collect():
        assert r.found == loop(r.t, names), r.t
        assert r.some == bool(r.found) and r.held == any(n in (r.t or "") for n in names)


def card(title, slug, video, movie, page, label="Official Trailer", heading=None):
    link = f'<a href="https://x.test/m{movie}/{slug}/videos/{page}">'
    return f'<div>{link}<img src="https://s.x.test/images/{slug}/ytimg/{video}/hq.jpg" alt="{title} trailer"></a><h3 class="media-heading">{link}{title if heading is None else heading}</a></h3><p class="small muted">{label}</p></div>'


def test_cards_of_a_listing(spark):
    first = (
        "<h2>Newest</h2>" + card("Below (series)", "below", "a" * 11, 1, 2) + card("Fire &amp; Ice", "fire-ice", "b" * 11, 3, 4, "Teaser") + card("Long one of Blood", "long", "c" * 11, 5, 6, heading="Long one of Bl...")
        + card("Cut...", "cut", "d" * 11, 7, 8, heading="Cut in half...") + '<img src="https://s.x.test/images/zip-wire/ytimg/M9tHmu0wNHM/hq.jpg">' + card("After", "after", "g" * 11, 11, 12)
        + "<h2>Most Viewed: Popular</h2>" + card("Evel", "evel", "e" * 11, 9, 10)
    )
    pages = [(1, first + card("Evel", "evel", "f" * 11, 9, 10)), (2, "<p>Most popular</p>" + "".join(card(f"M {i}", f"m-{i}", f"vid{i:08d}", i, i) for i in range(40))), (3, ""), (4, None), (5, "<p>nothing</p>")]
    out = html.listing_cards(spark.createDataFrame(pages, "page_no int, html string")).orderBy("page_no", "pos").collect()
    one = [r for r in out if r.page_no == 1]
    assert [(r.title, r.label, r.slug, r.movie_id, r.video_page_id) for r in one[:4]] == [
        ("Below (series)", "Official Trailer", "below", "1", "2"), ("Fire & Ice", "Teaser", "fire-ice", "3", "4"), ("Long one of Blood", "Official Trailer", "long", "5", "6"), ("Cut in half", "Official Trailer", "cut", "7", "8"),
    ]
    assert [(r.title, r.label, r.slug, r.movie_id) for r in one[4:]] == [("Zip Wire", "Trailer", "zip-wire", ""), ("After", "Official Trailer", "after", "11")]
    assert one[0].thumbnail == "https://s.x.test/images/below/ytimg/aaaaaaaaaaa/hq.jpg"
    assert len([r for r in out if r.page_no == 2]) == 24 and {r.page_no for r in out} == {1, 2}


def test_running_totals(spark):
    rng = random.Random(3)
    rows = [(k, rng.randint(0, 9)) for k in rng.sample(range(10_000), 500)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(4)
    for descending in (False, True):
        got = {r.k: r.before for r in running_totals(df, "k", "v", "before", descending).collect()}
        assert got == {k: sum(v for j, v in rows if (j > k if descending else j < k)) for k, _ in rows}
    assert running_totals(df.limit(0), "k", "v", "before").count() == 0
