"""Candidate joins against the products that they stand for, and joins by day bins."""

import datetime as dt
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from cinelake.operators import bands, candidates

WORDS = "the of a dark river king night it new ring stone light us moon second lost return house".split()
NETWORKS = ["", None, "Netflix", "Hulu", "Hulu Originals", "BBC One", "One"]
FIRST = dt.date(2026, 1, 1)


def titles(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = " ".join(rng.choices(WORDS, weights=[8, 6, 5] + [1] * (len(WORDS) - 3), k=rng.randint(1, 5)))
        key = rng.choice([key] * 6 + ["", "it", "x", key[2:], key + "s", "9"]).strip()
        out.append((i, key, rng.choice([None] + [FIRST + dt.timedelta(rng.randint(0, 70))] * 5), rng.choice(NETWORKS)))
    return out


def score(a, b, dated, networked):
    (_, x, day, net), (_, y, other, shown) = a, b
    if not x or not y:
        s = 0
    elif x == y:
        s = 70
    elif x in y or y in x:
        s = 45
    else:
        p, q = set(x.split()), set(y.split())
        s = int(len(p & q) / max(len(p), len(q)) * 40)
    if dated and day and other:
        s += 35 if day == other else 15 if abs((day - other).days) <= 14 else 0
    if networked and set((net or "").lower().split()) & set((shown or "").lower().split()):
        s += 25
    return s


@pytest.mark.parametrize("seed, least, dated, networked", [(1, 45, True, True), (2, 45, True, False), (3, 35, True, True), (4, 30, False, True), (5, 60, True, True)])
def test_best_titles_are_those_of_the_product(spark, seed, least, dated, networked):
    schema = "i int, key string, day date, network string"
    asked, rows = titles(seed, 160), titles(seed + 100, 220)
    probes = spark.createDataFrame(asked, schema)
    found = candidates.best_titles(probes, spark.createDataFrame(rows, schema).repartition(5), least, "i", ["i"], dated, networked).collect()
    got = {(r["key"], r["day"], r["network"]): (r["score"], r["i"]) for r in found}
    wanted = {}
    for a in asked:
        best = max(((score(a, b, dated, networked), -b[0]) for b in rows if a[1] and b[1]), default=(0, 0))
        if best[0] >= least:
            wanted[a[1], a[2], a[3] or ""] = (best[0], -best[1])
    assert got == wanted and len(wanted) > 20


def test_limits_that_need_a_product_are_refused(spark):
    df = spark.createDataFrame([(1, "a", FIRST, "x")], "i int, key string, day date, network string")
    with pytest.raises(ValueError):
        candidates.best_titles(df, df, 25, "i", ["i"])
    assert candidates.best_titles(df.limit(0), df, 45, "i", ["i"]).count() == 0
    assert candidates.best_titles(df, df.limit(0), 45, "i", ["i"]).count() == 0


def test_no_plan_holds_a_product(spark):
    schema = "i int, key string, day date, network string"
    df = spark.createDataFrame(titles(1, 50), schema)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = candidates.best_titles(df, df, 45, "i", ["i"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_pairs_grow_with_the_rows(spark):
    """Ten times the distinct titles of the same kind bring about ten times the pairs, a product a hundred times."""

    def pairs(n):
        rng = random.Random(n)
        words = [f"w{i}" for i in range(4 * n)]
        rows = [(i, " ".join(rng.choices(words, k=4)), FIRST + dt.timedelta(rng.randint(0, 5 * n)), rng.choice(["Netflix", "Hulu", "FX"])) for i in range(n)]
        df = spark.createDataFrame(rows, "i int, key string, day date, network string")
        return candidates.candidate_pairs(df, df, 45, True, True).distinct().count()

    assert pairs(3_000) < 14 * pairs(300)


@pytest.mark.parametrize("least", [30, 45, 80])
def test_similar_pairs_are_those_of_the_product(spark, least):
    names = sorted({t[1] for t in titles(11, 60)})
    probes, answers = (spark.createDataFrame([(n,) for n in names], f"{c} string") for c in ("probe", "answer"))
    got = sorted((r["probe"], r["answer"], round(r["score"], 9)) for r in candidates.similar_pairs(probes, answers, least).collect())
    exact = {(a, b): 100 * SequenceMatcher(None, a, b).ratio() for a in names for b in names}
    assert got == sorted((a, b, round(s, 9)) for (a, b), s in exact.items() if s >= least)
    bound = spark.createDataFrame(list(exact), "a string, b string").select("a", "b", candidates.similarity_bound(F.col("a"), F.col("b")).alias("s")).collect()
    assert all(r["s"] >= exact[r["a"], r["b"]] - 1e-9 for r in bound)


def test_answers_to_a_question_get_their_bonus(spark):
    probes = spark.createDataFrame([(1, "dark river", 2020), (2, "moon", None)], "q int, probe string, wanted int")
    answers = spark.createDataFrame([(1, "dark rivers", 2020), (1, "dark", 2021), (1, "zzz", 2020), (2, "moon", 1999), (3, "dark river", 2020)], "q int, answer string, year int")
    near = lambda: F.coalesce(F.when(F.col("year") == F.col("wanted"), 25).when(F.abs(F.col("year") - F.col("wanted")) == 1, 10), F.lit(0))
    got = {(r["q"], r["answer"]): r["score"] for r in candidates.similar_pairs(probes, answers, 45, ["q"], near, 25).collect()}
    ratio = lambda a, b: 100 * SequenceMatcher(None, a, b).ratio()
    assert got == {(1, "dark rivers"): ratio("dark river", "dark rivers") + 25, (1, "dark"): ratio("dark river", "dark") + 10, (2, "moon"): 100.0}
    with pytest.raises(ValueError):
        candidates.similar_pairs(probes.drop("q"), answers.drop("q"), 20, None, near, 25)


def test_near_days_and_ranges_are_those_of_the_product(spark):
    rng = random.Random(4)
    day = lambda: rng.choice([None] + [FIRST + dt.timedelta(rng.randint(-400, 400))] * 9)
    a, b = [(i, i % 3, day()) for i in range(120)], [(i, i % 3, day()) for i in range(150)]
    left, right = spark.createDataFrame(a, "i int, g int, x date"), spark.createDataFrame(b, "j int, g int, y date")
    for within in (0, 1, 14, 90):
        met = bands.near_days(left.drop("g"), right.drop("g"), "x", "y", within)
        got = sorted((r["i"], r["j"], r["days_apart"]) for r in met.collect())
        assert got == sorted((i, j, abs((x - y).days)) for i, _, x in a for j, _, y in b if x and y and abs((x - y).days) <= within)
    met = bands.near_days(left, right, "x", "y", 14, ["g"])
    assert sorted((r["i"], r["j"]) for r in met.collect()) == sorted((i, j) for i, g, x in a for j, h, y in b if x and y and g == h and abs((x - y).days) <= 14)
    spans = [(i, s, e) for i in range(60) for s, e in [(day(), day())]]
    ranges = spark.createDataFrame(spans, "r int, s date, e date")
    got = sorted((r["i"], r["r"]) for r in bands.in_ranges(left, ranges, "x", "s", "e").collect())
    assert got == sorted((i, r) for i, _, x in a for r, s, e in spans if x and s and e and s <= x <= e)


def test_sums_of_ranges_are_those_of_the_product(spark):
    day = lambda n: dt.date(2026, 1, 1) + dt.timedelta(days=n)
    held = [(n % 40, "abc"[n % 3], n % 5) for n in range(400)] + [(None, "a", 1), (3, None, 2), (7, "a", None)]
    asked = [(0, 3, 20), (1, 3, 20), (2, 9, 8), (3, None, 9), (4, 39, 90), (5, 60, 70), (1, 0, 3)]
    rows = spark.createDataFrame([(None if d is None else day(d), g, v) for d, g, v in held], "x date, g string, v int")
    ranges = spark.createDataFrame([(i, None if s is None else day(s), day(e)) for i, s, e in asked], "r int, s date, e date")
    got = bands.range_sums(rows, ranges, "x", "s", "e", ["g"], {"n": F.lit(1), "v": F.col("v")})
    wanted = []
    for i, s, e in asked:
        met = [(g, v) for d, g, v in held if d is not None and s is not None and s <= d <= e]
        wanted += [(i, str(g), sum(x == g for x, _ in met), sum(v for x, v in met if x == g and v is not None)) for g in {x for x, _ in met}]
    assert sorted((r["r"], str(r["g"]), r["n"], r["v"]) for r in got.collect()) == sorted(wanted)


def test_rows_of_a_day_and_equal_ranges_meet_once(spark):
    """20,000 rows of a day in 2,000 equal ranges: no join makes their 40 million pairs."""
    rows = spark.range(20_000).select(F.lit("2026-01-05").cast("date").alias("x"), F.lit("a").alias("g"))
    ranges = spark.range(2_000).select(F.col("id").alias("r"), F.lit("2026-01-01").cast("date").alias("s"), F.lit("2026-01-09").cast("date").alias("e"))
    got = bands.range_sums(rows, ranges, "x", "s", "e", ["g"], {"n": F.lit(1)})
    assert got.agg(F.count("*"), F.min("n"), F.max("n")).first() == (2_000, 20_000, 20_000)
