"""Operators 11 to 13 against plain versions, and their odd cases."""

import hashlib
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinelake.llm import hard_negatives, registry, superminhash, vector_codes

VECTORS = "vec_id long, embedding array<float>, label int, id long, v string, code string"
DOCS = "doc_id long, text string, n long, id string, digest string"


def collected(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def vectors(spark, rows):
    """Vectors with extra columns whose names clash with those that the operators use inside."""
    plain = [(i, None if v is None else [None if x is None else float(x) for x in v], label, 0, "a", "b") for i, v, label in rows]
    return spark.createDataFrame(plain, VECTORS)


def finite(v):
    return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)


def odd_rows(seed, n=400, d=16, labels=4):
    """Clustered vectors with exact copies, a hot label, and rows that take no part."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d))
    m = (centres[rng.integers(0, 6, n)] + 0.4 * rng.normal(size=(n, d))).astype(np.float32)
    m[n // 4 : n // 4 + 60] = m[1]
    rows = [(i, v, 0 if i % 3 == 0 else int(rng.integers(0, labels))) for i, v in enumerate(m)]
    bad = [(n + 1, None, 1), (n + 2, [], 1), (n + 3, [float("nan")] * d, 1), (n + 4, [None] * d, 1), (n + 5, [float("inf")] * d, 1)]
    return rows + bad + [(n + 10, m[3], None), (n + 11, m[4], None)]


# 11


def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = sorted(((i, [int(np.floor(256 * float(x))) for x in v], label) for i, v, label in rows if finite(v)), key=lambda r: (r[0] is None, r[0], r[1]))
    wide = len(kept[0][1]) // parts
    cut = [[v[p * wide : (p + 1) * wide] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))

    for left in range(rounds, -1, -1):
        found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
        if left:
            for p in range(parts):
                for j in range(len(books[p])):
                    mine = [c[p] for c, f in zip(cut, found) if f[p][1] == j]
                    if mine:
                        books[p][j] = [sum(z) // len(mine) for z in zip(*mine)]
    errors, of = [sum(d for d, _ in f) for f in found], {}
    for (_, _, label), e in zip(kept, errors):
        of[label] = of.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((i, "".join(f"{j:02x}" for _, j in f), e, of[label], digest) for (i, _, label), f, e in zip(kept, found, errors))


@pytest.mark.parametrize("d", [16, 48])
def test_codes_are_those_of_plain_rounds(spark, d):
    rows = odd_rows(3, 260, d)
    rows += [rows[7], rows[7]]
    out = collected(vector_codes.compress(vectors(spark, rows).repartition(5)))
    assert sorted((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in out) == plain_codes(rows)


def test_few_rows_and_no_rows(spark):
    rows = [(5, np.arange(32) / 7 - 2, 1), (None, np.arange(32) / 9, None), (9, np.arange(32) / 7 - 2, 1), (11, [1.0] * 16, 2), (12, [1.0] * 17, 2)]
    out = collected(vector_codes.compress(vectors(spark, rows)))
    assert sorted((r["code"][:2], r["error"] >= 0) for r in out) == [("00", True), ("00", True), ("02", True)]
    assert {r["vec_id"] for r in out} == {5, 9, None}
    for some in ([], [(1, None, 1)], [(1, [1.0] * 15, 1)]):
        empty = vector_codes.compress(vectors(spark, some))
        assert empty.count() == 0 and empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(ValueError):
        vector_codes.fit(vectors(spark, rows), entries=257)


def test_bounds_settle_most_parts_and_never_a_tie():
    rng = np.random.default_rng(5)
    before = rng.integers(-200, 200, (16, 4))
    x = before[rng.integers(0, 16, 5_000)] + rng.integers(-9, 10, (5_000, 4))
    index, near, second = vector_codes.scan(x, before)
    book = before + rng.integers(-2, 3, before.shape)
    book[9] = book[3]
    step = vector_codes._Step.of(before, book)
    new, up, low, scanned = step.follow(x, index, vector_codes._raised(near), vector_codes._lowered(second))
    d = ((x[:, None, :] - book[None, :, :]) ** 2).sum(2)
    assert np.array_equal(new, d.argmin(1)) and scanned < 1_500
    assert (up.astype(np.float64) ** 2 >= d.min(1)).all() and (low.astype(np.float64) ** 2 <= np.sort(d, 1)[:, 1]).all()


def test_codes_decode_to_near_vectors(spark):
    rows = odd_rows(8, 200, 32)
    books, coded = vector_codes.fit(vectors(spark, rows), rounds=4)
    out = collected(vector_codes.decode(coded.withColumn("code", F.when(F.col("id") == 2, None).otherwise(F.col("code"))), books))
    was = {i: np.array(v, np.float64) for i, v, _ in rows if finite(v)}
    assert [r["decoded"] for r in out if r["id"] == 2] == [None]
    for r in out:
        if r["id"] != 2:
            # an error in steps of 1/256; the middle of a step is half a step off at most
            off = np.linalg.norm(np.array(r["decoded"]) - was[r["id"]])
            assert off <= (r["error"] ** 0.5 + 1.01 * 32**0.5) / 256


# 12


def plain_negatives(rows, positives=5, negatives=3, least=50, most=95):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v], label) for i, v, label in rows if finite(v) and i is not None and label is not None]
    out = set()
    for i, v, label in {(i, tuple(v), label) for i, v, label in kept if i % 50 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other == label) for j, w, other in kept if j != i and len(w) == len(v))
        for place, (p, j, _) in enumerate([s for s in scored if s[2]][:positives]):
            fits = [(-s, k) for s, k, same in scored if not same and least * -p <= 100 * -s <= most * -p][:negatives]
            out |= {(i, j, place, rank, k, -p, s) for rank, (s, k) in enumerate(fits, 1)}
    return sorted((i, j, rank, k, p, s) for i, j, _, rank, k, p, s in out)


@pytest.mark.parametrize("budget", [None, 2_000])
def test_negatives_are_those_of_a_full_scan(spark, monkeypatch, budget):
    if budget:  # many blocks
        monkeypatch.setattr(hard_negatives, "CANDIDATE_BYTES", budget * 4)
        monkeypatch.setattr(hard_negatives, "ANCHOR_BYTES", 200)
    rows = odd_rows(11, 420) + [(None, np.ones(16), 1), (900, np.ones(5), 1), (901, np.ones(5), 1), (902, np.full(5, 0.9), 2), (50, odd_rows(11, 420)[50][1], odd_rows(11, 420)[50][2])]
    out = collected(hard_negatives.mine(vectors(spark, rows).repartition(3), F.col("vec_id") % 50 == 0, "label"))
    found = sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in out)
    assert found == plain_negatives(rows) and len(found) > 60


def test_no_negatives_without_anchors_labels_or_rows(spark):
    rows = odd_rows(2, 60)
    anchor = F.col("vec_id") % 50 == 0
    assert hard_negatives.mine(vectors(spark, []), anchor).count() == 0
    assert hard_negatives.mine(vectors(spark, rows), F.lit(False)).count() == 0
    assert hard_negatives.mine(vectors(spark, [(i, v, 1) for i, v, _ in rows]), anchor).count() == 0
    assert hard_negatives.mine(vectors(spark, [(i, v, None) for i, v, _ in rows]), anchor).count() == 0
    # an anchor whose positives point away from it has an empty window
    assert hard_negatives.mine(vectors(spark, [(0, [1.0] * 4, 1), (1, [-1.0] * 4, 1), (2, [-0.7] * 4, 2)]), anchor).count() == 0
    # a positive of score 0 takes negatives of score 0 only
    assert [r["negative_id"] for r in collected(hard_negatives.mine(vectors(spark, [(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.0, 3.0], 2), (3, [0.1, 0.0], 2)]), anchor))] == [2]


def test_trees_leave_nodes_out_and_lose_nothing():
    rng = np.random.default_rng(31)
    centres = 300 * rng.normal(size=(40, 24))
    x = (centres[rng.integers(0, 40, 6_000)] + 20 * rng.normal(size=(6_000, 24))).astype(np.int64)
    x[100:400] = x[0]
    ids, q = rng.permutation(6_000), x[rng.integers(0, 6_000, 30)]
    tree = hard_negatives.BallTree.over(x.astype(np.float64))
    for rows, c, r in zip(tree.rows, tree.centres, tree.radii):
        assert not len(rows) or np.linalg.norm(x[rows] - c, axis=1).max() <= r
    assert sorted(np.concatenate(tree.rows).tolist()) == list(range(6_000))
    exact = q @ x.T
    top = exact.max(1)
    low, high = top // 2, top * 19 // 20
    best, found, products = hard_negatives.search(tree, x, ids, q, np.arange(30), low, high, 4, lambda t, r: np.ones((len(t), len(r)), bool))
    for t in range(30):
        wanted = sorted((-s, i) for s, i in zip(exact[t].tolist(), ids.tolist()) if low[t] <= s <= high[t])[:4]
        assert [(-s, i) for s, i in zip(best[t].tolist(), found[t].tolist()) if s > hard_negatives._NONE] == wanted
    assert products < 0.5 * exact.size


def test_shares_of_scores_stay_whole():
    s = np.array([-101, -1, 0, 1, 99, 100, 101, 1 << 60])
    assert hard_negatives._share(s, 50, up=True).tolist() == [-(-50 * int(x) // 100) for x in s]
    assert hard_negatives._share(s, 95, up=False).tolist() == [95 * int(x) // 100 for x in s]


# 13


def plain_components(rows, k=3, percent=85):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])

    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                lo, hi = sorted((find(i), find(j)))
                root[hi] = lo
    return sorted(((i, len(s), None if i is None else find(i), None if i is None else find(i) == i) for i, s in sets), key=repr)


def near_rows(seed=1):
    """Groups of near copies around the limit, a hot group, copies, and odd texts."""
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(4_000)]
    rows = []
    for group in range(12):
        base = [str(w) for w in rng.choice(vocab, int(rng.integers(4, 160)))]
        for copy in range(60 if group == 3 else 8):
            words = list(base)
            for at in rng.integers(0, len(words), int(rng.integers(0, max(2, len(words) // 14)))):
                words[at] = str(rng.choice(vocab))
            rows.append((len(rows) + 1, " ".join(words).upper() if copy % 3 else "\t".join(words)))
    odd = [None, "", " \n\x0b ", "one", "ONE", "two words", "two words", "a b c", "A\x0cb  c", "naïve É é", "naïve É É", "x" * 9_000, "z " * 30_000]
    rows += [(1_000 + i, t) for i, t in enumerate(odd)]
    return rows + [(None, rows[0][1]), (4, rows[3][1]), (2_000, rows[40][1]), (2_000, rows[300 % len(rows)][1]), (None, None)]


def test_near_duplicates_are_those_of_all_pairs(spark):
    rows = near_rows()
    df = spark.createDataFrame([(i, t, 1, "a", "b") for i, t in rows], DOCS).repartition(5)
    out = collected(superminhash.near_duplicates(df))
    found = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in out), key=repr)
    assert found == plain_components(rows)
    assert superminhash.near_duplicates(df.limit(0)).count() == 0


def test_large_groups_are_searched_in_pairs_of_blocks(spark, monkeypatch):
    from cinelake.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", 9)
    rows = near_rows(2)
    out = collected(superminhash.near_duplicates(spark.createDataFrame([(i, t, 1, "a", "b") for i, t in rows], DOCS)))
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in out), key=repr) == plain_components(rows)


def plain_signature(shingles, m):
    least = [(1 << 64) - 1] * m
    for s in shingles:
        place = list(range(m))
        for level in range(m):
            bits = int(superminhash._mixed(np.array([s], np.uint64), level)[0])
            at = level + ((bits >> 40) * (m - level) >> 24)
            place[level], place[at] = place[at], place[level]
            least[place[level]] = min(least[place[level]], level << 40 | bits & (1 << 40) - 1)
    return least


def test_signatures_by_level_are_those_by_element():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (1, 2, 5, 40, 300, 0, 3)]
    got = superminhash.superminhash(np.concatenate(sets), np.repeat(np.arange(7), [len(s) for s in sets]), 7, 30)
    assert [g.tolist() for g in got] == [plain_signature(s, 30) for s in sets]


def test_shared_components_vary_less_than_independent_minima():
    rng, shares = np.random.default_rng(7), []
    for _ in range(300):
        u = np.unique(rng.integers(0, 1 << 63, 200).astype(np.uint64))
        both = superminhash.superminhash(np.concatenate((u[:185], u[15:])), np.repeat([0, 1], [185, len(u) - 15]), 2)
        shares.append((both[0] == both[1]).mean())
    assert abs(np.mean(shares) - 0.85) < 0.01 and np.std(shares) < 0.8 * (0.85 * 0.15 / both.shape[1]) ** 0.5
    assert min(shares) * both.shape[1] >= superminhash.LEAST_SHARED


# queries


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_hard_negatives", "op13_superminhash"])
def test_queries_give_what_their_sql_gives(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"create view {table} as select * from read_parquet('/root/testdata/sf0.001/{table}.parquet')")
    wanted = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in wanted.description]
    rows = sorted(wanted.fetchall(), key=repr)
    found = registry.queries()[name](spark, "/root/testdata/sf0.001").select(names).collect()
    assert rows and sorted(map(tuple, found), key=repr) == rows


# 4, rows that share an id


def test_lines_of_rows_that_share_an_id_are_not_lost(spark):
    from cinelake.llm import line_dedup

    shared = "the same long line of words that stands in several documents"
    rows = [(1, f"first line of the first row\n{shared}"), (2, f"opening line of another document here\n{shared}"), (2, "a wholly other text begins like this\nunique text that is nowhere else"), (3, f"{shared}\nlast"), (4, shared), (4, shared)]
    df = spark.createDataFrame([(i, t, "p", 7, "n") for i, t in rows], "doc_id long, text string, places string, n_lines int, id string")
    out = line_dedup.dedup_lines(df).collect()
    assert set(out[0].asDict()) >= {"places", "id", "n_lines", "n_dropped", "dropped"} and {r.places for r in out} == {"p"}
    texts = sorted((r.doc_id, r.text) for r in out)
    assert texts == sorted([*rows[:3], (3, "last"), (4, ""), (4, "")])


def test_the_pipeline_s_line_stage_keeps_columns_of_any_name(spark):
    import corpus_pipeline

    line = "a line of words that is long enough to be repeated"
    df = spark.createDataFrame([(1, line, 5, "x"), (2, f"{line}\nother words", 6, "y")], "doc_id long, text string, n_lines int, places string")
    out = corpus_pipeline.without_repeated_lines(spark, df, "")
    assert out.columns == df.columns and sorted(map(tuple, out.collect())) == [(1, line, 5, "x"), (2, "other words", 6, "y")]


def test_lines_of_a_key_that_are_not_similar_are_never_rows(spark):
    """Lines of the same words in other orders, which no sketch tells apart: only what is linked leaves the joins."""
    import random

    from cinelake.llm import line_dedup

    rng, words = random.Random(5), [f"word{i}" for i in range(20)]
    lines = ["extraordinarily interesting " + " ".join(rng.sample(words, 20)) for _ in range(40)]
    lines.append(lines[0] + " more")
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    met = line_dedup.met_rows(line_dedup.key_rows(line_dedup.line_keys(df)))
    texts = line_dedup.coded_lines(df, line_dedup.distinct_lines(line_dedup.line_occurrences(df)), met.select("x").distinct())
    rows = line_dedup._apart(met, spark.createDataFrame([], "node long, component long"), texts)
    assert rows.select("x").distinct().count() == 41
    assert line_dedup.hub_links(rows).count() <= 1 and line_dedup.links_between(rows).count() == 1


def test_lines_that_share_many_keys_are_counted_out_under_one(spark):
    """A link is found under the least shared key only, so no pair's edits are counted under each of its keys."""
    from cinelake.llm import line_dedup
    from pyspark.sql import functions as F

    line = "the extraordinarily interesting mountain railway crosses several narrow valleys before reaching northern territories"
    df = spark.createDataFrame([(1, line), (2, line.replace("several", "many"))], "doc_id long, text string")
    met = line_dedup.met_rows(line_dedup.key_rows(line_dedup.line_keys(df)))
    texts = line_dedup.coded_lines(df, line_dedup.distinct_lines(line_dedup.line_occurrences(df)), met.select("x").distinct())
    rows = line_dedup._apart(met, spark.createDataFrame([], "node long, component long"), texts)
    on = (F.col("a.key") == F.col("b.key")) & (F.col("a.x") < F.col("b.x")) & line_dedup._is_similar(0.8)
    assert rows.select("key").distinct().count() > 5
    assert rows.alias("a").join(rows.alias("b"), on).count() == 1
    assert line_dedup.links_between(rows).count() == 1 and line_dedup.hub_links(rows).count() == 1


def test_bounds_turn_unlike_lines_away_before_edits_are_counted(spark):
    """Letters too many and words of its own are never more than the edits; of unlike lines they are more than the allowed ones."""
    import random

    from cinelake.llm import line_dedup
    from pyspark.sql import functions as F

    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(2_000)]
    rows = []
    for unlike in (False, True):
        for size in (6, 300):
            for _ in range(40):
                a = rng.sample(words, size)
                b = rng.sample(words, size) if unlike else [rng.choice(words) if rng.random() < 0.15 else v for v in a]
                rows.append((unlike, size, " ".join(a), " ".join(b)))
    code = lambda c: F.array_join(F.transform(F.split(c, " "), lambda v: F.decode(F.unhex(F.lpad(F.hex(F.pmod(F.xxhash64(v), F.lit(line_dedup.CODES)) + line_dedup.FIRST_CODE), 8, "0")), "UTF-32")), "")
    df = spark.createDataFrame(rows, "unlike boolean, size int, a string, b string")
    for of in "ab":
        df = df.withColumns({f"{of}_chars": F.col(of), f"{of}_words": code(of), **{f"{of}_{c}": line_dedup.letter_counts(F.col(of), c) for c in line_dedup.LETTERS}})
    letters = sum(F.bit_count(F.col(f"a_{c}").bitwiseAND(F.bitwise_not(f"b_{c}"))) for c in line_dedup.LETTERS)
    own = F.length(F.call_function("translate", F.col("a_words"), F.col("b_words"), F.lit("")))
    short = F.col("size") < 10
    text = lambda of: F.when(short, F.col(f"{of}_chars")).otherwise(F.col(f"{of}_words"))
    edits, most = F.levenshtein(text("a"), text("b")), F.greatest(F.length(text("a")), F.length(text("b")))
    found = df.select("unlike", "size", F.when(short, letters).otherwise(own).alias("bound"), edits.alias("edits"), most.alias("most"), line_dedup._within("{}_{}", 0.8, short).alias("within")).collect()
    assert all(r.bound <= r.edits and r.within == (r.edits <= 0.2 * r.most + 1e-9) for r in found)
    assert any(r.within for r in found if r.size == 6) and any(r.within for r in found if r.size == 300)
    # short lines have letters in common by chance, long ones few words
    for size, least in ((6, 24), (300, 40)):
        assert sum(r.bound > 0.2 * r.most for r in found if r.unlike and r.size == size) >= least
