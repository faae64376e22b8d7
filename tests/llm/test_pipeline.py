"""The corpus pipeline, stage by stage, against plain versions of what each stage does."""

import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline
from cinelake.llm import byte_bpe, common
from test_llm_operators import near_lines, plain_components

P = pytest.importorskip("public_tokenizers")


def corpus():
    """Documents with toxic ones, repeated lines, near copies, benchmark passages, and odd rows."""
    rng = random.Random(31)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(4, 10))) for _ in range(2_500)]
    line = lambda n=14: " ".join(rng.choice(words) for _ in range(n))
    shared, items = line(), [(i, line(20)) for i in range(3)]
    texts, labels = [], []
    for i in range(90):
        lines = [line() for _ in range(5)]
        if i % 6 == 1:
            lines[2] = " ".join(["vilest", "rotten", "horrid", "vilest"] + lines[2].split()[:6])
        if i % 5 == 0:
            lines.insert(1, shared if i % 10 else shared.upper())
        if i % 30 == 3:
            lines[4] = "so " + items[i // 30][1].upper() + "!"
        texts.append("\n".join(lines))
        labels.append((i, int(i % 6 == 1)))
    copy = texts[2].split()
    for n in range(4):  # near copies as one line: not equal lines, nor near ones
        new = list(copy)
        new[3 * n] = words[n]
        texts.append(" ".join(new))
    rows = list(enumerate(texts)) + [(500, None), (501, ""), (502, shared), (None, "no id"), (2, texts[2]), (503, "東京" * 40)]
    return rows, labels, items


def plain_lines(rows):
    """(id, text) without lines that repeat an earlier one, exactly or nearly, over all rows."""
    placed = sorted({(i, n, x.lower().strip()) for i, t in rows if i is not None and t is not None for n, x in enumerate(t.split("\n"))})
    placed = [p for p in placed if p[2]]
    kinds = list(dict.fromkeys(x for _, _, x in placed))
    root = list(range(len(kinds)))
    for a in range(len(kinds)):
        for b in range(a):
            if root[a] != root[b] and near_lines(kinds[a], kinds[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    group, first, gone = {k: root[i] for i, k in enumerate(kinds)}, {}, set()
    for i, n, x in placed:
        if first.setdefault(group[x], (i, n)) != (i, n):
            gone.add((i, n))
    out = []
    for i, t in rows:
        if i is None or t is None:
            out.append((i, t))
            continue
        lines = t.split("\n")
        kept = [x for n, x in enumerate(lines) if (i, n) not in gone]
        if len(kept) == len(lines) or any(c.isalnum() for c in "".join(kept)):
            out.append((i, "\n".join(kept)))
    return out


def holds(text, item, k=5):
    sets = [{tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (common.plain_words(text), common.plain_words(item))]
    return len(sets[0] & sets[1]) >= 0.8 * len(sets[1]) - 1e-9


def test_every_stage_does_what_a_plain_version_does(spark, tmp_path):
    import tiktoken

    rows, labels, items = corpus()
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, sf_dir, found = spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs.write.parquet(f"{tmp_path}/in-{name}")
        docs = stage(spark, spark.read.parquet(f"{tmp_path}/in-{name}"), sf_dir)
        if name != "byte_bpe":
            assert docs.columns == columns
            docs.write.parquet(f"{tmp_path}/out-{name}")
            docs = spark.read.parquet(f"{tmp_path}/out-{name}")
            found[name] = sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr)
            assert all(r.n_chars == len(r.text or "") for r in docs.collect())
    known = dict(labels)
    assert found["toxicity"] == sorted(((i, t) for i, t in rows if not known.get(i)), key=repr)
    assert found["line_dedup"] == sorted(plain_lines(found["toxicity"]), key=repr)
    groups = plain_components([r for r in found["line_dedup"] if r[0] is not None])
    once = [r for r in found["line_dedup"] if r[0] is None or groups[r[0]][1] == r[0]]
    assert found["ngram_jaccard_join"] == once
    assert len(once) < len(found["line_dedup"])
    clean = [(i, t) for i, t in once if i is None or not any(holds(t, s) for _, s in items)]
    assert found["benchmark_decontamination"] == clean and len(clean) == len(once) - 3
    path = P.path("byte_bpe_50k.tiktoken")
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    wanted = sorted(((i, sha(np.array(plain.encode_ordinary(t or ""), "<u4").tobytes()), sha((t or "").encode())) for i, t in clean), key=repr)
    assert sorted(((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in docs.collect()), key=repr) == wanted
    assert sorted(((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect()), key=repr) == wanted


def test_a_stage_leaves_no_table_that_nothing_reads(spark, tmp_path, monkeypatch):
    rows, _, _ = corpus()
    docs = spark.createDataFrame(rows[:40], "doc_id long, text string")
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    same = lambda spark, docs, sf_dir: docs.select("doc_id", "text")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", same), ("line_dedup", corpus_pipeline.without_repeated_lines), ("three", same), ("four", same)])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 40
    left = {p.name.rsplit("-", 1)[0] for p in (tmp_path / "cinelake").iterdir()}
    assert left == {"pipeline-three", "occurrences", "kept", "edges"}
