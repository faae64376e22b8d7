"""Operator 5, toxicity: maximum-scoring segments of token log-odds, calibrated by their extreme-value distribution."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinelake.llm.common import Memo, id_and_text, materialize, plain_words, slices, summed_array

#: Counts of features live in so many hash slots, whatever the vocabulary: two arrays of 4 MB.
SLOTS = 1 << 20
#: Labelled rows that the model is fitted on at most: those whose hashed id is smallest.
SAMPLE_ROWS = 50_000
#: Features of a token: its beginnings of so many letters, where it is longer, then the whole of it.
BEGINNINGS = (3, 4, 5, 6, 7)
#: Letters of scripts that are written without spaces: each two neighbours are a token.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+")
#: Documents of Dirichlet prior mass, spread as the next shorter feature's are, and those that a feature needs to count.
PRIOR, SUPPORT = 5.0, 5
#: Log-odds above the base rate from which a token is evidence, what is taken off them, and the most that counts.
LEAST, TAKEN, MOST = 2.0, 1.0, 6.0
#: What every other token takes from a running segment.
GAP = 0.02
#: E-value up to which a passage is significant.
SIGNIFICANT = 0.01
#: Bins of the normalised scores, and of token scores.
BINS, FLOOR, CEILING = 500, -20.0, 130.0
TOKEN_BIN = 0.05


@dataclass
class Model:
    toxic: np.ndarray  # documents by slot, float32
    clean: np.ndarray
    base: float  # share of toxic documents
    decay: float = 1.0  # lambda of the extreme-value distribution
    k: float = 1.0  # its K
    slope: float = 1.0
    intercept: float = -20.0


_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def features(words: list[bytes]) -> np.ndarray:
    """(words, features) slots of each token's features, shortest first; -1 where a token is too short for one."""
    text = b"\n".join(words).decode("utf-8", "replace")
    points = np.frombuffer((text + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.flatnonzero(points == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    sizes, state = ends - starts, np.zeros(len(words), np.uint64)
    out = np.full((len(words), len(BEGINNINGS) + 1), -1, np.int64)

    def slot(kind: int) -> np.ndarray:
        x = (state ^ np.uint64(kind)) * _MIX
        return ((x ^ (x >> np.uint64(31))) * _STEP >> np.uint64(44)).astype(np.int64) % SLOTS

    for k in range(1, BEGINNINGS[-1] + 1):
        inside = sizes >= k
        at = points[np.minimum(starts + k - 1, len(points) - 1)].astype(np.uint64)
        state = np.where(inside, (state + at + np.uint64(k)) * _STEP, state)
        state ^= np.where(inside, state >> np.uint64(29), np.uint64(0))
        if k in BEGINNINGS:
            out[:, BEGINNINGS.index(k)] = np.where(sizes > k, slot(k), -1)
    out[:, -1] = [xxhash.xxh64_intdigest(word) % SLOTS for word in words]
    return out


def tokens_of(text: str | None) -> list[bytes]:
    """The plain words of a text; runs of scripts without spaces as all pairs of neighbouring letters."""
    if text and not text.isascii() and UNSPACED.search(text):
        text = UNSPACED.sub(lambda m: f" {' '.join(m[0][i : i + 2] for i in range(max(1, len(m[0]) - 1)))} ", text)
    return plain_words(text)


class TokenScores:
    """Scores of tokens, kept for those that come again.

    The share of toxic documents among those with a feature has a Dirichlet prior around the share
    of the next shorter feature, the first one around the base rate; rare features don't move it. The
    score comes from the log-odds of the longest feature against the base rate. Log-odds below LEAST
    are mostly noise of the estimates: with those of all tokens the scan found less (the README has
    figures), so they count as a gap.
    """

    def __init__(self, model: Model):
        self.model, self.odds, self.memo = model, math.log(model.base / (1 - model.base)), Memo(self.learn)

    def learn(self, words: list[bytes]) -> Iterable[tuple[bytes, float]]:
        share = np.full(len(words), self.model.base)
        for slots in features(words).T:
            toxic = self.model.toxic[slots].astype(np.float64)
            n = toxic + self.model.clean[slots]
            share = np.where((slots >= 0) & (n >= SUPPORT), (toxic + PRIOR * share) / (n + PRIOR), share)
        odds = np.minimum(np.log(share / (1 - share)) - self.odds, MOST)
        return zip(words, np.where(odds > LEAST, odds - TAKEN, -GAP).tolist())

    def of(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """The scores of each text's tokens."""
        known = self.memo.of({w for words in texts for w in words})
        return [np.fromiter(map(known.__getitem__, words), np.float64, len(words)) for words in texts]


def held_out(id_col, mod: int, rest: int):
    """Whether crc32 of the id as text leaves `rest` modulo `mod`; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % mod == rest, F.lit(False))


def solve_decay(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive lambda at which the weighted mean of exp(lambda * score) is 1; 1 where there is none."""
    mass = weights / max(weights.sum(), 1)
    if not len(scores) or scores.max() <= 0 or mass @ scores >= 0 or not mass[scores > 0].sum():
        return 1.0
    excess = lambda x: mass @ np.exp(np.minimum(x * scores, 600)) - 1
    low, high = 0.0, 1.0
    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return high


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, score), in one pass over the positive scores.

    Each kept segment points at the nearest one before it that starts at a lower running sum, so
    that the search for a partner skips what earlier searches have ruled out.
    """
    sums = np.concatenate(([0.0], np.cumsum(scores, dtype=np.float64)))
    at = np.flatnonzero(scores > 0)
    kept: list[tuple[int, int, float, float, int]] = []
    for i, low, top in zip(at.tolist(), sums[at].tolist(), sums[at + 1].tolist()):
        start = i
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= low:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= top:
                kept.append((start, i + 1, low, top, j))
                break
            start, low = kept[j][0], kept[j][2]
            del kept[j:]
    return [(s, e, top - low) for s, e, low, top, _ in kept]


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns from labelled rows outside the held-out fold (crc32 of the id mod `folds` is 0).

    At most `sample_rows` labels are used, those of the smallest hashed ids, so the broadcast side
    has a fixed bound; documents are read whole. Labels of null ids or values are left out, repeated
    labels of an id count once (the larger). Without both classes the model scores every text alike.
    """
    known = (
        labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic"))
        .filter("id is not null and toxic is not null")
        .filter(~held_out("id", folds, 0))
        .groupBy("id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    )
    texts = id_and_text(docs, id_col, text_col).join(F.broadcast(known), "id")

    def fill(batches):
        counts = np.zeros(2 * SLOTS + 2, np.int64)
        for batch in slices(batches):
            held = [{*tokens_of(text)} for text in batch.column("text").to_pylist()]
            words = list(set().union(*held))
            place, slots = dict(zip(words, range(len(words)))), features(words) if words else None
            for own, toxic in zip(held, batch.column("toxic").to_pylist()):
                which = toxic == 1
                if own:
                    found = np.unique(slots[np.fromiter(map(place.__getitem__, own), np.int64, len(own))])
                    counts[found[found >= 0] + SLOTS * which] += 1
                counts[2 * SLOTS + which] += 1
        return counts

    counts = summed_array(texts, fill, 2 * SLOTS + 2, 1 << 15)
    n_clean, n_toxic = counts[2 * SLOTS :].tolist()
    model = Model(counts[SLOTS : 2 * SLOTS].astype(np.float32), counts[:SLOTS].astype(np.float32), (n_toxic + 0.5) / (n_toxic + n_clean + 1))
    if not n_toxic or not n_clean:
        return model

    # Token scores of the clean documents give lambda, their best segments K by maximum likelihood; a logistic curve then turns normalised scores of both classes into probabilities.
    best, _ = materialize(_segments(texts.select("id", "text", "toxic"), model, "toxic int").select("toxic", "best", "others", "n_words", "evidence"), "toxicity")
    clean = best.filter("toxic != 1")
    tokens = clean.select(F.explode("evidence").alias("bin")).groupBy("bin").count().collect()
    total = clean.agg(F.sum("n_words")).first()[0] or 0
    values, weights = [(r.bin + 0.5) * TOKEN_BIN for r in tokens], [r["count"] for r in tokens]
    model.decay = solve_decay(np.array([*values, -GAP]), np.array([*weights, max(total - sum(weights), 1)], np.float64))
    model.k = n_clean / max(clean.agg(F.sum(F.exp(-_normalised(model, F.col("best"))))).first()[0] or 0.0, 1e-9)
    place = F.floor((_total(model) - FLOOR) / (CEILING - FLOOR) * BINS)
    binned = best.select("toxic", F.least(F.greatest(place, F.lit(0)), F.lit(BINS - 1)).alias("bin")).groupBy("toxic", "bin").agg(F.count("*").alias("n")).collect()
    model.slope, model.intercept = _logistic([(FLOOR + (r.bin + 0.5) * (CEILING - FLOOR) / BINS, r.n, r.toxic == 1) for r in binned])
    return model


def _normalised(model: Model, score: Column) -> Column:
    """lambda * score - ln n: what a segment's score is in nats over what chance gives in a text of n words."""
    return F.lit(model.decay) * score - F.log(F.greatest("n_words", F.lit(1)).cast("double"))


def _total(model: Model) -> Column:
    """The best segment's normalised score less ln K, and what other segments have over 0: passages that are significant by themselves add up."""
    log_k = math.log(model.k)
    more = F.aggregate("others", F.lit(0.0), lambda sum_, v: sum_ + F.greatest(_normalised(model, v) - log_k, F.lit(0.0)))
    return _normalised(model, F.col("best")) - log_k + more


def _logistic(points: list[tuple[float, int, bool]]) -> tuple[float, float]:
    """Slope and intercept of a logistic curve through binned, weighted 0/1 points, with a little ridge."""
    if not points:
        return 1.0, -20.0
    x, n, y = (np.array(v, np.float64) for v in zip(*points))
    w = np.array([0.0, math.log((n @ y + 1) / (n @ (1 - y) + 1))])
    design = np.stack([x / 10, np.ones_like(x)], 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -40, 40)))
        gradient = design.T @ (n * (y - p)) - 1e-2 * w
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return max(w[0], 0.0) / 10, w[1]


def _segments(df: DataFrame, model: Model, more: str = "") -> DataFrame:
    """Per row the score of its best segment, those of all others, its words, the bins of the tokens that are evidence, and the significant passages."""
    kept = [c for c in df.columns if c != "text"]
    fields = [("first_word", pa.int32()), ("end_word", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64()), ("words", pa.string())]
    types = [pa.float64(), pa.list_(pa.float64()), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.struct(fields))]

    def run(batches):
        scores = TokenScores(model)
        for batch in slices(batches):
            best, others, sizes, evidence, passages = [], [], [], [], []
            texts = [tokens_of(text) for text in batch.column("text").to_pylist()]
            for words, values in zip(texts, scores.of(texts)):
                found = maximal_segments(values) if len(words) and values.max() > 0 else []
                scored = sorted((v for _, _, v in found), reverse=True)
                best.append(scored[0] if scored else 0.0)
                others.append(scored[1:])
                sizes.append(len(words))
                evidence.append((values[values > 0] / TOKEN_BIN).astype(np.int32))
                rated = [(s, e, v, model.k * len(words) * math.exp(-min(model.decay * v, 700))) for s, e, v in found]
                passages.append([
                    {"first_word": s, "end_word": e, "score": v, "e_value": rate, "words": b" ".join(words[s:e]).decode("utf-8", "replace")}
                    for s, e, v, rate in rated if rate <= SIGNIFICANT
                ])
            columns = [pa.array(c, t) for c, t in zip((best, others, sizes, evidence, passages), types)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], [*kept, "best", "others", "n_words", "evidence", "passages"])

    passage = "array<struct<first_word:int,end_word:int,score:double,e_value:double,words:string>>"
    return df.mapInArrow(run, "id long" + (f", {more}" if more else "") + f", best double, others array<double>, n_words long, evidence array<int>, passages {passage}")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted, e_value, passages) for each row.

    score is the calibrated probability that the text is toxic, from the sum of its passages,
    predicted whether it is 0.5 or more, e_value what chance gives of that sum; passages are the significant segments in words of the text. Null and empty texts get the
    score of a text without any toxic token. One pass, no shuffle; only id and text are read.
    """
    found = _segments(id_and_text(docs, id_col, text_col), model)
    z = F.lit(model.slope) * _total(model) + F.lit(model.intercept)
    return found.select(
        F.col("id").alias("doc_id"),
        (1 / (1 + F.exp(-z))).alias("score"),
        (1 / (1 + F.exp(-z)) >= 0.5).cast("int").alias("predicted"),
        F.exp(-_total(model)).alias("e_value"),
        "passages",
    )
