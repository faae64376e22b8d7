"""Operator 9, language identification by character models with interpolated Kneser-Ney smoothing."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinelake.llm.common import id_and_text, materialize, slices

#: Characters of the longest n-gram. Each takes 16 bits of a 64-bit code.
ORDER = 4
SPACE = 0x20
#: Counted n-grams that a task holds before it merges equal ones.
HELD = 4_000_000
#: Standard deviations above the mean cost of a language's own texts at which a text is rejected.
REJECT = 6.0
#: Characters whose evidence a score stands for.
SHARPNESS = 20.0


#: Stands between texts, so that no n-gram depends on a neighbour.
EDGE = "\x02" * (ORDER - 1)


def _symbols_table() -> np.ndarray:
    """Code point to symbol: letters in lower case, everything else a space."""
    table = np.full(0x110000, SPACE, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            table[c] = ord(ch.lower()[0])
    table[2] = 2
    return table


_TABLE: list[np.ndarray] = []


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols of all texts between edges, runs of spaces shrunk to one, and each text's first position and its end (one edge included).

    Symbols have 16 bits: a letter beyond them is two, as UTF-16 has it.
    """
    if not _TABLE:
        _TABLE.append(_symbols_table())
    texts = [(t or "").replace("\x02", " ") for t in texts]
    raw = _TABLE[0][np.frombuffer((EDGE + EDGE.join(texts) + EDGE).encode("utf-32-le", "surrogatepass"), "<u4")]
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != SPACE) | (raw[:-1] != SPACE)
    place = np.concatenate(([0], np.cumsum(keep)))
    kept = raw[keep]
    if (wide := kept > 0xFFFF).any():
        at = np.concatenate(([0], np.cumsum(1 + wide)))
        kept, high, letter = np.repeat(kept, 1 + wide), at[:-1][wide], kept[wide] - 0x10000
        kept[high], kept[high + 1] = 0xD800 + (letter >> 10), 0xDC00 + (letter & 0x3FF)
        place = at[place]
    lengths = np.array([len(t) for t in texts], np.int64)
    first = len(EDGE) + np.concatenate(([0], np.cumsum(lengths + len(EDGE))[:-1])) if len(texts) else lengths
    return kept.astype(np.uint16), place[first], place[first + lengths] + 1


def letters(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def codes(syms: np.ndarray) -> np.ndarray:
    """At each position the code of the n-gram that ends there; 0 stands before the beginning."""
    s = syms.astype(np.uint64)
    out = s.copy()
    for k in range(1, ORDER):
        out[k:] |= s[:-k] << np.uint64(16 * k)
    return out


def slot(code: np.ndarray) -> np.ndarray:
    """The key of n-grams in the sorted tables: the whole code, as Spark has it, so that no two share one."""
    return code.astype(np.int64)


def _merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([c for _, c in found])).astype(np.int64)


def count_ngrams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, code, n): the n-grams of all whole texts that have a language. Tasks add up their own before the shuffle."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text is not null and lang is not null")

    def run(batches):
        found: dict[str, list] = {}
        for batch in slices(batches):
            by: dict[str, list[str]] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                held = found.setdefault(lang, [])
                syms, first, end = symbols(texts)
                inside = np.zeros(len(syms) + 1, np.int8)
                np.add.at(inside, first, 1)
                np.add.at(inside, end, -1)
                held.append(np.unique(codes(syms)[np.cumsum(inside[:-1]) > 0], return_counts=True))
                if sum(len(k) for k, _ in held) > HELD:
                    found[lang] = [_merged(held)]
        for lang, held in found.items():
            keys, n = _merged(held)
            for i in range(0, len(keys), 50_000):
                part = keys[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part.astype(np.int64)), pa.array(n[i : i + 50_000])], ["lang", "code", "n"])

    return rows.mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def smoothed(counts: DataFrame) -> DataFrame:
    """(lang, k, context, code, n, value): of each order k the discounted shares of n-grams, and (context true) the weights with which contexts pass on to order k - 1.

    The highest order has counts, each lower one the number of different characters before the
    n-gram (continuation counts). An order's discount is n1 / (n1 + 2 n2) of its counts of counts.
    Each order is written once: texts are counted once, and plans stay small.
    """
    level, tables = counts.select("lang", "code", "n"), []
    for k in range(ORDER, 0, -1):
        level, _ = materialize(level, f"grams{k}")
        discount = level.groupBy("lang").agg(
            F.greatest(F.least((F.count_if(F.col("n") == 1) + 0.5) / (F.count_if(F.col("n") == 1) + 2 * F.count_if(F.col("n") == 2) + 1), F.lit(0.95)), F.lit(0.05)).alias("d")
        )
        grams = level.withColumn("of", F.shiftrightunsigned("code", 16))
        sums, _ = materialize(grams.groupBy("lang", "of").agg(F.sum("n").alias("total"), F.count("*").alias("types")).join(discount, "lang"), f"contexts{k}")
        tables += [
            grams.join(sums, ["lang", "of"]).select("lang", F.lit(k).alias("k"), F.lit(False).alias("context"), "code", "n", ((F.col("n") - F.col("d")) / F.col("total")).alias("value")),
            sums.select("lang", F.lit(k).alias("k"), F.lit(True).alias("context"), F.col("of").alias("code"), F.col("total").alias("n"), (F.col("d") * F.col("types") / F.col("total")).alias("value")),
        ]
        level = level.select("lang", F.col("code").bitwiseAND(F.lit((1 << (16 * (k - 1))) - 1)).alias("code")).groupBy("lang", "code").agg(F.count("*").alias("n"))
    return reduce(DataFrame.unionByName, tables)


#: The tables of the model that a worker used last, by path.
_LOADED: dict[str, tuple[dict, dict]] = {}


def _tables(path: str) -> tuple[dict, dict]:
    """Sorted arrays of n-grams and of contexts by (language's index, k), from the ranges that Spark sorted, in the order of their files."""
    if path not in _LOADED:
        import pyarrow.parquet as pq

        where, root = fs.FileSystem.from_uri(path)
        files = sorted(f.path for f in where.get_file_info(fs.FileSelector(root)) if f.path.endswith(".parquet"))
        found: tuple[dict, dict] = {}, {}
        for name in files:
            table = pq.read_table(name, filesystem=where, partitioning=None)
            part, code, value = (table.column(c).to_numpy() for c in ("part", "code", "value"))
            bounds = np.flatnonzero(np.diff(part, prepend=-1, append=-1)) if len(part) else []
            for a, b in zip(bounds, bounds[1:]):
                lang, k, context = part[a] // (2 * ORDER), part[a] // 2 % ORDER + 1, part[a] % 2
                found[context].setdefault((int(lang), int(k)), []).append((code[a:b], value[a:b]))
        _LOADED.clear()
        _LOADED[path] = tuple({at: tuple(map(np.concatenate, zip(*pieces))) for at, pieces in side.items()} for side in found)
    return _LOADED[path]


@dataclass
class Model:
    """Languages, where the sorted tables of n-grams and contexts are, and what own texts cost."""

    langs: list[str]
    path: str = ""
    limits: dict = field(default_factory=dict)  # language -> highest cross-entropy of a text of its own
    own: tuple[dict, dict] = field(default_factory=lambda: ({}, {}))  # tables of a model without a path

    @property
    def grams(self) -> dict:
        """(language's index, k) -> (sorted codes, shares)"""
        return (_tables(self.path) if self.path else self.own)[0]

    @property
    def contexts(self) -> dict:
        """(language's index, k) -> (sorted codes, weights)"""
        return (_tables(self.path) if self.path else self.own)[1]

    def log_probabilities(self, code: np.ndarray) -> np.ndarray:
        """(languages, n-grams), interpolated from a floor over single characters up."""
        out, grams, contexts = np.empty((len(self.langs), len(code))), self.grams, self.contexts
        parts = [(code & np.uint64((1 << (16 * k)) - 1)) for k in range(1, ORDER + 1)]
        at = [(slot(part), slot(part >> np.uint64(16))) for part in parts]
        for i in range(len(self.langs)):
            p = np.full(len(code), 1e-5)
            for k, (gram, context) in enumerate(at, 1):
                share, _ = _at(grams.get((i, k)), gram, 0.0)
                weight, known = _at(contexts.get((i, k)), context, 1.0)
                p = np.where(known, share + weight * p, p)
            out[i] = np.log(p)
        return out

    def costs(self, texts: list[str | None]) -> np.ndarray:
        """(texts, languages): nats a character."""
        syms, first, end = symbols(texts)
        distinct, where = np.unique(codes(syms), return_inverse=True)
        table = self.log_probabilities(distinct)
        out = np.empty((len(texts), len(self.langs)))
        for i in range(len(self.langs)):
            sums = np.concatenate(([0.0], np.cumsum(table[i][where], dtype=np.float64)))
            out[:, i] = (sums[first] - sums[end]) / np.maximum(end - first, 1)
        return out


def _at(table, wanted: np.ndarray, missing: float) -> tuple[np.ndarray, np.ndarray]:
    if table is None or not len(table[0]):
        return np.full(len(wanted), missing), np.zeros(len(wanted), bool)
    i = np.searchsorted(table[0], wanted).clip(max=len(table[0]) - 1)
    hit = table[0][i] == wanted
    return np.where(hit, table[1][i], missing), hit


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Models of all languages in `train`, counted over every whole text of it; rows without text or language don't count.

    Every n-gram of the corpus is kept under its own code. Spark sorts them by ranges into a table
    in the shared folder, which workers read: the driver gets the names of the languages and the
    limits of rejection only. These are fitted on all rows that are counted. Repeated rows count each time.
    """
    spark = train.sparkSession
    counts, _ = materialize(count_ngrams(train, id_col, text_col, lang_col), "ngrams")
    model = Model(sorted(r.lang for r in counts.select("lang").distinct().collect()))
    numbers = spark.createDataFrame(list(zip(model.langs, range(len(model.langs)))), "lang string, number int")
    part = (F.col("number") * ORDER + F.col("k") - 1) * 2 + F.col("context").cast("int")
    table = smoothed(counts).join(F.broadcast(numbers), "lang").select(part.alias("part"), "code", F.col("value").cast("float").alias("value"))
    _, model.path = materialize(table.repartitionByRange("part", "code").sortWithinPartitions("part", "code"), "language-model")
    known = train.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = known.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    costs = _identified(rows, model, ["lang"]).filter(F.col("lang") == F.col("lang_pred")).groupBy("lang").agg(F.avg("cross_entropy").alias("mean"), F.stddev_pop("cross_entropy").alias("spread"))
    model.limits = {r.lang: r["mean"] + REJECT * max(r.spread, 0.05) for r in costs.collect()}
    return model


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, cross_entropy, rejected) for each row.

    lang_pred is the language whose model needs the fewest nats a character, ties to the first by
    name; `und`, with score 0, for null texts, texts without a letter, and where no language was
    learned. rejected marks texts that cost their language far more than its own texts do. One
    pass, no shuffle; only id and text are read.
    """
    return _identified(id_and_text(docs, id_col, text_col), model)


def _identified(rows: DataFrame, model: Model, more: list[str] = ()) -> DataFrame:
    """identify() of rows (id, text), with the columns `more` of them, all strings."""

    def run(batches):
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            known = np.array([letters(t) for t in texts], bool) & bool(model.langs)
            pred, score, cost, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan), np.zeros(len(texts), bool)
            if known.any():
                rows = np.flatnonzero(known)
                found = model.costs([texts[i] for i in rows])
                best = found.argmin(1)
                gap = np.exp(-(found - found.min(1, keepdims=True)) * SHARPNESS)
                cost[rows], score[rows] = found.min(1), 1 / gap.sum(1)
                for i, b, c in zip(rows.tolist(), best.tolist(), cost[rows].tolist()):
                    pred[i] = model.langs[b]
                    rejected[i] = c > model.limits.get(pred[i], math.inf)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(pred), pa.array(score), pa.array(cost, from_pandas=True), pa.array(rejected), *(batch.column(c) for c in more)],
                ["doc_id", "lang_pred", "score", "cross_entropy", "rejected", *more],
            )

    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean" + "".join(f", {c} string" for c in more))
