"""Operator 11, vector code compression: product codebooks by Lloyd's rounds in whole numbers, with Hamerly's bounds."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinelake.llm.common import drop_path, exact_kind, lists, materialize, matrix, whole_vectors

#: Parts of a vector, entries of each part's codebook, rounds of updates, and what a component is multiplied by before its floor.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Whole numbers of distances that a task holds at a time.
HELD = 1 << 22
#: Room for the rounding of square roots, far above it: an upper bound is raised and a lower one lowered by this share.
SLACK = 1e-12


@dataclass(frozen=True)
class Codebooks:
    """entries[part, index] is an entry; of fixed size whatever the number of vectors."""

    entries: np.ndarray
    scale: int = SCALE

    @property
    def width(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str:
        """Of the decimal components, comma-joined by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x and of book, exact: components are below 2**24, so differences of two fit 26 bits."""
    most = 2 * max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)), 1)
    kind = exact_kind(x.shape[1] * most * most)
    a, b = x.astype(kind), book.astype(kind)
    return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, nearest, second): of each row the nearest entry, ties to the lower index, and the roots of its squared distance and of the next entry's."""
    index, nearest, second = np.empty(len(x), np.uint8), np.empty(len(x)), np.full(len(x), np.inf)
    step = max(1, HELD // len(book))
    for i in range(0, len(x), step):
        d = _distances(x[i : i + step], book)
        some = slice(i, i + len(d))
        index[some] = d.argmin(1)
        nearest[some] = np.sqrt(d.min(1))
        if len(book) > 1:
            second[some] = np.sqrt(np.partition(d, 1, axis=1)[:, 1])
    return index, nearest, second


def _raised(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 + SLACK)).astype(np.float32), np.float32(np.inf))


def _lowered(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 - SLACK)).astype(np.float32), np.float32(-np.inf))


def squared(x: np.ndarray, book: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Each row's exact squared distance from its own entry."""
    off = x.astype(np.int64) - book[index]
    return (off * off).sum(1)


@dataclass(frozen=True)
class _Step:
    """What rows need to follow one update of a part's codebook: how far entries moved, and half the way from each to its next."""

    book: np.ndarray
    moved: np.ndarray
    others_moved: np.ndarray
    half_gap: np.ndarray

    @staticmethod
    def of(before: np.ndarray, book: np.ndarray) -> _Step:
        moved = np.sqrt(((book - before).astype(np.float64) ** 2).sum(1)) * (1 + SLACK)
        # the largest move of any entry but the row's own
        first = int(moved.argmax())
        others = np.full(len(book), moved[first])
        others[first] = np.delete(moved, first).max(initial=0.0)
        gaps = np.sqrt(_distances(book, book).astype(np.float64))
        np.fill_diagonal(gaps, np.inf)
        return _Step(book, moved, others, gaps.min(1) / 2 * (1 - SLACK))

    def follow(self, x: np.ndarray, index: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The rows' new entries and bounds, and how many rows had to be compared with all entries.

        A row whose upper bound is strictly below its second-nearest lower bound, or below half the
        way from its entry to the next, keeps its entry: no other can be as near. Equality proves
        nothing, since a lower index may win the tie, and leads to the full scan.
        """
        up, low = upper.astype(np.float64) + self.moved[index], np.maximum(lower.astype(np.float64) - self.others_moved[index], 0.0)
        safe = np.maximum(low * (1 - SLACK), self.half_gap[index])
        open_ = np.flatnonzero(~(up * (1 + SLACK) < safe))
        if len(open_):
            up[open_] = np.sqrt(squared(x[open_], self.book, index[open_]).astype(np.float64))
            open_ = open_[~(up[open_] * (1 + SLACK) < safe[open_])]
        index = index.copy()
        if len(open_):
            index[open_], up[open_], low[open_] = scan(x[open_], self.book)
        return index, _raised(up), _lowered(low), len(open_)


def _batch(batch: pa.RecordBatch, codes: np.ndarray, **more: pa.Array) -> pa.RecordBatch:
    n, parts = codes.shape
    packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1, dtype=np.int32) * parts).tobytes()), pa.py_buffer(np.ascontiguousarray(codes).tobytes())])
    columns = {"id": batch.column("id"), "label": batch.column("label"), "code": packed, **more}
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _codes(column: pa.BinaryArray, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), parts)


def _label(df: DataFrame) -> str:
    return df.schema["label"].dataType.simpleString()


def _assigned(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """Every row with its nearest entries and both bounds of each part: the only full scan of all rows."""
    parts, _, wide = books.shape

    def run(batches):
        for batch in batches:
            v = matrix(batch.column("v"), parts * wide)
            found = [scan(v[:, p * wide : (p + 1) * wide], books[p]) for p in range(parts)]
            codes, up, low = (np.stack(z, 1) for z in zip(*found))
            yield _batch(batch, codes, upper=lists(_raised(up)), lower=lists(_lowered(low)), v=batch.column("v"))

    return rows.select("id", "label", "v").mapInArrow(run, f"id long, label {_label(rows)}, code binary, upper array<float>, lower array<float>, v array<int>")


def _followed(rows: DataFrame, before: np.ndarray, books: np.ndarray, last: bool) -> DataFrame:
    """Rows after an update of the codebooks; at the end with their error in place of bounds and vector. `scanned` counts the parts that bounds did not settle."""
    parts, _, wide = books.shape
    steps = [_Step.of(before[p], books[p]) for p in range(parts)]

    def run(batches):
        for batch in batches:
            v, codes = matrix(batch.column("v"), parts * wide), _codes(batch.column("code"), parts)
            up, low = matrix(batch.column("upper"), parts), matrix(batch.column("lower"), parts)
            cut = [v[:, p * wide : (p + 1) * wide] for p in range(parts)]
            found = [steps[p].follow(cut[p], codes[:, p], up[:, p], low[:, p]) for p in range(parts)]
            new = np.stack([f[0] for f in found], 1)
            if last:
                error = sum(squared(cut[p], books[p], new[:, p]) for p in range(parts))
                yield _batch(batch, new, error=pa.array(error))
            else:
                yield _batch(batch, new, upper=lists(np.stack([f[1] for f in found], 1)), lower=lists(np.stack([f[2] for f in found], 1)), v=batch.column("v"))

    kept = f"id long, label {_label(rows)}, code binary"
    return rows.mapInArrow(run, f"{kept}, error long" if last else f"{kept}, upper array<float>, lower array<float>, v array<int>")


def _updated(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Entries replaced by the floors of their parts' means; unused ones stay. Tasks send a sum for each entry, never rows."""
    parts, entries, wide = books.shape

    def run(batches):
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, wide), np.int64)
        for batch in batches:
            v, codes = matrix(batch.column("v"), parts * wide), _codes(batch.column("code"), parts)
            for p in range(parts):
                n[p] += np.bincount(codes[:, p], minlength=entries)
                order = np.argsort(codes[:, p], kind="stable")
                used, first = np.unique(codes[order, p], return_index=True)
                if len(used):
                    total[p, used] += np.add.reduceat(v[order, p * wide : (p + 1) * wide].astype(np.int64), first, axis=0)
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n[p, e]), lists(total[p, e])], ["part", "entry", "n", "total"])

    sent = rows.select("code", "v").mapInArrow(run, "part int, entry int, n long, total array<long>")
    sums = sent.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("total")[i]) for i in range(wide))).alias("total"))
    out = books.copy()
    for row in sums.collect():  # one row an entry
        out[row.part, row.entry] = np.array(row.total, np.int64) // row.n
    return out


def _first(rows: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """The codebooks to start from: the parts of the rows with the smallest ids; None without rows."""
    ordered = rows.orderBy(F.col("id").asc_nulls_last(), "v")
    found = ordered.select("v").limit(entries).collect()
    if found and any(len(r.v) != len(found[0].v) for r in found):
        found = ordered.filter(F.size("v") == len(found[0].v)).select("v").limit(entries).collect()
    if not found:
        return None
    v = np.array([r.v for r in found], np.int64)
    return v.reshape(len(v), parts, -1).transpose(1, 0, 2).copy()


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> tuple[Codebooks | None, DataFrame | None]:
    """Codebooks, and (id, label, code, error) of each row that takes part, written to the shared folder; None, None if no row does.

    The codebooks start as the parts of the rows with the smallest ids, in order of id, then vector.
    Each round assigns every part to its nearest entry and moves entries to the floor of their
    parts' mean; at the end parts are assigned once more. All distances and sums are whole numbers.
    Between rounds each row keeps its codes, and of each part an upper bound of the distance to its
    entry and a lower bound of that to the second nearest, in the shared folder: an executor that is
    lost costs no earlier round. The driver gets sums of fixed size only.
    """
    if not 1 <= entries <= 256 or rounds < 0:
        raise ValueError("codebooks have 1 to 256 entries, and rounds aren't negative")
    rows = whole_vectors(vectors, id_col, vec_col, scale, F.col(label_col).alias("label")).filter(F.size("v") % parts == 0)
    books = _first(rows, parts, entries)
    if books is None:
        return None, None
    rows = rows.filter(F.size("v") == books.shape[0] * books.shape[2])
    held, path = materialize(_assigned(rows, books), "codes")
    before = books
    for left in range(rounds, 0, -1):
        before, books = books, _updated(held, books)
        new, new_path = materialize(_followed(held, before, books, last=left == 1), "codes")
        drop_path(rows.sparkSession, path)
        held, path = new, new_path
    if not rounds:
        held = _followed(held, books, books, last=True)
    return Codebooks(books, scale), held


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): the hexadecimal codes of each vector, its squared error, that of all rows of its label, and the digest of the codebooks.

    Rows take no part whose vector is null or empty, holds null or non-finite components or such as
    reach 2**24 after scaling, whose length `parts` does not divide or is not that of the row with
    the smallest id. Null ids come last and are coded, null labels are summed together, repeated
    rows are rows of their own, copies of an entry lose ties to the lowest index. An empty table
    gives none. Only the three named columns are read.
    """
    spark = vectors.sparkSession
    books, coded = fit(vectors, parts, entries, rounds, scale, id_col, vec_col, label_col)
    if coded is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256")
    )


def decode(coded: DataFrame, books: Codebooks, code_col: str = "code") -> DataFrame:
    """coded with `decoded`: the vector that a binary code stands for, each component the middle of its step; null where the code is null or of another length."""
    parts, _, wide = books.entries.shape
    table = ((books.entries + 0.5) / books.scale).astype(np.float32)
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema.fields if f.name != "decoded")

    def run(batches):
        for batch in batches:
            codes = batch.column(code_col)
            fits = np.array([c.is_valid and len(c.as_py()) == parts for c in codes], bool)
            which = _codes(codes.filter(pa.array(fits)), parts)
            rows = table[np.arange(parts)[None, :], np.minimum(which, table.shape[1] - 1)].reshape(-1, parts * wide)
            at = np.where(fits, np.cumsum(fits) - 1, 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists(rows).take(pa.array(at, mask=~fits))], [*batch.schema.names, "decoded"])

    return coded.drop("decoded").mapInArrow(run, f"{kind}, decoded array<float>")
