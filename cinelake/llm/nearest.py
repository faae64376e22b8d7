"""Operator 10, approximate nearest neighbours by a block matrix join of int8 tiles with error bounds."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of a block: a tile multiplies one block of queries by one of candidates.
QUERY_BLOCK, CANDIDATE_BLOCK = 2_048, 8_192
#: Components whose int8 products are summed at a time.
EXACT = 1_024


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v): rows with an id and a vector that isn't null, empty or zero and has only finite components."""
    v = F.col(vec_col).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def quantised(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors as int8 with one scale each: m / |m| is about scale * q, and off by scale / 2 a component at most."""
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    scale = np.abs(unit).max(1) / 127
    return np.rint(unit / scale[:, None]).astype(np.int8), scale


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row in double precision, each sum in the order of the components."""
    dot, na, nb = (np.zeros(len(a)) for _ in range(3))
    for x, y in zip(a.T, b.T):
        dot += x * y
        na += x * x
        nb += y * y
    return dot / np.sqrt(na * nb)


def tile_best(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple[int, float, int]]:
    """For each query its k nearest of the tile (query, score, candidate).

    The product of int8 vectors gives each cosine to within a bound; only candidates whose upper
    bound reaches the k-th best lower bound are computed from the original vectors.
    """
    qi, qs = quantised(q)
    ci, cs = quantised(c)
    d = q.shape[1]
    # |u.w - s t (q.c)| <= |u|(t sqrt(d) / 2) + |w|(s sqrt(d) / 2) + s t d / 4 with unit u and w; the rest is for rounding
    bound = (qs[:, None] + cs[None, :]) * (np.sqrt(d) / 2) + qs[:, None] * cs[None, :] * (d / 4) + 1e-6
    # 127 * 127 * EXACT is below 2**24: such whole numbers are exact in float32, for which there is fast multiplication
    about = np.zeros((len(q), len(c)))
    for i in range(0, d, EXACT):
        about += qi[:, i : i + EXACT].astype(np.float32) @ ci[:, i : i + EXACT].astype(np.float32).T
    about *= qs[:, None] * cs[None, :]
    about[q_ids[:, None] == c_ids[None, :]] = -np.inf
    low = about - bound
    kth = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(q), -np.inf)
    rows, columns = np.nonzero((about + bound >= kth[:, None]) & (about > -np.inf))
    scores = cosines(q[rows], c[columns])
    start = np.searchsorted(rows, np.arange(len(q) + 1))
    for i, query in enumerate(q_ids.tolist()):
        some = slice(start[i], start[i + 1])
        for score, other in heapq.nsmallest(k, zip((-scores[some]).tolist(), c_ids[columns[some]].tolist())):
            yield query, -score, other


def _matrix(ids: list, vectors: list) -> tuple[np.ndarray, np.ndarray]:
    return np.array(ids, np.int64), np.array(vectors, np.float64)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k rows of `vectors` with the largest cosine, itself (by id) left out.

    Ties go to the smaller vec_id; if there are fewer than k candidates, all come. Null, empty and
    zero vectors, those with null or non-finite components, null ids, and candidates of another
    length than the query take no part; rows that repeat an id and vector count once. Other columns don't matter.

    Queries and candidates are dealt into blocks by hash; every query block meets every candidate
    block in one task of bounded size, which sends on k rows a query. These short lists are merged by heaps.
    """
    size = F.size("v")
    candidates, asked = usable(vectors, id_col, vec_col).dropDuplicates(["id", "v"]), usable(queries, id_col, vec_col).dropDuplicates(["id", "v"])
    n_candidates, n_queries = candidates.count(), asked.count()
    c_blocks, q_blocks = -(-n_candidates // CANDIDATE_BLOCK) or 1, -(-n_queries // QUERY_BLOCK) or 1
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select(size.alias("d"), every(c_blocks).alias("cb"), block(q_blocks).alias("qb"), F.lit(True).alias("asks"), "id", "v")
    right = candidates.select(size.alias("d"), block(c_blocks).alias("cb"), every(q_blocks).alias("qb"), F.lit(False).alias("asks"), "id", "v")

    def tiles(table: pa.Table) -> pa.Table:
        out = ([], [], [])
        asks = np.array(table.column("asks").to_pylist(), bool)
        if asks.any() and not asks.all():
            ids, v = _matrix(table.column("id").to_pylist(), table.column("v").to_pylist())
            q, c = np.flatnonzero(asks), np.flatnonzero(~asks)
            c = c[np.argsort(ids[c], kind="stable")]
            for i in range(0, len(q), 256):
                for row in tile_best(ids[q[i : i + 256]], v[q[i : i + 256]], ids[c], v[c], k):
                    for column, value in zip(out, row):
                        column.append(value)
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.int64())], ["query_id", "score", "vec_id"])

    def merge(table: pa.Table) -> pa.Table:
        heaps: dict[int, list] = {}
        for query, score, other in zip(*(table.column(c).to_pylist() for c in ("query_id", "score", "vec_id"))):
            heap = heaps.setdefault(query, [])
            if len(heap) < k:
                heapq.heappush(heap, (score, -other))
            else:
                heapq.heappushpop(heap, (score, -other))
        rows = [(query, rank, -other, score) for query, heap in heaps.items() for rank, (score, other) in enumerate(sorted(heap, reverse=True), 1)]
        columns = list(zip(*rows)) or [(), (), (), ()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.float64()))], ["query_id", "rank", "vec_id", "score"])

    best = left.unionByName(right).groupBy("d", "qb", "cb").applyInArrow(tiles, "query_id long, score double, vec_id long")
    buckets = max(1, n_queries * c_blocks // 16_384)
    return best.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(buckets)).alias("bucket")).applyInArrow(merge, "query_id long, rank int, vec_id long, score double")
