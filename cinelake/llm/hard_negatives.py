"""Operator 12, hard-negative mining: ball trees of blocks of rows, searched by branch and bound inside score windows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinelake.llm.common import exact_kind, materialize, matrix, whole_vectors

SCALE = 256
#: Bytes of whole components of a block: one of anchors meets one of candidates in a task.
ANCHOR_BYTES, CANDIDATE_BYTES = 1 << 20, 4 << 20
#: Rows of a leaf.
LEAF = 96
#: Share of |q| (|c| + r) by which bounds are widened for the rounding of doubles.
SLACK = 1e-9
_NONE = -(1 << 62)


@dataclass
class BallTree:
    """Nodes of a block's rows: ball centres and radii, and the rows of each leaf. Children of node i are kids[i]; a leaf has none."""

    centres: np.ndarray
    radii: np.ndarray
    kids: list[tuple[int, int] | None]
    rows: list[np.ndarray]

    @staticmethod
    def over(x: np.ndarray, leaf: int = LEAF) -> BallTree:
        """Parts rows by which of two rows that lie far apart is nearer, until leaves are small; rows that are all equal stay one leaf."""
        centres, radii, kids, rows = [], [], [], []
        todo = [(np.arange(len(x)), None)]
        while todo:
            own, parent = todo.pop()
            me, points = len(centres), x[own]
            centre = points.mean(0)
            far = ((points - centre) ** 2).sum(1)
            centres.append(centre)
            radii.append(np.sqrt(far.max()) * (1 + SLACK))
            kids.append(None)
            rows.append(own)
            if parent is not None:
                kids[parent] = (me,) if kids[parent] is None else (*kids[parent], me)
            if len(own) > leaf and far.max() > 0:
                a = points[far.argmax()]
                b = points[((points - a) ** 2).sum(1).argmax()]
                along = points @ (b - a)
                near = along < (b @ b - a @ a) / 2  # nearer to a than to b
                if not len(own) // 16 < near.sum() < len(own) - len(own) // 16:  # lopsided: halves instead
                    near = np.zeros(len(own), bool)
                    near[np.argsort(along, kind="stable")[: len(own) // 2]] = True
                rows[me] = own[:0]
                todo += [(own[near], me), (own[~near], me)]
        return BallTree(np.array(centres), np.array(radii), kids, rows)


def search(tree: BallTree, x: np.ndarray, ids: np.ndarray, q: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, may: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """(scores, ids, leaf products): of each query its k rows of the largest whole inner product within [low, high], ties to the smaller id.

    Query t asks with vector q[of[t]]; may(queries, rows) tells which rows count for which. A ball of
    centre c and radius r holds products from q.c - |q| r to q.c + |q| r: a node is left out for a
    query if that lies outside its window, or strictly beneath its k-th score so far. Equal scores
    stay in, since a smaller id may win.
    """
    best, found = np.full((len(of), k), _NONE), np.full((len(of), k), np.iinfo(np.int64).max)
    largest = x.shape[1] * max(int(np.abs(x).max(initial=0)), 1) * max(int(np.abs(q).max(initial=0)), 1)
    kind = exact_kind(largest)
    qf, xk, qk = q.astype(np.float64), x.astype(kind), q.astype(kind)
    norm = np.sqrt((qf * qf).sum(1))
    middle, reach = qf @ tree.centres.T, norm[:, None] * tree.radii[None, :]
    room = SLACK * (norm[:, None] * (np.sqrt((tree.centres**2).sum(1)) + tree.radii)[None, :]) + 0.5
    most, least = middle + reach + room, middle - reach - room
    todo, products = [(0, np.arange(len(of)))], 0
    while todo:
        node, asks = todo.pop()
        own = of[asks]
        asks = asks[(most[own, node] >= np.maximum(low[asks], best[asks, -1])) & (least[own, node] <= high[asks])]
        if not len(asks):
            continue
        if kids := tree.kids[node]:
            # the child that promises more comes first: the later one meets higher k-th scores
            todo += [(child, asks) for child in sorted(kids, key=lambda c: most[of[asks], c].sum())]
            continue
        rows = tree.rows[node]
        anchors, back = np.unique(of[asks], return_inverse=True)
        scores = np.asarray(qk[anchors] @ xk[rows].T).astype(np.int64)[back]
        products += len(anchors) * len(rows)
        good = may(asks, rows) & (scores >= np.maximum(low[asks], best[asks, -1])[:, None]) & (scores <= high[asks][:, None])
        hit = np.flatnonzero(good.any(1))
        if len(hit):
            t = asks[hit]
            s = np.concatenate((best[t], np.where(good[hit], scores[hit], _NONE)), 1)
            i = np.concatenate((found[t], np.where(good[hit], ids[rows][None, :], np.iinfo(np.int64).max)), 1)
            first = np.lexsort((i, -s), axis=1)[:, :k]
            best[t], found[t] = np.take_along_axis(s, first, 1), np.take_along_axis(i, first, 1)
    return best, found, products


def _blocks(rows: Column, width: Column, budget: int) -> Column:
    return F.greatest(F.ceil(rows * width * 4 / budget), F.lit(1)).cast("int")


def _every(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), n - 1))


def _dealt(n: Column) -> Column:
    """A row's block by its number, so that repeated rows are spread too."""
    return F.pmod(F.xxhash64("nr"), n).cast("int")


def _first(found: DataFrame, key: list[str], k: int, other: str, score: str, rank: str) -> DataFrame:
    """The k best rows of each key over all blocks; Spark cuts each task's rows to k a key before they move."""
    best = Window.partitionBy(*key).orderBy(F.desc(score), other)
    return found.withColumn(rank, F.row_number().over(best)).filter(F.col(rank) <= k)


def _share(score: np.ndarray, percent: int, up: bool) -> np.ndarray:
    """percent of a score, as the least or largest whole number on its side, without leaving 64 bits."""
    whole, rest = score // 100, score % 100
    return percent * whole + (-(-percent * rest // 100) if up else percent * rest // 100)


def _positives(rows: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """(anchor, digest, label, positive, score, place): the k rows of an anchor's label with the largest product, itself (by id) left out.

    Rows of a label are dealt into blocks by hash, so a label with a third of all rows is many blocks.
    """
    size = F.first("d")
    counts = rows.groupBy("d", "label").agg(_blocks(F.count("*"), size, CANDIDATE_BYTES).alias("cbs"))
    asked = anchors.groupBy("d", "label").agg(_blocks(F.count("*"), size, ANCHOR_BYTES).alias("qbs"))
    dealt = counts.join(asked, ["d", "label"])
    key = ["d", "label", "cb", "qb"]
    left = anchors.join(dealt, ["d", "label"]).select("d", "label", _every(F.col("cbs")).alias("cb"), _dealt(F.col("qbs")).alias("qb"), F.lit(True).alias("asks"), "id", "digest", "v")
    right = rows.join(dealt, ["d", "label"]).select("d", "label", _dealt(F.col("cbs")).alias("cb"), _every(F.col("qbs")).alias("qb"), F.lit(False).alias("asks"), "id", F.lit(0).cast("long").alias("digest"), "v")

    def tile(table: pa.Table) -> pa.Table:
        asks, ids, digests = (np.asarray(table.column(c)) for c in ("asks", "id", "digest"))
        v = matrix(table.column("v").combine_chunks(), int(table.column("d")[0].as_py()))
        a, c = np.flatnonzero(asks), np.flatnonzero(~asks)
        out = (np.empty(0, np.int64),) * 4
        if len(a) and len(c):
            n = len(a)
            best, found, _ = search(BallTree.over(v[c].astype(np.float64)), v[c], ids[c], v[a], np.arange(n), np.full(n, _NONE + 1), np.full(n, -_NONE), k, lambda t, r: ids[a][t][:, None] != ids[c][r][None, :])
            i, j = np.nonzero(best > _NONE)
            out = ids[a][i], digests[a][i], found[i, j], best[i, j]
        return pa.table([pa.array(z) for z in out], ["anchor", "digest", "positive", "score"])

    found = left.unionByName(right).groupBy(*key).applyInArrow(tile, "anchor long, digest long, positive long, score long")
    return _first(found, ["anchor", "digest"], k, "positive", "score", "place")


def mine(
    vectors: DataFrame, anchor: Column, label: Column | str = "label", positives: int = 5, negatives: int = 3, least_percent: int = 50, most_percent: int = 95,
    scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): rows of other labels that score nearly as high as a positive.

    Rows for which `anchor` holds ask. Components become floor(scale * x), a score is the inner
    product of these whole numbers, exact. An anchor's positives are its `positives` best rows of its
    own label; for each, the `negatives` best rows of other labels come whose score lies between the
    two percentages of the positive's. Higher scores come first, ties go to the smaller id.

    Rows take no part whose id, label or vector is null, whose vector is empty, holds null or
    non-finite components or such as reach 2**24 after scaling. Vectors of another length than the
    anchor's aren't compared with it. A row never meets rows of its own id. Repeated rows are
    candidates of their own and ask once; an anchor whose positives score below 0 has no negatives,
    since the window is empty. Only the named columns are read; an empty table gives no rows.

    Anchors and rows are dealt into blocks of bounded bytes; a block of anchors and one of rows meet
    in a task, which builds a ball tree of the rows and sends on a few rows a query.
    """
    name = F.col(label) if isinstance(label, str) else label
    rows = whole_vectors(vectors, id_col, vec_col, scale, name.alias("label"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"))
    rows, _ = materialize(rows.filter("id is not null and label is not null").withColumns({"d": F.size("v"), "nr": F.monotonically_increasing_id()}), "negatives")
    anchors = rows.filter("is_anchor").select("d", "nr", "id", "label", "v", F.xxhash64("label", "v").alias("digest")).dropDuplicates(["id", "digest"])
    pairs, _ = materialize(_positives(rows, anchors, positives), "positives")
    told = pairs.groupBy("anchor", "digest").agg(F.sort_array(F.collect_list(F.struct("place", "positive", "score"))).alias("p"))
    asked = anchors.join(told, (anchors.id == told.anchor) & (anchors.digest == told.digest)).select("d", "nr", "id", anchors.digest, "label", "v", F.transform("p", lambda s: s["positive"]).alias("positives"), F.transform("p", lambda s: s["score"]).alias("scores"))

    counts = rows.groupBy("d").agg(_blocks(F.count("*"), F.col("d"), CANDIDATE_BYTES).alias("cbs"), _blocks(F.count_if("is_anchor"), F.col("d"), ANCHOR_BYTES).alias("qbs"))
    none = F.array().cast("array<long>")
    left = asked.join(counts, "d").select("d", _every(F.col("cbs")).alias("cb"), _dealt(F.col("qbs")).alias("qb"), F.lit(True).alias("asks"), "id", "digest", "label", "v", "positives", "scores")
    right = rows.join(counts, "d").select("d", _dealt(F.col("cbs")).alias("cb"), _every(F.col("qbs")).alias("qb"), F.lit(False).alias("asks"), "id", F.lit(0).cast("long").alias("digest"), "label", "v", none.alias("positives"), none.alias("scores"))
    names = ["anchor", "digest", "place", "positive", "positive_score", "negative", "score"]

    def tile(table: pa.Table) -> pa.Table:
        asks, ids, digests = (np.asarray(table.column(c)) for c in ("asks", "id", "digest"))
        v = matrix(table.column("v").combine_chunks(), int(table.column("d")[0].as_py()))
        # labels of any type as whole numbers
        codes = table.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        a, c = np.flatnonzero(asks), np.flatnonzero(~asks)
        out = (np.empty(0, np.int64),) * len(names)
        if len(a) and len(c):
            told = table.filter(table.column("asks"))
            each = np.array([len(p) for p in told.column("positives").to_pylist()], np.int64)
            of = np.repeat(np.arange(len(a)), each)
            place = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each) + 1
            positive, score = (np.concatenate([np.array(p, np.int64) for p in told.column(n).to_pylist()]) for n in ("positives", "scores"))
            low, high = _share(score, least_percent, up=True), _share(score, most_percent, up=False)
            other = lambda t, r: codes[a][of[t]][:, None] != codes[c][r][None, :]
            best, found, _ = search(BallTree.over(v[c].astype(np.float64)), v[c], ids[c], v[a], of, low, high, negatives, other)
            i, j = np.nonzero(best > _NONE)
            out = ids[a][of[i]], digests[a][of[i]], place[i], positive[i], score[i], found[i, j], best[i, j]
        return pa.table([pa.array(z) for z in out], names)

    found = left.unionByName(right).groupBy("d", "qb", "cb").applyInArrow(tile, ", ".join(f"{n} long" for n in names))
    ranked = _first(found, ["anchor", "digest", "place"], negatives, "negative", "score", "rank")
    return ranked.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("negative").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
