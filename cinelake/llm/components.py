"""Connected components by alternating star contractions, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinelake.llm.common import drop_path, materialize


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("big", "small")), F.sum(F.xxhash64("small") % 1_000_003)).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge: the smallest node that it reaches.

    Nodes may be of any type that can be ordered. Edges of a node with itself or with null don't
    count; repeated edges count once. Each round hangs every node on its smallest neighbour's
    smallest neighbour, so the rounds grow with the logarithm of the nodes and the edges stay about
    as many. Minima are pre-aggregated before the shuffle; each round's tables go to the shared
    folder, so the joins are between plain scans, whose skewed partitions Spark can split, and an
    executor that is lost costs no earlier round.
    """
    spark = edges.sparkSession
    start = edges.select(F.greatest(a, b).alias("big"), F.least(a, b).alias("small")).filter("big != small").distinct()
    held, path = materialize(start, "edges")
    mark = _mark(held)
    while mark[0]:
        both = held.select(F.col("big").alias("u"), F.col("small").alias("v")).unionByName(held.select(F.col("small").alias("u"), F.col("big").alias("v")))
        least, least_path = materialize(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
        large, large_path = materialize(held.join(least, held.small == least.u).select("big", F.col("m").alias("small")).distinct(), "large")
        low = large.groupBy("big").agg(F.min("small").alias("m"))
        small = large.join(low, "big").filter("small != m").select(F.col("small").alias("big"), F.col("m").alias("small")).unionByName(low.select("big", F.col("m").alias("small"))).distinct()
        held, new_path = materialize(small, "edges")
        for old in (path, least_path, large_path):
            drop_path(spark, old)
        path, before, mark = new_path, mark, _mark(held)
        if mark == before:
            break
    return held.select(F.col("big").alias("node"), F.col("small").alias("component")).unionByName(held.select(F.col("small").alias("node"), F.col("small").alias("component")).distinct())
