"""Operator 8, benchmark decontamination: MinHash containment search by size of item, verified by exact shingle containment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinelake.llm.common import hash_words, id_and_text, materialize, plain_words, shingle_hashes, slices, summed_array

WORDS = 5
CONTAINMENT = 0.8
#: A filter has FILTER_EACH bits for each shingle of the items, MOST_BITS (16 MB) at most: a fuller one only lets more rows through to the join.
FILTER_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 27


def sketch_size(n: int, share: float) -> int:
    """MinHash values that an item of n shingles keeps: of so many at least one is in any text that holds `share` of the item."""
    return n - int(np.ceil(share * n - 1e-9)) + 1


def item_shingles(items: DataFrame, k: int = WORDS, share: float = CONTAINMENT, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, copy, width, size, shingle, n, sketched) for each distinct shingle of each item.

    Shingles have k words; an item of fewer words is one shingle of `width` words. Items are
    partitioned by `size`, the logarithm of their shingles, and the smallest sketch_size(n) hashes
    of an item are its MinHash values. Null and empty items, and null ids, have no rows; different
    texts of one id are told apart by `copy`.
    """

    def run(batches):
        for batch in slices(batches):
            for item, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                words = hash_words(plain_words(text))
                found = np.unique(shingle_hashes(words, k))
                if n := len(found):
                    columns = [pa.array([v] * n, t) for v, t in ((item, pa.int64()), (xxhash.xxh64_intdigest(words.tobytes()) >> 1, pa.int64()), (min(k, len(words)), pa.int32()), (n.bit_length(), pa.int32()))]
                    yield pa.RecordBatch.from_arrays(
                        [*columns, pa.array(found.astype(np.int64)), pa.array([n] * n, pa.int64()), pa.array(np.arange(n) < sketch_size(n, share))],
                        ["item", "copy", "width", "size", "shingle", "n", "sketched"],
                    )

    rows = id_and_text(items, id_col, text_col).filter("id is not null").distinct()
    return rows.mapInArrow(run, "item long, copy long, width int, size int, shingle long, n long, sketched boolean")


def _filter_of(shingles: DataFrame, bits: int) -> np.ndarray:
    """Bits at two places for each shingle of a size, as packed bytes."""

    def fill(batches):
        held = np.zeros(bits, bool)
        for batch in batches:
            for at in _places(batch.column("shingle").to_numpy().astype(np.uint64), batch.column("size").to_numpy(), bits):
                held[at] = True
        return np.packbits(held).view("<i8").astype(np.int64)

    return summed_array(shingles.select("shingle", "size"), fill, bits // 64, merge=np.bitwise_or).astype("<i8").view(np.uint8)


def _places(hashes: np.ndarray, size, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mixed = (hashes ^ np.asarray(size).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    mask = np.uint64(bits - 1)
    return ((mixed >> np.uint64(32)) & mask).astype(np.int64), ((mixed >> np.uint64(5)) & mask).astype(np.int64)


def _held(packed: np.ndarray, hashes: np.ndarray, size: int) -> np.ndarray:
    """Whether the filter may hold each hash among the shingles of a size."""
    out = np.ones(len(hashes), bool)
    for at in _places(hashes, size, 8 * len(packed)):
        out &= (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
    return out


def contaminated(docs: DataFrame, items: DataFrame, k: int = WORDS, share: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment): pairs where the document holds at least `share` of the item's distinct k-word shingles.

    Words are what ASCII white space and punctuation leave, A-Z in lower case; an item of fewer than
    k words is one shingle of as many words, wherever a document has them. Null and empty texts and
    null ids on either side take no part. Rows that repeat a document's id count together, as one
    set; of an item id with several texts the one of which most is held counts.

    Items are partitioned by size. Of each size, a document sends on only shingles that an item of
    it has, and only if one is in the MinHash sketch of one. The sketch of an item grows with its
    size such that no document with enough of the item misses all of it, so the search loses
    nothing; long documents cost no more than their own pass.
    """
    of_items, _ = materialize(item_shingles(items, k, share, item_col, item_text), "items")
    # few: widths up to k, and logarithms of sizes
    kinds = sorted((r.width, r["size"]) for r in of_items.select("width", "size").distinct().collect())
    bits = min(max(LEAST_BITS, 1 << (FILTER_EACH * of_items.count()).bit_length()), MOST_BITS)
    sketches, everything = _filter_of(of_items.filter("sketched"), bits), _filter_of(of_items, bits)

    def run(batches):
        for batch in slices(batches):
            owners, sizes, found = [], [], []
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                words = hash_words(plain_words(text))
                of_width: dict[int, np.ndarray] = {}
                for width, size in kinds:
                    if len(words) < width:
                        continue
                    if width not in of_width:
                        of_width[width] = shingle_hashes(words, width)
                    hashes = of_width[width]
                    hashes = hashes[_held(everything, hashes, size)]
                    if len(hashes) and _held(sketches, hashes, size).any():
                        hashes = np.unique(hashes)
                        owners.append(np.full(len(hashes), doc, np.int64))
                        sizes.append(np.full(len(hashes), size, np.int32))
                        found.append(hashes.astype(np.int64))
            if owners:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in (owners, sizes, found)], ["id", "size", "shingle"])

    hits = id_and_text(docs, id_col, text_col).filter("id is not null").mapInArrow(run, "id long, size int, shingle long")
    held = (
        hits.join(of_items, ["size", "shingle"])
        .groupBy("id", "item", "copy").agg(F.countDistinct("shingle").alias("n_shared"), F.max("n").alias("n_item"), F.max("sketched").alias("met"))
        .filter(F.col("met") & (F.col("n_shared") >= F.ceil(F.col("n_item") * F.lit(share) - 1e-9)))
        .withColumn("containment", F.col("n_shared") / F.col("n_item"))
    )
    best = held.groupBy(F.col("id").alias("doc_id"), F.col("item").alias("item_id")).agg(F.max(F.struct("containment", "n_item", "n_shared")).alias("best"))
    return best.select("doc_id", "item_id", "best.n_item", "best.n_shared", "best.containment")


def without_benchmark(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, that hold no item; null ids and texts stay."""
    id_col = options.get("id_col", "doc_id")
    found = contaminated(docs, items, **options).select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(found, id_col, "left_anti")
