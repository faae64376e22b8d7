"""Operator 6, n-gram Jaccard join: T-occurrence search with DivideSkip over groups of documents that share rare shingles."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Callable
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinelake.llm.common import ascii_words, drop_path, hash_words, id_and_text, materialize, shingle_hashes, slices, summed_array
from cinelake.llm.components import components

WORDS = 4
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Counters of the words' frequencies, which only order the shingles: any order gives the same links. Tasks get them as steps of a logarithm, a byte each.
COUNTERS, STEPS = 1 << 22, 6
#: Documents and shingles of a block; a larger candidate group is dealt into blocks, and pairs of blocks into tasks.
BLOCK_DOCS, BLOCK_SHINGLES = 2_000, 1_500_000
#: The same of a block of sketches, which have a few bits a shingle at most.
SKETCH_DOCS, SKETCH_SHINGLES = 8_000, 48_000_000
#: Bits of the map of ids that tells which texts may be wanted.
ID_BITS = 24
#: Weighs probing long lists against merging them, as DivideSkip's mu.
MU = 0.01
#: Postings up to which a heap merges them element by element; beyond, sorted runs are merged as arrays.
HEAPED = 256


def _counters(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(COUNTERS - 1)).astype(np.int64)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """How often words occur in all texts, in a fixed number of hashed counters, as logarithms in whole steps."""

    def fill(batches):
        counts = np.zeros(COUNTERS, np.uint32)
        for batch in slices(batches):
            found = [_counters(hash_words(ascii_words(text))) for text in batch.column("text").to_pylist()]
            if found:
                at, times = np.unique(np.concatenate(found), return_counts=True)
                counts[at] += times.astype(np.uint32)
        return counts

    counts = summed_array(id_and_text(docs, id_col, text_col), fill, COUNTERS, 1 << 14, sent="<u4")
    return np.minimum(np.log2(counts + 1.0) * STEPS, 255).astype(np.uint8)


def shingle_set(text: str | None, k: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct k-word shingles."""
    return np.unique(shingle_hashes(hash_words(ascii_words(text)), k))


def _rare_first(text: str | None, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles, sorted, and the same from rare to frequent: by the count of the rarest word, then by hash."""
    hashes = hash_words(ascii_words(text))
    found = shingle_hashes(hashes, k)
    if not len(found):
        return found, found
    often = counts[_counters(hashes)]
    rarest = np.minimum.reduce([often[i : len(often) - min(k, len(often)) + 1 + i] for i in range(min(k, len(often)))])
    distinct, first = np.unique(found, return_index=True)
    return distinct, distinct[np.argsort(rarest[first], kind="stable")]


def sketch(distinct: np.ndarray) -> bytes:
    """Of each of 128 * 2^i slots whether an odd number of shingles falls into it. Sets differ in no fewer shingles than sketches in bits.

    There are two slots and more for a shingle up to 512 shingles, one for two from 2,048 on, so that chance rules out unlike sets.
    """
    slots, n = 128, len(distinct)
    while slots < min(2 * n, max(1_024, n // 2)):
        slots *= 2
    odd = np.bincount((distinct & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_overlap(n: int, percent: int) -> int:
    """Shingles that the larger set of a link, of n, must share."""
    return -(-percent * n // 100)


def signatures(docs: DataFrame, counts: np.ndarray, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, digest, sketch, prefix): the set's size, digest and sketch, and those of its rarest shingles of which any linked set has one."""

    def run(batches):
        for batch in slices(batches):
            sizes, digests, sketches, prefixes = [], [], [], []
            for text in batch.column("text").to_pylist():
                distinct, ordered = _rare_first(text, counts, k)
                n = len(distinct)
                sizes.append(n)
                digests.append(xxhash.xxh128_digest(distinct.tobytes()) if n else None)
                sketches.append(sketch(distinct) if n else None)
                prefixes.append(ordered[: n - least_overlap(n, percent) + 1].astype(np.int64) if n else ordered.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))], ["id", "n", "digest", "sketch", "prefix"]
            )

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "id long, n long, digest binary, sketch binary, prefix array<long>")


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    shared = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def divide_skip(ids: list[int], sets: list[np.ndarray], sides: list[int] | None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that join the documents of a group, enough of them for its components.

    Documents come by size. For each one the postings of its shingles among the smaller ones are
    split: the longest lists are set aside, the short ones are merged, and only documents that the
    short lists hold often enough are probed in the long ones by binary search. Before that, a
    document is compared with one of the largest component among those it may link with: in a group
    of copies that connects it, and documents that are connected needn't be found. With sides, only
    documents of different sides are compared.
    """
    order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
    ids, sets = [ids[i] for i in order], [sets[i] for i in order]
    side = np.array([sides[i] for i in order]) if sides is not None else None
    sizes = [len(s) for s in sets]
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
    _, term = np.unique(np.concatenate(sets), return_inverse=True)
    by_term = np.argsort(term, kind="stable")
    postings, bounds = owner[by_term], np.concatenate(([0], np.cumsum(np.bincount(term))))
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    root = np.arange(len(sets))
    out = []
    # where each posting stands in its list: what comes before it are the smaller documents
    place = np.empty(len(by_term), np.int64)
    place[by_term] = np.arange(len(by_term))
    for x in range(1, len(sets)):
        n = sizes[x]
        need = least_overlap(n, percent)
        smallest = bisect_left(sizes, -(-percent * n // 100), 0, x)
        if smallest == x:
            continue
        may = np.arange(smallest, x) if side is None else smallest + np.flatnonzero(side[smallest:x] != side[x])
        if not len(may):
            continue
        of = root[may]
        y = int(may[np.flatnonzero(of == np.bincount(of).argmax())[-1]])
        if root[y] != root[x] and _linked(sets[x], sets[y], percent):
            out.append((ids[x], ids[y]))
            root[root == root[x]] = root[y]
        if (root[may] == root[x]).all():
            continue
        terms = term[offsets[x] : offsets[x + 1]]
        starts, ends = bounds[terms], place[offsets[x] : offsets[x + 1]]
        lengths = ends - starts
        some = np.flatnonzero(lengths)
        if len(some) < need:
            continue
        some = some[np.argsort(lengths[some], kind="stable")]
        longest = int(lengths[some[-1]])
        aside = min(need - 1, int(need / (MU * math.log2(longest) + 1))) if longest else 0
        short, long = some[: len(some) - aside], some[len(some) - aside :]
        lists = [postings[starts[i] : ends[i]] for i in short]
        if sum(map(len, lists)) <= HEAPED:
            merged = [(y, sum(1 for _ in same)) for y, same in groupby(heapq.merge(*(p.tolist() for p in lists)))]
            found, hits = (np.array(v, np.int64) for v in zip(*merged)) if merged else (np.empty(0, np.int64),) * 2
        else:
            posted = np.concatenate(lists)
            found, hits = np.unique(posted[(posted >= smallest) & (root[posted] != root[x])], return_counts=True)
        keep = (hits >= need - aside) & (found >= smallest) & (root[found] != root[x])
        if side is not None:
            keep &= side[found] != side[x]
        found, hits = found[keep], hits[keep]
        rest = np.sort(sets[x][long])
        todo = list(np.argsort(-hits, kind="stable"))
        for i in todo:
            y = int(found[i])
            if root[y] == root[x]:
                continue
            shared = int(hits[i])
            if len(rest):
                at = np.searchsorted(sets[y], rest)
                shared += int((sets[y][np.minimum(at, sizes[y] - 1)] == rest).sum())
            if 100 * shared >= percent * (n + sizes[y] - shared):
                out.append((ids[x], ids[y]))
                root[root == root[x]] = root[y]
    return out


def alike(ids: list[int], sketched: list[tuple[int, bytes]], sides: list[int] | None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Pairs of a group's documents, (size, sketch) each, that connect all whose sketches don't rule out a link. With sides, only documents of different sides are compared."""
    order = sorted(range(len(ids)), key=lambda i: (sketched[i][0], ids[i]))
    ids, sizes = [ids[i] for i in order], np.array([sketched[i][0] for i in order])
    bits = [np.frombuffer(sketched[i][1], np.uint64) for i in order]
    side = [sides[i] for i in order] if sides is not None else [0] * len(ids)
    # documents of a side and a width: their places, and their sketches as columns
    places: dict[tuple[int, int], list[int]] = {}
    for x, own in enumerate(bits):
        places.setdefault((side[x], len(own)), []).append(x)
    listed = {key: (np.array(at), np.ascontiguousarray(np.vstack([bits[x] for x in at]).T)) for key, at in places.items()}
    root = np.arange(len(ids))
    out = []
    for x in range(1, len(ids)):
        n = sizes[x]
        smallest = int(np.searchsorted(sizes[:x], -(-percent * n // 100)))
        if smallest == x:
            continue
        met, mine = [], bits[x]
        # of a smaller set the sketch may be narrower: the own one is folded to its width
        while len(mine) >= len(bits[smallest]):
            for (of, width), (at, columns) in listed.items():
                if width != len(mine) or (sides is not None and of == side[x]):
                    continue
                start, end = np.searchsorted(at, (smallest, x))
                if start == end:
                    continue
                most = (100 - percent) * (n + sizes[at[start:end]]) // (100 + percent)
                # the first words rule out nearly all
                some = -(-3 * width // 8)
                differ = np.bitwise_count(columns[:some, start:end] ^ mine[:some, None]).sum(axis=0, dtype=np.int32)
                left = np.flatnonzero(differ <= most)
                if len(left):
                    rest = np.bitwise_count(columns[some:, start + left] ^ mine[some:, None]).sum(axis=0, dtype=np.int32)
                    met.append(at[start + left[differ[left] + rest <= most[left]]])
            mine = mine[: len(mine) // 2] ^ mine[len(mine) // 2 :] if len(mine) > 1 else mine[:0]
        if met:
            found = np.concatenate(met)
            roots, first = np.unique(root[found], return_index=True)
            out += [(ids[x], ids[y]) for y in found[first].tolist()]
            root[np.isin(root, roots)] = x
    return out


def _found(groups: DataFrame, columns: list[str], make: Callable, find: Callable) -> DataFrame:
    """Rows (cluster, i, j, id, block, columns), a group's rows one after the other, to the links that `find` sees between what `make` makes of the columns."""

    def run(batches):
        key, ids, made, sides = None, [], [], []

        def flush():
            found = find(ids, made, sides if key[1] != key[2] else None) if len(ids) > 1 else []
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in slices(batches, columns[-1]):
            rows = [batch.column(c).to_pylist() for c in ("cluster", "i", "j", "id", "block", *columns)]
            for cluster, i, j, id_, block, *values in zip(*rows):
                if (cluster, i, j) != key:
                    if key is not None:
                        yield from flush()
                    key, ids, made, sides = (cluster, i, j), [], [], []
                ids.append(id_)
                made.append(make(*values))
                sides.append(block)
        if key is not None:
            yield from flush()

    return groups.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "id").mapInArrow(run, "a long, b long")


def wanted_texts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of texts whose id is one of wanted, and a few others: looked up in a map of bits, which is as large for any number of ids, so that few texts are shuffled for a join."""
    slot = F.pmod(F.xxhash64("id"), F.lit(1 << ID_BITS))
    at = {"slots": F.shiftright(slot, 6), "bit": F.pmod(slot, F.lit(64)).cast("int")}
    bits = wanted.withColumns(at).groupBy("slots").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    return texts.withColumns(at).join(F.broadcast(bits), "slots").filter("bit_get(bits, bit) = 1").select(texts.columns)


def block_pairs(members: DataFrame, percent: int, most_docs: int | None = None, most_shingles: int | None = None) -> DataFrame:
    """(id, cluster, block, i, j): the pairs of blocks in which each member (node, component, n) of a candidate group is compared.

    A group of up to a block is compared as a whole. A larger one is cut into size classes such that
    linked sets lie in the same or in neighbouring ones, classes are dealt into blocks by hash, and
    only blocks of the same or neighbouring classes meet. A block's number holds its class.
    """
    wide = math.log(max(100 / percent, 1 + 1e-6)) * (1 + 1e-9)
    blocks = lambda: F.greatest(F.ceil(F.count("*") / (most_docs or BLOCK_DOCS)), F.ceil(F.sum("n") / (most_shingles or BLOCK_SHINGLES))).cast("int")
    rows = members.withColumn("class", F.floor(F.log("n") / wide))
    large = rows.join(rows.groupBy("component").agg(blocks().alias("blocks")), "component")
    whole = large.filter("blocks = 1").select(F.col("node").alias("id"), F.col("component").alias("cluster"), *(F.lit(0).cast("long").alias(c) for c in ("block", "i", "j")))
    cut = large.filter("blocks > 1").drop("blocks")
    classes = cut.groupBy("component", "class").agg(blocks().alias("blocks"))
    met = classes.select("component", "class", "blocks", F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)).alias("other")).join(
        classes.select("component", F.col("class").alias("other"), F.col("blocks").alias("others")), ["component", "other"]
    )
    number = lambda c, b: F.shiftleft(c.cast("long"), 24) + b
    dealt = cut.join(met, ["component", "class"]).select("node", "component", number(F.col("class"), F.pmod(F.xxhash64("node"), "blocks")).alias("block"), "other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("b"))
    other = number(F.col("other"), F.col("b"))
    return whole.unionByName(dealt.select(F.col("node").alias("id"), F.col("component").alias("cluster"), "block", F.least("block", other).alias("i"), F.greatest("block", other).alias("j")))


def jaccard_components(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row: the distinct k-word shingles and the smallest id reachable by links.

    Two texts link when 100 * intersection >= percent * union of their sets. Null and empty texts
    have an empty set and stand alone, null ids too (component_id is the id). Rows with equal sets
    are one class from the start. Every input row gives one row; only id and text are read.

    Any two linked sets share one of their rarest shingles (a prefix of each set in one order of all
    shingles), so documents that share none of those never meet. The documents of a shared shingle
    are chained by size, and chains form groups, which in a large corpus hold many unlike documents:
    common passages chain nearly all long ones. Sketches, a hundredth of the text, are compared within
    a group, large ones in pairs of blocks of like size, and what they can't tell apart is a candidate
    group. Only the texts of those are moved, and each is searched by DivideSkip on whole sets, again
    in pairs of blocks. Links, not guesses, make the components.
    """
    spark = docs.sparkSession
    counts = word_counts(docs, id_col, text_col)
    signed, signed_path = materialize(signatures(docs, counts, k, percent, id_col, text_col), "signatures")
    sized, _ = materialize(signed.select("id", "n", "digest"), "sizes")
    classes, _ = materialize(sized.filter("n > 0 and id is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.first("n").alias("n")), "classes")
    chosen = signed.select("id", "digest", "sketch", "prefix").join(classes.withColumnRenamed("rep", "id"), ["digest", "id"]).dropDuplicates(["digest", "id"])
    listed = chosen.select("id", "n", F.explode("prefix").alias("shingle"))
    before = Window.partitionBy("shingle").orderBy("n", "id")
    chained = listed.select("id", "n", F.lag("id").over(before).alias("b"), F.lag("n").over(before).alias("m")).filter(f"b is not null and 100 * m >= {percent} * n")
    chains = components(chained.select(F.col("id").alias("a"), "b"))
    sketched, sketched_path = materialize(chains.join(chosen.select(F.col("id").alias("node"), "n", "sketch"), "node").select("node", "component", "n", "sketch"), "sketched")
    drop_path(spark, signed_path)
    compared = block_pairs(sketched.drop("sketch"), percent, SKETCH_DOCS, SKETCH_SHINGLES).join(sketched.select(F.col("node").alias("id"), "n", "sketch"), "id")
    grouped = components(_found(compared, ["n", "sketch"], lambda n, bits: (n, bits), lambda ids, made, sides: alike(ids, made, sides, percent)))
    members, _ = materialize(grouped.join(classes, grouped.node == classes.rep).select("node", "component", "n"), "members")
    drop_path(spark, sketched_path)
    texts = wanted_texts(id_and_text(docs, id_col, text_col), members.select(F.col("node").alias("id"))).join(block_pairs(members, percent), "id")
    linked = components(_found(texts, ["text"], lambda text: shingle_set(text, k), lambda ids, sets, sides: divide_skip(ids, sets, sides, percent)))
    final, _ = materialize(classes.join(linked, classes.rep == linked.node, "left").select("digest", F.coalesce("component", "rep").alias("component")), "final")
    return sized.join(final, "digest", "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNull(), None).otherwise(F.coalesce("component", "id")).alias("component_id")
    )
