"""Operator 13, MinHash near-dedup: SuperMinHash signatures, bands, exact verification and union-find."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinelake.llm.common import ascii_words, drop_path, hash_words, id_and_text, materialize, shingle_hashes, slices
from cinelake.llm.components import components
from cinelake.llm.jaccard_join import block_pairs

WORDS, PERCENT = 3, 85
#: Bands and components of each. Two sets of similarity 0.85 miss all bands with a probability of (1 - 0.85**5)**28 = 7e-8, less of higher ones.
BANDS, ROWS = 28, 5
#: Of 140 components a pair must share so many before its sets are compared: one of similarity 0.85 shares fewer with a probability below 1e-8.
LEAST_SHARED = 90
#: Shingles whose permutations a task holds at a time.
ELEMENTS = 1 << 17
#: Bits of a rank's fraction; its whole part is the level.
FRACTION = 40


def _mixed(x: np.ndarray, level: int) -> np.ndarray:
    """Another 64 random bits of each shingle for each level."""
    x = x + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def superminhash(shingles: np.ndarray, owner: np.ndarray, docs: int, m: int = BANDS * ROWS) -> np.ndarray:
    """Signatures of several sets at once: shingles[i] is an element of set owner[i], owners ascending; an empty set has the largest value everywhere.

    Each element walks through a random permutation of the m components: at level j it offers
    j + r, with r in [0, 1), to the component that its permutation has at place j, and a component
    keeps the least offer. No two offers of an element go to the same component, which is why the
    components vary less than independent minima. From level j on all offers are j or more, so a set
    is done as soon as each of its components has less: large sets after a level or two. All sets of
    a batch take a level together; permutations are only kept for those that go on.
    """
    out = np.full((docs, m), np.iinfo(np.uint64).max, np.uint64)
    flat, places = out.ravel(), None
    for level in range(m):
        bits = _mixed(shingles, level)
        # an element's permutation by swaps: place `level` gets what one of the later places holds
        at = level + ((bits >> np.uint64(FRACTION)).astype(np.int64) * (m - level) >> (64 - FRACTION))
        if level == 0:
            to = at
        else:
            i = np.arange(len(shingles))
            to = places[i, at].astype(np.int64)
            places[i, at] = places[:, level]
        offer = np.uint64(level << FRACTION) | (bits & np.uint64((1 << FRACTION) - 1))
        np.minimum.at(flat, owner * m + to, offer)
        more = (out.max(1) >= np.uint64((level + 1) << FRACTION))[owner]
        if not more.any():
            break
        if level == 0:
            shingles, owner, at = shingles[more], owner[more], at[more]
            places = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(shingles), 1))
            places[np.arange(len(shingles)), at] = 0
        elif not more.all():
            shingles, owner, places = shingles[more], owner[more], places[more]
    return out


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted hashes of the distinct k-word shingles; of a text with fewer words the whole sequence's."""
    return np.unique(shingle_hashes(hash_words(ascii_words(text)), k))


def _grouped(sets: list[np.ndarray], most: int) -> list[tuple[int, int]]:
    """Ranges of sets of together about `most` elements; a larger set stands alone."""
    out, start, held = [], 0, 0
    for i, s in enumerate(sets):
        if held and held + len(s) > most:
            out.append((start, i))
            start, held = i, 0
        held += len(s)
    return [*out, (start, len(sets))] if start < len(sets) else out


def signed(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, digest, bands, brief): size and digest of each text's set, a hash of each band, and a byte of each component."""

    def run(batches):
        for batch in slices(batches):
            sets = [shingle_set(text, k) for text in batch.column("text").to_pylist()]
            parts = []
            for a, b in _grouped(sets, ELEMENTS):
                owner = np.repeat(np.arange(b - a), [len(s) for s in sets[a:b]])
                parts.append(superminhash(np.concatenate(sets[a:b]), owner, b - a))
            whole = np.concatenate(parts)
            banded = whole.reshape(len(sets), BANDS, ROWS)
            key = np.arange(BANDS, dtype=np.uint64)[None, :] + np.zeros((len(sets), 1), np.uint64)
            for r in range(ROWS):
                key = _mixed(key ^ banded[:, :, r], r)
            brief = whole.astype(np.uint8)  # the lowest bits of the fraction
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array(list(key.astype(np.int64)), pa.list_(pa.int64())), pa.array([b.tobytes() for b in brief], pa.binary()),
                ], ["id", "n", "digest", "bands", "brief"],
            )

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "id long, n long, digest binary, bands array<long>, brief binary")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    shared = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


class UnionFind:
    """Disjoint sets of positions, as an array of roots; the smaller set takes the larger one's root."""

    def __init__(self, n: int):
        self.root, self.size = np.arange(n), np.ones(n, np.int64)

    def join(self, a: int, b: int) -> None:
        a, b = sorted((int(self.root[a]), int(self.root[b])), key=lambda r: -self.size[r])
        self.root[self.root == b] = a
        self.size[a] += self.size[b]


#: Candidates up to which sets are compared one by one; for more, a member's shingles are counted in all of them at once.
ONE_BY_ONE = 12


class Postings:
    """The members of a group that have each shingle."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)
        _, term = np.unique(np.concatenate(sets), return_inverse=True)
        self.members = owner[np.argsort(term, kind="stable")]
        self.bounds = np.concatenate(([0], np.cumsum(np.bincount(term))))
        self.terms = np.split(term, np.cumsum(self.sizes)[:-1])

    def shared(self, x: int) -> np.ndarray:
        """How many shingles each member shares with x."""
        t = self.terms[x]
        return np.bincount(np.concatenate([self.members[a:b] for a, b in zip(self.bounds[t], self.bounds[t + 1])]), minlength=len(self.sizes))


def verified_links(ids: list[int], sets: list[np.ndarray], brief: np.ndarray, sides: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Links between members of a candidate group, enough of them for its components.

    Each member is compared with the smaller ones that share enough components of the signature and
    aren't connected with it yet, one of the largest set first; only whole sets decide. With sides,
    only members of different sides meet.
    """
    sizes = np.array([len(s) for s in sets])
    order = np.lexsort((ids, sizes))
    groups, out, postings = UnionFind(len(ids)), [], None
    ordered = sizes[order]

    def join(x: int, y: int) -> None:
        out.append((ids[x], ids[y]))
        groups.join(x, y)

    for x in range(1, len(order)):
        me = int(order[x])
        earlier = order[np.searchsorted(ordered, -(-percent * int(ordered[x]) // 100)) : x]
        earlier = earlier[groups.root[earlier] != groups.root[me]]
        if sides is not None:
            earlier = earlier[sides[earlier] != sides[me]]
        earlier = earlier[(brief[earlier] == brief[me]).sum(1) >= LEAST_SHARED]
        if not len(earlier):
            continue
        likely = int(earlier[groups.size[groups.root[earlier]].argmax()])
        if linked(sets[likely], sets[me], percent):
            join(me, likely)
        earlier = earlier[(groups.root[earlier] != groups.root[me]) & (earlier != likely)]
        if len(earlier) > ONE_BY_ONE:
            postings = postings or Postings(sets)
            both = postings.shared(me)[earlier]
            earlier = earlier[100 * both >= percent * (sizes[me] + sizes[earlier] - both)]
        for y in earlier.tolist():
            if groups.root[y] != groups.root[me] and linked(sets[y], sets[me], percent):
                join(me, y)
    return out


def _links(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """Rows (cluster, i, j, id, block, brief, text), those of a (cluster, i, j) one after the other, to the links found in each."""

    def run(batches):
        key, ids, sets, briefs, sides = None, [], [], [], []

        def flush():
            found = verified_links(ids, sets, np.frombuffer(b"".join(briefs), np.uint8).reshape(len(ids), -1), np.array(sides) if key[1] != key[2] else None, percent) if len(ids) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

        for batch in slices(batches):
            for cluster, i, j, id_, block, brief, text in zip(*(batch.column(c).to_pylist() for c in ("cluster", "i", "j", "id", "block", "brief", "text"))):
                if (cluster, i, j) != key:
                    if key is not None:
                        yield from flush()
                    key, ids, sets, briefs, sides = (cluster, i, j), [], [], [], []
                ids.append(id_)
                sets.append(shingle_set(text, k))
                briefs.append(brief)
                sides.append(block)
        if key is not None:
            yield from flush()

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row: the set's size, the smallest id that links reach, and whether that is the row's own.

    Two texts link when 100 * intersection >= percent * union of their sets of k-word shingles. Null
    and empty texts have an empty set and stand alone, so do null ids (component_id and kept are
    null). Equal sets are one class from the start; rows of one id are one document, with the links
    of all its texts. Every input row gives one row; only id and text are read; an empty table gives none.

    A class is signed once. Classes that agree in a band are chained to the band's smallest id (a
    minimum, combined before the shuffle); chains form candidate groups, large ones are dealt into
    pairs of blocks of like size, and whole sets are compared there. Verified links make the components.
    """
    spark = docs.sparkSession
    table, _ = materialize(signed(docs, k, id_col, text_col), "signed")
    classes, _ = materialize(table.filter("n > 0 and id is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("brief").alias("brief"), F.first("bands").alias("bands")), "classes")
    banded = classes.select("rep", F.explode("bands").alias("band"))
    least = banded.groupBy("band").agg(F.min("rep").alias("least"), F.count("*").alias("n")).filter("n > 1").select("band", "least")
    grouped = components(banded.join(least, "band").filter("rep != least").select(F.col("rep").alias("a"), F.col("least").alias("b")))
    members, members_path = materialize(grouped.join(classes, grouped.node == classes.rep).select("node", "component", "n", "brief"), "members")
    paired = block_pairs(members.drop("brief"), percent).join(members.select(F.col("node").alias("id"), "brief"), "id")
    texts = id_and_text(docs, id_col, text_col).join(table.filter("n > 0").select("id", "digest").distinct().join(classes.select("digest", F.col("rep").alias("id")), ["digest", "id"]).select("id"), "id", "left_semi")
    links = _links(texts.join(paired, "id").repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "id"), k, percent)
    # an id with several texts is one document: it connects their classes
    several = table.filter("n > 0 and id is not null").groupBy("id").agg(F.min("digest").alias("one"), F.max("digest").alias("other")).filter("one != other").select("id")
    own = table.select("id", "digest").join(several, "id").join(classes.select("digest", "rep"), "digest").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    linked_classes = components(links.unionByName(own))
    final, _ = materialize(classes.join(linked_classes, classes.rep == linked_classes.node, "left").select("digest", F.coalesce("component", "rep").alias("component")), "final")
    drop_path(spark, members_path)
    component = F.when(F.col("id").isNull(), None).otherwise(F.coalesce("component", "id"))
    return table.select("id", "n", "digest").join(final, "digest", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
