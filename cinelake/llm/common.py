"""What the operators share: scratch tables, batches balanced by bytes, word hashes and summed sketches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task turns into Python objects at a time.
SLICE_BYTES = 2 << 20
#: Entries at which a worker's memo of words is emptied, or its older generation is.
MEMO_ENTRIES = 120_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset in local mode (tests) a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="cinelake-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir() or found
    return found.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/cinelake/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Writes df to the shared folder and rereads it, which cuts its lineage; a lost executor costs nothing of it."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table that nothing reads any more."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, under fixed names; other columns, clashing names included, are pruned."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut again so that each holds about `budget` bytes of `column`; a longer row stands alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > budget:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        if start < batch.num_rows:
            yield batch.slice(start)


class Memo:
    """Values that `learn` makes of keys, kept in two generations: keys that come again outlive those that don't."""

    def __init__(self, learn: Callable[[list], Iterable[tuple]], entries: int = MEMO_ENTRIES):
        self.learn, self.entries = learn, entries
        self.recent: dict = {}
        self.older: dict = {}

    def of(self, wanted: set) -> dict:
        """A dictionary that holds all wanted keys, good until the next call."""
        if len(self.recent) > self.entries:
            self.older, self.recent = self.recent, {}
        new = wanted - self.recent.keys()
        again = new & self.older.keys()
        self.recent.update((k, self.older[k]) for k in again)
        if new := new - again:
            self.recent.update(self.learn(list(new)))
        return self.recent


class WordHashes(dict):
    """Word (bytes) to its 64-bit hash, computed once per word and worker while the memo holds it."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = WordHashes()


def ascii_words(text: str | None) -> list[bytes]:
    """Lower-cases A-Z and splits at runs of space and \\x09-\\x0D, which is what bytes do by themselves."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each window of k word hashes; with fewer words one for the whole sequence; none without words."""
    n = len(hashes)
    if not n:
        return hashes
    width, seed = min(n, k), np.uint64(min(n, k))
    out = np.full(n - width + 1, seed, np.uint64)
    for i in range(width):
        out ^= hashes[i : n - width + 1 + i]
        out *= np.uint64(_ODD[i % len(_ODD)])
        out ^= out >> np.uint64(29)
    return out


def summed_array(df: DataFrame, fill: Callable[[Iterator[pa.RecordBatch]], np.ndarray], width: int, chunk: int = 4096, merge: np.ufunc = np.add, sent: str = "<i8") -> np.ndarray:
    """The sum (or another merge) over all tasks of the integer array of fixed `width` that `fill` makes of a task's batches.

    Tasks send chunks, equal chunks meet in one task that merges them as they come; the driver
    gets `width` numbers whatever the size of the input. `sent` is the type in which a task's own numbers travel.
    """

    def send(batches):
        total = fill(batches)
        for i in range(0, width, chunk):
            if (piece := total[i : i + chunk]).any():
                yield pa.RecordBatch.from_pydict({"part": pa.array([i // chunk], pa.int32()), "data": pa.array([piece.astype(sent).tobytes()], pa.binary())})

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                piece = np.frombuffer(data.as_buffer(), sent).astype(np.int64)
                sums[part] = merge(sums[part], piece) if part in sums else piece
        for part, piece in sums.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "data": pa.array([piece.tobytes()], pa.binary())})

    schema, out = "part int, data binary", np.zeros(width, np.int64)
    for row in df.mapInArrow(send, schema).repartition("part").mapInArrow(add, schema).collect():
        out[row.part * chunk : row.part * chunk + chunk] = np.frombuffer(row.data, "<i8")
    return out


_SEPARATORS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def plain_words(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case; ASCII punctuation separates like white space."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_SEPARATORS).split() if text else []


#: From this size on, whole components leave no room for sums of products in a long; rows with such a component take no part.
WHOLE_LIMIT = 1 << 24


def whole_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int, *others: Column) -> DataFrame:
    """(id, v, others): vectors as floor(scale * x), without those that are null, empty or hold null, non-finite or too large components."""
    v = F.col(vec_col).cast("array<double>")
    fits = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < WHOLE_LIMIT / scale))
    real = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("x"), *others).filter(F.col("x").isNotNull() & (F.size("x") > 0) & fits)
    # Spark may look at v before it drops a row: what doesn't fit is null then, not an error
    return real.withColumn("v", F.transform("x", lambda x: F.floor(x * F.lit(float(scale))).try_cast("int"))).drop("x")


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """A column of lists of one length as the rows of a matrix, without Python objects."""
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(len(column), width)


def lists(rows: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as a column of lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def exact_kind(largest: int) -> type:
    """The numpy type whose sums of whole numbers up to `largest` are exact: doubles, for which there is fast multiplication, where they are."""
    return np.float64 if largest < 1 << 53 else np.int64
