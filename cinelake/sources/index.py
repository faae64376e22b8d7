"""The catalogue's index: versions in folders of their own, a manifest written last, tables bucketed by what lookups join on."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.operators.resolve import with_keys
from cinelake.sources import tsv

#: Bump when the tables' columns change: versions of another number are not current.
INDEX_VERSION = 2
BUCKETS = 64
#: Tables by name: the column that they are bucketed and sorted by.
KEYS = {"titles": "key", "names": "normalized_name", "episodes": "parent"}


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path's object."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


@dataclass(frozen=True)
class Index:
    """One version, as its manifest tells it. It stays the same for its reader, whatever is built meanwhile."""

    path: str
    version: int
    buckets: int
    schemas: dict[str, str]
    rows: dict[str, int]

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        """A table with its buckets, so that a join on its key moves the other side only."""
        view = f"index_{self.path.rstrip('/').rsplit('-', 1)[-1]}_{name}"
        key = KEYS[name]
        spark.sql(f"create table if not exists {view} ({self.schemas[name]}) using parquet clustered by ({key}) sorted by ({key}) into {self.buckets} buckets location '{self.path}/{name}'")
        return spark.table(view)


def _write(df: DataFrame, path: str, name: str, buckets: int) -> tuple[str, int]:
    """A bucketed table at a path, one file a bucket, with Parquet's Bloom filters on its key for keys that aren't there; its columns and number of rows."""
    spark, key, table = df.sparkSession, KEYS[name], f"build_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, key)
    dealt.write.bucketBy(buckets, key).sortBy(key).option("path", f"{path}/{name}").option(f"parquet.bloom.filter.enabled#{key}", "true").format("parquet").saveAsTable(table)
    rows = spark.table(table).count()
    spark.sql(f"drop table {table}")  # of an external table the files stay
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), rows


def build(spark: SparkSession, root: str, title_path: str, name_path: str, episode_path: str, buckets: int = BUCKETS) -> Index:
    """Builds a new version under `root` from three dumps and makes it the current one.

    Titles have a row for each of their two keys. The version's manifest is written last, under a
    name that no other has, and by a rename: a build that dies before leaves a folder that nothing
    reads, and the version before stays current. Of two builds at once the later manifest counts.
    """
    path = f"{root.rstrip('/')}/version-{uuid.uuid4().hex}"
    found = tsv.titles(spark, title_path)
    schemas, rows = {}, {}
    keyed = with_keys(found, "normalized_primary", "normalized_original")
    schemas["titles"], rows["titles"] = _write(keyed, path, "titles", buckets)
    schemas["names"], rows["names"] = _write(tsv.names(spark, name_path), path, "names", buckets)
    made = Index(path, INDEX_VERSION, buckets, schemas, rows)
    series = made.table(spark, "titles").filter(F.col("title_type").isin(tsv.SERIES_TYPES)).select("tconst").distinct()
    schemas["episodes"], rows["episodes"] = _write(tsv.episodes(spark, episode_path, series), path, "episodes", buckets)
    publish(spark, root, made)
    return made


def publish(spark: SparkSession, root: str, made: Index) -> None:
    """Writes the manifest of a version aside and renames it to the next number."""
    fs, folder = _files(spark, f"{root.rstrip('/')}/manifests")
    fs.mkdirs(folder)
    path = lambda name: spark._jvm.org.apache.hadoop.fs.Path(folder, name)
    aside = path(f"_{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(json.dumps({"path": made.path, "version": made.version, "buckets": made.buckets, "schemas": made.schemas, "rows": made.rows}).encode())
    out.close()
    number = max(_numbers(spark, root), default=0) + 1
    while not fs.rename(aside, path(f"{number:09d}.json")):  # another build took the number
        number += 1


def _numbers(spark: SparkSession, root: str) -> list[int]:
    fs, folder = _files(spark, f"{root.rstrip('/')}/manifests")
    if not fs.exists(folder):
        return []
    return [int(n[:-5]) for s in fs.listStatus(folder) if (n := s.getPath().getName()).endswith(".json") and n[:-5].isdigit()]


def current(spark: SparkSession, root: str) -> Index | None:
    """The newest version that has this library's columns; None if there is none."""
    for number in sorted(_numbers(spark, root), reverse=True):
        text = spark.read.text(f"{root.rstrip('/')}/manifests/{number:09d}.json", wholetext=True).first()[0]
        found = Index(**json.loads(text))
        if found.version == INDEX_VERSION:
            return found
    return None
