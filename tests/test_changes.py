"""Schedule changes as snapshots land against the batch form, and tallies that a task's retry doesn't change."""

import itertools
import os
import random
import subprocess
import sys
import textwrap

import pytest

from cinelake.operators import changes
from cinelake.streaming import feeds

SCHEMA = "title string, url string, release_date string, scale string, snapshot_order int"


def snapshots(seed, n=4):
    """Snapshots of a schedule: dates that move, scales that change, films with an address, without one, or with two."""
    rng, out = random.Random(seed), []
    for order in range(n):
        for film in range(14):
            if rng.random() < 0.8:
                url = f"https://x.example.com/release/rl{film}/" if film % 3 and rng.random() < 0.8 else ""
                day = "" if rng.random() < 0.05 else f"2026-0{rng.randint(1, 3)}-0{rng.randint(1, 2)}"
                out.append((f"Film {film}" + ("!" if rng.random() < 0.2 else ""), url, day, rng.choice(["Wide", "Limited", "wide release"]), order))
    return out


@pytest.mark.parametrize("seed, cuts", [(1, [1, 2, 3]), (1, [3]), (2, [2]), (3, [])])
def test_any_split_of_the_snapshots_gives_the_batch_rows(spark, tmp_path, seed, cuts):
    rows = snapshots(seed)
    bounds = [0, *cuts, 4]
    for i, (a, b) in enumerate(itertools.pairwise(bounds)):
        spark.createDataFrame([r for r in rows if a <= r[4] < b], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{i}"))
    files = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    feeds.write_changes(feeds.listed_histories(files), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    names = ["title", "old_date", "new_date", "old_scale", "new_scale", "change_type"]
    for order in (1, 2, 3):
        df = spark.createDataFrame(rows, SCHEMA)
        wanted = changes.release_changes(df.filter(f"snapshot_order = {order}"), df.filter(f"snapshot_order < {order}"))
        assert sorted(map(tuple, found.filter(f"snapshot_order = {order}").select(names).collect())) == sorted(map(tuple, wanted.select(names).collect()))


def test_three_entries_tell_a_history():
    rng = random.Random(9)
    for _ in range(300):
        entries = [(rng.randint(0, 5), rng.choice("abc"), rng.choice(["Wide", "Limited"])) for _ in range(rng.randint(1, 8))]
        state = [None, None, None]
        for e in entries:
            state = feeds._followed(state, e)
        assert state[2] == min((e for e in entries if e[2] == "Limited"), default=None)
        for now in "abcd":
            assert next((e for e in state[:2] if e and e[1] != now), None) == min((e for e in entries if e[1] != now), default=None)


def test_tallies_don_t_count_a_failed_attempt(tmp_path):
    script = textwrap.dedent("""
        import sys
        from pyspark import TaskContext
        from pyspark.sql import SparkSession, functions as F
        from cinelake.operators.tallies import status_tallies, write_tallied
        spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        spark.sparkContext.setLogLevel("OFF")

        def fails_once(batches):
            for batch in batches:
                yield batch
            if TaskContext.get().partitionId() == 1 and TaskContext.get().attemptNumber() == 0:
                raise RuntimeError("lost")

        rows = spark.range(0, 1000, 1, 3).select("id", F.when(F.col("id") % 4 == 0, "Matched").otherwise("Manual review").alias("note"))
        rows = rows.mapInArrow(fails_once, "id long, note string")
        tallies = write_tallied(rows, sys.argv[1], **status_tallies("note", ["Matched", "Manual review"]))
        print("TALLIES", tallies, spark.read.parquet(sys.argv[1]).count())
    """)
    env = os.environ | {"PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    done = subprocess.run([sys.executable, "-c", script, str(tmp_path / "rows")], env=env, capture_output=True, text=True, timeout=240)
    assert "TALLIES {'rows': 1000, 'matched': 250, 'manual_review': 750} 1000" in done.stdout, done.stderr[-2000:]
