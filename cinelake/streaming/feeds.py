"""Streams of landed rows: keep-first with a watermark, windowed tallies, sessions, schedule changes as snapshots land. Additions: the batch operators' semantics over readStream."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructType

from cinelake.functions.text import box_office_key, release_identity, squash
from cinelake.operators.changes import change_rows


def landed(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_seen(stream: DataFrame, keys: list[str], event_time: str, delay: str = "1 hour") -> DataFrame:
    """The first row of each key; state of keys older than the delay is dropped."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_tally(stream: DataFrame, by: list[str], event_time: str, size: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Counts of each window and key; rows later than the delay don't count."""
    counted = stream.withWatermark(event_time, delay).groupBy(F.window(event_time, size), *by).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), *by, "n")


def sessions(stream: DataFrame, by: str, event_time: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Runs of a key's events without a pause longer than the gap."""
    found = stream.withWatermark(event_time, delay).groupBy(F.session_window(event_time, gap), by).agg(F.count("*").alias("n"))
    return found.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "n")


def append_to(stream: DataFrame, path: str, checkpoint: str):
    """Writes finished rows to Parquet; the checkpoint makes restarts exactly-once."""
    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).format("parquet").option("path", path).trigger(availableNow=True).start()


_ENTRIES = [f"{name}_{part}" for name in ("first", "other", "limited") for part in ("o", "date", "scale")]
_ENTRY_TYPES = ", ".join(f"{c} {'long' if c.endswith('_o') else 'string'}" for c in _ENTRIES)
_LISTED = ["title", "new_date", "new_scale", "identity", "title_id"]


def _followed(state: list[tuple | None], entry: tuple) -> list[tuple | None]:
    """The first entry of a history, the first of another date and the first Limited one, after one more entry."""
    first, other, limited = state
    if first is None or entry < first:
        # of the entry that was first only its date may still tell something
        first, other = entry, min((e for e in (first, other) if e is not None and e[1] != entry[1]), default=None)
    elif entry[1] != first[1] and (other is None or entry < other):
        other = entry
    if "limited" in entry[2].lower() and (limited is None or entry < limited):
        limited = entry
    return [first, other, limited]


def listed_histories(snapshots: DataFrame, order: str = "snapshot_order", keep: str | None = None) -> DataFrame:
    """Each row of landed snapshots (title, url, release_date, scale, order) under its two keys, with what the earlier ones say of that key.

    The state of a key is three entries, whatever its history; with `keep` (as `90 days`), keys that
    no row had for so long are forgotten. Rows of one snapshot don't count for each other. Snapshots
    may come in any number of batches, each in its order.
    """
    rows = snapshots.select(
        squash("title").alias("title"), squash("release_date").alias("new_date"), squash("scale").alias("new_scale"), release_identity("url", "title").alias("identity"), box_office_key("title").alias("title_id"), F.col(order).cast("long").alias("o"),
    ).filter("identity != '' and new_date != ''")
    keyed = rows.withColumn("k", F.explode(F.array_distinct(F.array(F.struct(F.lit(0).alias("place"), F.col("identity").alias("key")), F.struct(F.lit(1).alias("place"), F.col("title_id").alias("key")))))).select(*_LISTED, "o", "k.place", "k.key").filter("key != ''")
    wait = int(pd.Timedelta(keep).total_seconds() * 1000) if keep else None

    def follow(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get) if state.exists else [None] * len(_ENTRIES)
        now = [tuple(held[i : i + 3]) if held[i] is not None else None for i in (0, 3, 6)]
        listed = pd.concat(list(frames)).sort_values("o", kind="stable")
        for _, group in listed.groupby("o", sort=True):
            flat = [x for e in now for x in (e or (None, None, None))]
            out = group[[*_LISTED, "o", "place", "key"]].copy()
            for name, value in zip(_ENTRIES, flat):
                out[name] = pd.Series([value] * len(out), index=out.index, dtype="Int64" if name.endswith("_o") else object)
            yield out
            for o, date, scale in zip(group["o"], group["new_date"], group["new_scale"]):
                now = _followed(now, (int(o), date, scale))
        state.update(tuple(x for e in now for x in (e or (None, None, None))))
        if wait:
            state.setTimeoutDuration(wait)

    shape = f"title string, new_date string, new_scale string, identity string, title_id string, o long, place int, key string, {_ENTRY_TYPES}"
    return keyed.groupBy("key").applyInPandasWithState(follow, shape, _ENTRY_TYPES, "append", GroupStateTimeout.ProcessingTimeTimeout if keep else GroupStateTimeout.NoTimeout)


def changes_of(histories: DataFrame) -> DataFrame:
    """The changes that one batch of listed_histories tells, as release_changes has them, with the order of their snapshot: the identity's history counts, else the title's."""
    entry = lambda n: F.when(F.col(f"{n}_o").isNotNull(), F.struct(F.col(f"{n}_o").alias("o"), F.col(f"{n}_date").alias("date"), F.col(f"{n}_scale").alias("scale")))
    known = histories.withColumn("h", F.struct(*(entry(n).alias(n) for n in ("first", "other", "limited")))).filter("first_o is not null")
    own = known.groupBy(*_LISTED, "o").agg(F.min_by("h", "place").alias("h"))
    found = change_rows(own.withColumn("identity", F.struct("identity", "o")))  # a change that a later snapshot repeats is one of its own
    return found.select(F.col("identity.o").alias("snapshot_order"), F.col("identity.identity").alias("identity"), "title", "old_date", "new_date", "old_scale", "new_scale", "change_type", "change")


def write_changes(histories: DataFrame, path: str, checkpoint: str):
    """Writes each batch's changes to a folder of its own, which a batch that is done again replaces."""
    put = lambda batch, number: changes_of(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")
    return histories.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()
