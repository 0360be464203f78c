"""Streaming twins of the monitoring views: heartbeats, latches, progress, checkpoints, reminders."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, glob: str = "events.parquet", schema: str = EVENTS, files_per_batch: int = 100) -> DataFrame:
    """Events from files that arrive in a folder, ts as an instant (watermarks need one)."""
    raw = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def latest_by_key(events: DataFrame, key: str, value: list[str], order: list[str]) -> DataFrame:
    """The newest values of each key so far (complete or update mode); the state has a row for each key."""
    return events.groupBy(key).agg(F.max_by(F.struct(*value), F.struct(*order)).alias("last")).select(key, "last.*")


def first_seen(events: DataFrame, keys: list[str], late: str | None = None) -> DataFrame:
    """Each key once; with a watermark its state is given up in time."""
    if late:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def latch(events: DataFrame, key: str, value: str, threshold: float) -> DataFrame:
    """Changes of a latch by key: raised when value falls below the threshold, cleared when it is back; each once.

    The state holds whether the latch is up. Rows of one micro-batch are taken in order of time; micro-batches must come in
    that order by key, as rows from one host do (a late row would be taken as the newest).
    """
    kind = events.schema[key].dataType.simpleString()

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        up = state.get[0] if state.exists else False
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for e, t, v in zip(rows["event_id"], rows["ts"], rows[value], strict=True):
            low = bool(v < threshold)
            if low != up:
                out.append((k[0], e, t, "raised" if low else "cleared"))
                up = low
        state.update((up,))
        yield pd.DataFrame(out, columns=[key, "event_id", "ts", "change"])

    return events.select(key, "event_id", "ts", value).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, event_id long, ts timestamp, change string", "up boolean", "append", GroupStateTimeout.NoTimeout)


def offline_latch(beats: DataFrame, key: str | None, quiet_ms: int = 180_000, running: str | None = None) -> DataFrame:
    """One `offline` row when a key has been quiet for quiet_ms of processing time, one `online` when it is back.

    With running (a column with the number of running jobs) only keys whose last beat reported any are missed. Without a
    key there is one latch for all hosts: quiet when none is heard, back when any is (key is then `hosts`, always `all`).
    """
    if key is None:
        beats, key = beats.withColumn("hosts", F.lit("all")), "hosts"
    kind = beats.schema[key].dataType.simpleString()

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        down, busy = state.get if state.exists else (False, True)
        if state.hasTimedOut:
            state.update((busy, busy))
            yield pd.DataFrame({key: [k[0]] * busy, "change": ["offline"] * busy})
            return
        for p in frames:
            busy = bool(p["jobs"].iloc[-1] > 0)
        state.update((False, busy))
        state.setTimeoutDuration(quiet_ms)
        yield pd.DataFrame({key: [k[0]] * down, "change": ["online"] * down})

    jobs = F.coalesce(F.col(running).cast("int"), F.lit(0)) if running else F.lit(1)
    return beats.select(key, jobs.alias("jobs")).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, change string", "down boolean, busy boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


def new_checkpoints(files: DataFrame, every: int = 10) -> DataFrame:
    """Checkpoints as they appear, each path once, with whether a sample is due."""
    return files.dropDuplicates(["path"]).withColumn("sample", F.col("epoch") % every == 0)


def reminders(jobs: DataFrame, now: float, within: float = 600.0) -> DataFrame:
    """One reminder for each job that starts soon."""
    lead = F.col("run_at") - now
    return jobs.filter((F.col("status") == "queued") & (lead > 0) & (lead <= within)).dropDuplicates(["id"])


def to_memory(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and returns the result (for tests and reports over small results)."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def to_files(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all that is there into a folder, exactly once by its checkpoint."""
    if mode == "append":
        q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    else:
        q = df.writeStream.foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(path)).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def through_files(df: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """The result of a stream over all that is there, by way of files in a shared folder."""
    to_files(df, f"{folder}/rows", f"{folder}/checkpoint", mode)
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/rows")
