"""Streams: counters kept up to date, windows with watermarks, retry timers, idempotent writes of new generations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from webstrata.storage import complete_numbers, is_folder


def event_stream(spark: SparkSession, folder: str, schema, pattern: str = "events.parquet", files_per_batch: int | None = None) -> DataFrame:
    """The event files of a folder as a stream; ``ts`` becomes a timestamp, as watermarks need one. ``pattern``: a file, or a folder
    of parts, within it. A backlog forms one batch, as files need not lie in order of time and a watermark between two batches
    would drop rows of the second; ``files_per_batch`` is for files that do."""
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader
    raw = reader.parquet(f"{folder}/{pattern}") if is_folder(spark, f"{folder}/{pattern}") else reader.option("pathGlobFilter", pattern).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def running_counts(events: DataFrame, *keys: str) -> DataFrame:
    """Counts that each batch updates (output mode update or complete)."""
    return events.groupBy(*keys).agg(F.count("*").alias("n"), F.max("ts").alias("last_seen"))


def windowed_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts by window and type; rows later than the watermark are dropped by Spark."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: runs of events without a longer gap."""
    s = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("user_id", s).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def retry_schedule(events: DataFrame, base: float = 30, most: float = 3600) -> DataFrame:
    """(user_id, attempts, due): for each capture the failures since its last success and when the next attempt is due; a success that
    is the last event clears its state: no attempts, and its time.

    Events may come in any order, within a batch and over batches: the state holds the last success and the failures after it.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        good, failures = ((state.get[0], state.get[1]), set(zip(state.get[2], state.get[3], strict=True))) if state.exists else ((-1 << 62, -1), set())
        known = len(failures)
        for rows in batches:
            failed = (rows["event_type"] == "error").to_numpy()
            places = list(zip(rows["at"].tolist(), rows["event_id"].tolist(), strict=True))
            good = max([good, *(p for p, f in zip(places, failed, strict=True) if not f)])
            failures = {p for p in failures if p > good} | {p for p, f in zip(places, failed, strict=True) if f and p > good}
        ordered = sorted(failures)
        state.update((good[0], good[1], [p[0] for p in ordered], [p[1] for p in ordered]))
        if ordered:
            delay = min(most, base * 2 ** min(12, len(ordered) - 1)) * (0.90 + (key[0] % 17) / 85)
            yield pd.DataFrame({"user_id": [key[0]], "attempts": [len(ordered)], "due": [ordered[-1][0] + int(delay * 1_000_000)]})
        elif known:
            yield pd.DataFrame({"user_id": [key[0]], "attempts": [0], "due": [good[0]]})  # takes the place of the last row of the user

    rows = events.select("user_id", "event_id", "event_type", F.unix_micros("ts").alias("at"))
    kept = "good_at long, good_number long, failed_at array<long>, failed_number array<long>"
    out = rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, attempts int, due long", kept, "update", GroupStateTimeout.NoTimeout)
    return out.withColumn("due", F.timestamp_micros("due"))


def generations(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the complete generations below a path."""
    return complete_numbers(spark, path, "generation")


def merge_each_batch(path: str, key: str, order: str):
    """A foreachBatch function: the newest row of each key in a new generation; a repeated batch changes nothing.

    A batch adds to the last complete generation before its own, whatever numbers lie between.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = [g for g in generations(spark, path) if g < epoch]
        every = spark.read.parquet(f"{path}/generation={before[-1]}").unionByName(batch) if before else batch
        every.groupBy(key).agg(F.max_by(F.struct(*[c for c in every.columns if c != key]), order).alias("r")).select(key, "r.*").write.mode("overwrite").parquet(f"{path}/generation={epoch}")

    return write


def run_to_end(stream: DataFrame, path: str, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Run a stream over what its source has now; every batch is a folder of its own below ``path``, so nothing meets in the driver.

    Returns the last batch (mode complete), all rows (append), or the last row of each key (update).
    """
    spark, schema = stream.sparkSession, stream.schema

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/generation={epoch}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    done = generations(spark, f"{path}/rows")
    if not done:
        return spark.createDataFrame([], schema)
    if mode == "complete":
        return spark.read.schema(schema).parquet(f"{path}/rows/generation={done[-1]}")
    rows = spark.read.option("basePath", f"{path}/rows").parquet(*[f"{path}/rows/generation={g}" for g in done])
    if mode == "update":
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in schema.names if c not in keys]), "generation").alias("r")).select(*keys, "r.*")
    return rows.select(*schema.names)
