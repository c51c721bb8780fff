"""Counters kept by changes: each change of a row takes one from the bucket it was in and adds one to the bucket it is in now.

A table holds the last change of each row, so old values need no look-up in a table of all changes. A change that is not newer than the
last one of its row (a repeated or late one) does nothing; a deleted row keeps a mark for that. Each batch writes these rows, and then
the counters, as a new generation on top of the last one before it, so a batch that is run again changes nothing. All of it is
joins and aggregates: no function is called by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.streaming.jobs import generations


def known_changes(changes: DataFrame, id_col: str, sequence_col: str, gone_col: str, fields: list[str]) -> DataFrame:
    """(id, now): the changes with their number, mark of deletion and fields as texts; null is a value of its own.

    Rows with a null id, number or mark of deletion are left out.
    """
    now = F.struct(F.col(sequence_col).cast("long").alias("sequence"), F.col(gone_col).alias("gone"), *[F.col(f).cast("string").alias(f) for f in fields])
    return changes.select(F.col(id_col).alias("id"), now.alias("now")).where("id is not null and now.sequence is not null and now.gone is not null")


def moved_rows(batch: DataFrame, last: DataFrame | None) -> DataFrame:
    """(id, now, before, moved): the rows after a batch of changes; ``moved`` where one is newer than the last, which is ``before`` then.

    Of changes of a row with one number in a batch the greatest (by deletion, then fields) counts.
    """
    newest = batch.groupBy("id").agg(F.max("now").alias("new"))
    if last is None:
        return newest.select("id", F.col("new").alias("now"), F.when(F.lit(False), F.col("new")).alias("before"), F.lit(True).alias("moved"))
    both = newest.join(last.select("id", F.col("now").alias("old")), "id", "full_outer")
    moved = F.col("new").isNotNull() & (F.col("old").isNull() | (F.col("new.sequence") > F.col("old.sequence")))
    return both.select("id", F.when(moved, F.col("new")).otherwise(F.col("old")).alias("now"), F.when(moved, F.col("old")).alias("before"), moved.alias("moved"))


def deltas(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(fields, delta): -1 for the bucket that a moved row leaves, 1 for that which it enters."""
    side = lambda c, n: F.when(~F.col(f"{c}.gone"), F.struct(*[F.col(f"{c}.`{f}`").alias(f) for f in fields], F.lit(n).alias("delta")))
    return rows.where("moved").select(F.explode(F.array(side("before", -1), side("now", 1))).alias("d")).where("d is not null").select("d.*")


def counted_each_batch(path: str, fields: list[str]):
    """A foreachBatch function: the counters (fields, n) with this batch's deltas, as a new generation; empty buckets go."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = [g for g in generations(spark, path) if g < epoch]
        every = batch.groupBy(*fields).agg(F.sum("delta").cast("long").alias("n"))
        if before:
            every = spark.read.parquet(f"{path}/generation={before[-1]}").unionByName(every)
        every.groupBy(*fields).agg(F.sum("n").alias("n")).where("n <> 0").write.mode("overwrite").parquet(f"{path}/generation={epoch}")

    return write


def kept_each_batch(path: str, fields: list[str]):
    """A foreachBatch function over ``known_changes``: the rows, then the counters, below ``path``."""
    count = counted_each_batch(f"{path}/counters", fields)

    def write(batch: DataFrame, epoch: int) -> None:
        spark, rows = batch.sparkSession, f"{path}/rows"
        done = [g for g in generations(spark, rows) if g < epoch]
        last = spark.read.parquet(f"{rows}/generation={done[-1]}") if done else None
        moved_rows(batch, last).write.mode("overwrite").parquet(f"{rows}/generation={epoch}")
        count(deltas(spark.read.parquet(f"{rows}/generation={epoch}"), fields), epoch)

    return write


def counters(spark, path: str, fields: list[str]) -> DataFrame:
    """The counters of the last complete generation."""
    done = generations(spark, path)
    schema = ", ".join(f"`{f}` string" for f in fields) + ", n long"
    return spark.read.schema(schema).parquet(f"{path}/generation={done[-1]}") if done else spark.createDataFrame([], schema)


def keep_counters(changes: DataFrame, path: str, id_col: str, sequence_col: str, gone_col: str, fields: list[str]) -> DataFrame:
    """Take in what the stream of changes has now; the counters after it."""
    stream = known_changes(changes, id_col, sequence_col, gone_col, fields)
    writer = stream.writeStream.outputMode("append").foreachBatch(kept_each_batch(path, fields))
    writer.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return counters(changes.sparkSession, f"{path}/counters", fields)
