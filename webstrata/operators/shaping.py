"""Relational operators: counts with all groups present, latest rows, islands, merges, run comparison, review overlay."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def counts_of(rows: DataFrame, *keys: str, default: str = "none", out: str = "n") -> DataFrame:
    """Rows by key, with nulls under a name."""
    return rows.groupBy(*[F.coalesce(F.col(k).cast("string"), F.lit(default)).alias(k) for k in keys]).agg(F.count("*").alias(out))


def zero_filled(counts: DataFrame, key: str, values: list[str], out: str = "n") -> DataFrame:
    """The counts of all the values, 0 where none came."""
    frame = counts.sparkSession.createDataFrame([(v,) for v in values], f"{key} string")
    return frame.join(counts, key, "left").select(key, F.coalesce(out, F.lit(0)).cast("long").alias(out))


def conditional_counts(rows: DataFrame, **conditions: Column) -> DataFrame:
    return rows.agg(*[F.count_if(c).cast("long").alias(name) for name, c in conditions.items()])


def pick(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order."""
    return rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rank = 1").drop("__rank")


def ordered_distinct(rows: DataFrame, key: str, position: str) -> DataFrame:
    """Each value once, with its first position."""
    return rows.groupBy(key).agg(F.min(position).alias(position))


def with_previous(rows: DataFrame, keys: list[str], order: list[str], **columns: str) -> DataFrame:
    """To each row, columns of the row before it in its group, under new names."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumns({name: F.lag(col).over(w) for name, col in columns.items()})


def merged(old: DataFrame, new: DataFrame, keys: list[str], evidence: list[str], keep: list[str]) -> DataFrame:
    """Upsert as a new generation: evidence of the new row wins, kept columns stay, and ``change`` says what happened.

    Rows whose evidence is the same (nulls equal) are marked unchanged, so a writer can leave them out.
    """
    a, b = old.alias("a"), new.alias("b")
    on = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    has_a, has_b = F.col("a.__old").isNotNull(), F.col("b.__new").isNotNull()
    joined = old.withColumn("__old", F.lit(1)).alias("a").join(new.withColumn("__new", F.lit(1)).alias("b"), on, "full")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in evidence])
    change = F.when(~has_a, "added").when(~has_b, "kept").when(same, "unchanged").otherwise("changed")
    return joined.select(
        *[F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys],
        *[F.when(has_b, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in evidence],
        *[F.when(has_a, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in keep],
        change.alias("change"),
    )


def compare_runs(first: DataFrame, second: DataFrame, key: str, score: str) -> DataFrame:
    """Rows of two runs side by side: in both, only in one, and the difference of their scores."""
    joined = first.select(key, F.col(score).alias("score_a")).join(second.select(key, F.col(score).alias("score_b")), key, "full")
    bucket = F.when(F.col("score_a").isNull(), "only_b").when(F.col("score_b").isNull(), "only_a").otherwise("both")
    return joined.select(key, "score_a", "score_b", bucket.alias("bucket"), (F.col("score_b") - F.col("score_a")).alias("delta"))


def islands(ranges: DataFrame, keys: list[str], start: str, end: str, gap: int = 1) -> DataFrame:
    """Ranges of whole numbers that touch (up to ``gap`` apart) or overlap, as one."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    seen = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("__new", F.when(F.col(start) > seen + gap, 1).when(seen.isNull(), 1).otherwise(0))
    numbered = marked.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def gaps(ranges: DataFrame, keys: list[str], start: str, end: str, low: Column, high: Column) -> DataFrame:
    """What the ranges leave open between two bounds, for each key that has ranges."""
    inside = ranges.where((F.col(end) >= low) & (F.col(start) <= high))
    cut = inside.select(*keys, F.greatest(F.col(start), low).alias(start), F.least(F.col(end), high).alias(end))
    ends = ranges.select(*keys).distinct().select(*keys, (high + 1).alias(start), (high + 1).alias(end))
    joined = islands(cut, keys, start, end).unionByName(ends)
    w = Window.partitionBy(*keys).orderBy(start)
    before = F.coalesce(F.lag(end).over(w) + 1, low)
    return joined.withColumn("__from", before).where(F.col("__from") < F.col(start)).select(*keys, F.col("__from").alias("gap_start"), (F.col(start) - 1).alias("gap_end"))


def latest(log: DataFrame, keys: list[str], sequence: str, values: list[str]) -> DataFrame:
    """The state that a log of changes leads to: the last row of each key, by aggregation (no sort, partial first)."""
    return log.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col(sequence)).alias("__v")).select(*keys, "__v.*")


def consecutive_repeats(log: DataFrame, keys: list[str], order: str, evidence: str) -> DataFrame:
    """How often the last evidence of each key came in a row at the end of its log."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    first = F.first_value(evidence).over(w)
    other = F.sum(F.when(F.col(evidence).eqNullSafe(first), 0).otherwise(1)).over(w)
    return log.withColumn("__o", other).where("__o = 0").groupBy(*keys).agg(F.first(evidence).alias(evidence), F.count("*").alias("repeats"))


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of parameters."""
    return spark.createDataFrame(rows, schema)
