"""Tables written in between: the folder that driver and executors share, and columns that are computed once."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only in one-process sessions where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    spark.conf.set("spark.checkpoint.dir", folder := tempfile.mkdtemp(prefix="webstrata-"))
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path, in any store that Spark reads, is a folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()


def complete_numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers N of the folders ``name=N`` below a path that were written to their end."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(place):
        return []
    found = [f.getPath() for f in fs.listStatus(place)]
    done = [p for p in found if p.getName().startswith(f"{name}=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().partition("=")[2]) for p in done)


def written(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, read again: lineage is cut, and lost executors cost nothing."""
    path = new_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def sorted_in(rows: DataFrame) -> DataFrame:
    """The right side of a join that is shuffled and sorted, never gathered by the driver.

    Spark gathers a side whose files are small, but rows that are exploded or packed take fifty times their files.
    """
    return rows.hint("merge")


@contextmanager
def small_batches(spark: SparkSession, most: str = "2m"):
    """Tables written within hand Python at most so many bytes of rows at a time, as far as rows go; the session's own choice comes back after.

    A worker holds a batch, what is made of it and copies of both, so this bounds its memory whatever the length of the texts.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def once(rows: DataFrame, /, **columns: Column) -> DataFrame:
    """The rows with further columns, each computed once for a row, whatever reads or filters them.

    The optimiser repeats an expression wherever its column is used, and takes it along into filters. A generator of one
    row stands between here, which it does not look through.
    """
    packed = F.explode_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("__once")
    return rows.select("*", packed).select(*[F.col(f"`{c}`") for c in rows.columns], *[F.col(f"__once.{n}").alias(n) for n in columns])
