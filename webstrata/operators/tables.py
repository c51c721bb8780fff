"""Typed tables of the collection, as views over the supplied ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.catalog import table

#: Review states, in the order in which they are listed.
REVIEW_STATES = ("unreviewed", "relevant", "possibly_relevant", "false_positive", "duplicate", "dead_end", "needs_follow_up")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as snapshots of a URL (their source), in order of document id."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("source").alias("url"), F.lpad(F.col("doc_id").cast("string"), 14, "0").alias("ts"), "text", "lang")


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as captures, each with a media type told by its id."""
    p = table(spark, sf_dir, "pages")
    mime = F.element_at(F.array(*map(F.lit, ("text/html", "image/png", "", "application/pdf"))), (F.col("page_id") % 4 + 1).cast("int"))
    return p.select("page_id", "url", "html", mime.alias("mimetype"))


def operation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log: user as capture, type as category, k of the properties as stage."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("capture_id"), F.col("event_type").alias("category"), F.get_json_object("props", "$.k").cast("int").alias("stage"), "ts", "value")
