"""Media policies and the queue of discovered media: kinds, allowed URLs, snapshots, new and richer rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.functions.text import extension_of, host_of, host_within, without_replay
from webstrata.operators.classify import AUDIO, IMAGE, VIDEO


def media_kind(url: Column, hint: Column) -> Column:
    """image, video or audio by suffix, else by a hint."""
    ext = extension_of(url)
    return F.when(ext.isin(IMAGE), "image").when(ext.isin(VIDEO), "video").when(ext.isin(AUDIO), "audio").otherwise(F.nullif(F.lower(hint), F.lit("")))


def allowed(url: Column, include: list[str], exclude: list[str], kinds: tuple[str, ...] = ("image", "video")) -> Column:
    """A suffix of the selected kinds or included ones, and none of the excluded."""
    chosen = [e for k, es in (("image", IMAGE), ("video", VIDEO), ("audio", AUDIO)) if k in kinds for e in es] + include
    return extension_of(url).isin([e for e in chosen if e not in exclude])


def suffix_pattern(extensions: list[str]) -> str:
    """A pattern for URLs with one of the suffixes."""
    return r"(?i)\.(" + "|".join(sorted(e.lstrip(".") for e in extensions)) + r")([;&?#]|$)"


def discovered(links: DataFrame, pages: DataFrame, id_col: str, page_url: str, targets: list[str]) -> DataFrame:
    """(link, first_page, pages, external): distinct media links of all pages, and whether they lie outside page and targets."""
    rows = links.join(pages.select(id_col, F.col(page_url).alias("__p")), id_col).withColumn("link", without_replay(F.col("link")))
    host = host_of(F.col("link"), "")
    inside = host == host_of(F.col("__p"), "")
    for t in targets:
        inside = inside | host_within(host, F.lit(t))
    return rows.where(media_kind(F.col("link"), F.lit("")).isNotNull()).groupBy("link").agg(F.min(id_col).alias("first_page"), F.count_distinct(id_col).alias("pages"), (~F.bool_or(inside)).alias("external"))


def enqueued(queue: DataFrame, found: DataFrame, key: str, optional: list[str]) -> DataFrame:
    """The queue with new rows; rows it has only gain values they lack."""
    joined = queue.withColumn("__q", F.lit(1)).alias("q").join(found.alias("f"), key, "full")
    cols = [c for c in queue.columns if c != key]
    return joined.select(key, *[(F.coalesce(F.col(f"q.{c}"), F.col(f"f.{c}")) if c in optional else F.when(F.col("__q") == 1, F.col(f"q.{c}")).otherwise(F.col(f"f.{c}"))).alias(c) for c in cols])


def changed_documents(documents: DataFrame, scanned: DataFrame, id_col: str, digest: str) -> DataFrame:
    """Documents whose present digest was not scanned yet."""
    return documents.join(scanned.select(id_col, digest), [id_col, digest], "left_anti")
