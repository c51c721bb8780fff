"""Merges of two collections by natural keys, conflicts between them, moved folders and repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merged_captures(own: DataFrame, other: DataFrame, keys: list[str], id_col: str) -> tuple[DataFrame, DataFrame]:
    """All captures of both by natural key, and (other id, id): where the other's rows went.

    Rows that both have keep the own id. New ones get ids behind the largest own one, by their other id: the offset is one
    number, so no row is counted in one task.
    """
    top = own.agg(F.max(id_col)).first()[0] or 0
    theirs = other.withColumnRenamed(id_col, "__other")
    known = theirs.join(own.select(*keys, F.col(id_col).alias("__own")), keys, "left")
    placed = known.withColumn(id_col, F.coalesce("__own", F.lit(top) + F.col("__other")))
    added = placed.where("__own is null").select(*own.columns)
    return own.unionByName(added), placed.select(F.col("__other").alias("other_id"), id_col)


def conflicts(own: DataFrame, other: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """(keys, own, other) of bodies that both have under one key with different known digests."""
    pairs = own.select(*keys, F.col(digest).alias("own")).join(other.select(*keys, F.col(digest).alias("other")), keys)
    return pairs.where("own <> other")


def merged_reviews(own: DataFrame, other: DataFrame, key: str = "match_id") -> DataFrame:
    """(key, status): the own review, unless it is open and the other is not."""
    both = own.select(key, F.col("status").alias("a")).join(other.select(key, F.col("status").alias("b")), key, "full")
    decided = F.when(F.coalesce("a", F.lit("unreviewed")) == "unreviewed", F.coalesce("b", "a")).otherwise(F.col("a"))
    return both.select(key, decided.alias("status"))


def merged_facts(own: DataFrame, other: DataFrame, moved: DataFrame, id_col: str) -> DataFrame:
    """Rows that hang on captures (notes, extractions) of both, the other's under their new ids; a second merge adds nothing."""
    theirs = other.withColumnRenamed(id_col, "other_id").join(moved, "other_id").select(*own.columns)
    return own.unionByName(theirs).distinct()


def rebased(path: Column, old: str, new: str) -> Column:
    """Paths below a folder that moved, by whole names; other paths as they are."""
    a, b = old.rstrip("/\\"), new.rstrip("/\\")
    tidy = F.replace(path, F.lit("\\"), F.lit("/"))
    below = (tidy == a) | F.startswith(tidy, F.lit(a + "/"))
    return F.when(below, F.concat(F.lit(b), F.substr(tidy, F.lit(len(a) + 1)))).otherwise(path)


def repaired(captures: DataFrame, files: DataFrame, documents: DataFrame) -> DataFrame:
    """Captures with the state that the files and documents at hand allow, and what was mended (null if nothing).

    Interrupted downloads and downloads without a file are pending again; files without a document wait for a scan.
    """
    has = lambda rows, key, mark: rows.select(key).distinct().withColumn(mark, F.lit(True))
    joined = captures.join(has(files, "path", "__f"), "path", "left").join(has(documents, "capture_id", "__d"), "capture_id", "left")
    saved, file_, doc = F.col("state").isin("downloaded", "downloaded_unscanned"), F.col("__f").isNotNull(), F.col("__d").isNotNull()
    mended = (
        F.when(F.col("state") == "downloading", "interrupted").when(saved & ~file_, "file_missing")
        .when((F.col("state") == "downloaded") & ~doc, "document_missing").when((F.col("state") == "downloaded_unscanned") & doc, "already_scanned")
    )
    states = {"interrupted": "pending", "file_missing": "pending", "document_missing": "downloaded_unscanned", "already_scanned": "downloaded"}
    known = F.create_map(*[F.lit(x) for pair in states.items() for x in pair])
    return joined.withColumn("mended", mended).withColumn("state", F.coalesce(F.get(F.array(F.element_at(known, F.coalesce("mended", F.lit("")))), F.lit(0)), F.col("state"))).drop("__f", "__d")


def judged(results: DataFrame, keys: list[str]) -> DataFrame:
    """Judgements within their bounds, the last of each key by ``sequence``; those without a match are left out."""
    last = results.where("match_id is not null").groupBy(*keys).agg(F.max_by(F.struct("relevance_score", "confidence", "category"), "sequence").alias("v"))
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.bround(F.coalesce("v.relevance_score", F.lit(0.0))))).cast("int")
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("v.confidence", F.lit(0.0))))
    return last.select(*keys, score.alias("relevance_score"), sure.alias("confidence"), F.substring(F.coalesce("v.category", F.lit("")), 1, 120).alias("category"))


def grounded(claims: DataFrame, evidence: DataFrame, group: str) -> DataFrame:
    """Claims (group, support ids, confidence) whose support is not empty and lies within the group's evidence, confidence within 0 and 1.

    Supports are matched one by one, so no group's evidence is gathered.
    """
    numbered = claims.select(group, "claim_id", F.explode(F.array_distinct("support")).alias("id"))
    marks = numbered.join(evidence.select(group, "id").distinct().withColumn("__e", F.lit(1)), [group, "id"], "left")
    good = marks.groupBy(group, "claim_id").agg(F.bool_and(F.col("__e").isNotNull()).alias("__ok")).where("__ok").select(group, "claim_id")
    return claims.join(good, [group, "claim_id"], "left_semi").withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))))
