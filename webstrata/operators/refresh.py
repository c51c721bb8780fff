"""The research index by revision: only changed documents are indexed anew, and readers see whole generations.

A generation adds one part: the index rows of documents whose revision or recipe is new, marks for documents that are gone, and
new group labels where groups may have changed. A manifest that names the parts is written last; readers follow the newest
manifest, so they see a generation as a whole or not at all. A row is replaced by any row of its id in a later part; when there are
``PARTS`` parts they are written together as one.

Groups of near copies: a group can only change if it holds a changed or lost document or if a changed document now links to it. Those
groups alone are linked and labelled anew, from their fingerprints, without texts.

Ids are unique; rows with a null id are left out. A document without words has an index row but no fingerprint and no group.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.functions.text import hamming_similarity, normalize_search
from webstrata.operators.history import _join_keys, near_links, simhash64, smallest_labels
from webstrata.operators.vectors import hashed_vector
from webstrata.storage import complete_numbers, small_batches, sorted_in, written

PARTS = 8
#: What the index rows are made by; another recipe makes all of them anew.
RECIPE = "fingerprint-64 vector-256"
THRESHOLD = 0.9


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def parts(spark: SparkSession, path: str) -> list[int]:
    """The parts of the newest generation."""
    done = complete_numbers(spark, path, "manifest")
    return json.loads(spark.read.text(f"{path}/manifest={done[-1]}").first().value)["parts"] if done else []


def _live(spark: SparkSession, path: str, table: str, of: list[int]) -> DataFrame:
    """(part, columns) of a table's newest rows by id: rows of older parts go where a later part holds their id."""
    read = {k: spark.read.parquet(f"{path}/part={k}/{table}").withColumn("part", F.lit(k)) for k in of}
    kept = []
    for n, k in enumerate(of):
        later = [read[j].select("id") for j in of[n + 1 :]]
        kept.append(read[k].join(sorted_in(_union(later)), "id", "left_anti") if later else read[k])
    return _union(kept)


def index_rows(spark: SparkSession, path: str) -> DataFrame:
    """(id, revision, recipe, exact_key, value, vector, part) of the newest generation."""
    return _live(spark, path, "index", parts(spark, path)).where("live").drop("live")


def group_labels(spark: SparkSession, path: str) -> DataFrame:
    """(id, label): the smallest id of each document's group, for documents in groups."""
    return _live(spark, path, "labels", parts(spark, path)).where("label is not null").select("id", "label")


def indexed(docs: DataFrame, recipe: str, also: dict[str, Column]) -> DataFrame:
    """Index rows of documents (id, revision, text)."""
    plain = normalize_search(F.coalesce("text", F.lit("")))
    words = F.length(F.trim(F.coalesce("text", F.lit("")))) > 0
    made = docs.select("id", "revision", F.lit(recipe).alias("recipe"), F.when(words, F.sha2(plain.cast("binary"), 256)).alias("exact_key"), simhash64(plain).alias("value"), hashed_vector(F.coalesce("text", F.lit(""))).alias("vector"), words.alias("words"), *[c.alias(n) for n, c in also.items()])
    return made.withColumn("value", F.when(F.col("words"), F.col("value"))).drop("words").withColumn("live", F.lit(True))


def _links_to(new: DataFrame, every: DataFrame, threshold: float) -> DataFrame:
    """(id): documents that a new fingerprint or text links to. Equal fingerprints and texts meet by value, others by key."""
    keys = F.explode(F.array(*_join_keys(F.col("value"), int(64 * (1 - threshold) + 1e-9)))).alias("key")
    a, b = new.select("value").distinct().select(F.col("value").alias("va"), keys), every.groupBy("value").agg(F.first("value").alias("v")).select("value", keys)
    near = b.join(sorted_in(a), "key").where(hamming_similarity(F.col("value"), F.col("va")) >= threshold).select("value").distinct()
    texts = new.select("exact_key").distinct()
    return every.join(sorted_in(near), "value", "left_semi").select("id").union(every.join(sorted_in(texts), "exact_key", "left_semi").select("id")).distinct()


def refresh(docs: DataFrame, path: str, *, id_col="doc_id", revision_col="revision", text_col="text", recipe: str = RECIPE, also: dict[str, Column] | None = None, threshold: float = THRESHOLD, most_parts: int = PARTS) -> dict[str, int]:
    """Bring the index below ``path`` up to the documents; counts of changed, unchanged and lost documents.

    also: further columns of the index rows, made of id, revision and text; whoever changes them changes the recipe.
    Nothing is written where nothing changed. A run that ends before its manifest leaves the last generation as it was; the next run
    writes over what it left.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("id"), F.col(revision_col).alias("revision"), F.col(text_col).alias("text")).where("id is not null")
    before = parts(spark, path)
    done = complete_numbers(spark, path, "manifest")
    number = done[-1] + 1 if done else 0
    if before:
        old = written(_live(spark, path, "index", before).where("live").select("id", "revision", "recipe", "exact_key", "value"), "index")
        same = (own["id"] == old["id"]) & own["revision"].eqNullSafe(old["revision"]) & (old["recipe"] == F.lit(recipe))
        changed = own.join(sorted_in(old), same, "left_anti")
        gone = old.join(sorted_in(own), "id", "left_anti").select("id", "revision", "recipe")
    else:
        changed, old, gone = own, None, None
    part = f"{path}/part={number}"
    rows = indexed(changed, recipe, also or {})
    if gone is not None:
        rows = rows.unionByName(gone.select("*", *[F.lit(None).cast(t).alias(n) for n, t in rows.dtypes if n not in ("id", "revision", "recipe", "live")], F.lit(False).alias("live")))
    with small_batches(spark):
        rows.write.mode("overwrite").parquet(f"{part}/index")
    new = spark.read.parquet(f"{part}/index")
    counts = {r.live: r["count"] for r in new.groupBy("live").count().collect()}
    total = own.count()
    summary = {"changed": counts.get(True, 0), "unchanged": total - counts.get(True, 0), "removed": counts.get(False, 0)}
    if before and not counts:
        return summary
    now = [*before, number]
    prints = _live(spark, path, "index", now).where("live and value is not null").select("id", "exact_key", "value")
    if before:
        labels = _live(spark, path, "labels", before).where("label is not null").select("id", "label")
        fresh = new.where("live and value is not null")
        touched = written(new.select("id").union(_links_to(fresh, prints, threshold)).distinct(), "touched")
        groups = labels.join(sorted_in(touched), "id", "left_semi").select("label").distinct()
        affected = written(touched.union(labels.join(sorted_in(groups), "label", "left_semi").select("id")).distinct(), "affected")
        prints = written(prints.join(sorted_in(affected), "id", "left_semi"), "prints")
    else:
        affected = prints.select("id")
    links = written(near_links(prints, threshold), "links")
    affected.join(sorted_in(smallest_labels(links)), "id", "left").select("id", "label").write.mode("overwrite").parquet(f"{part}/labels")
    if len(now) > most_parts:
        number += 1
        for table in ("index", "labels"):
            live = _live(spark, path, table, now).drop("part")
            (live.where("live") if table == "index" else live.where("label is not null")).write.mode("overwrite").parquet(f"{path}/part={number}/{table}")
        now = [number]
    manifest = json.dumps({"parts": now} | summary)
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest={number}")
    return summary
