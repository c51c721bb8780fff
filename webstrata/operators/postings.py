"""Ranked full text from stored postings: blocks with bounds, questions that read few of them, and replacement by parts.

A block holds a term's postings in one run of ``BLOCK`` ids, with the largest number of occurrences and the least length in it. Blocks
lie in folders by a hash of the term, so a question opens its own terms' folders only. The bounds of a run of ids over all terms of
a question tell the most that a document there can score. A question scores the most promising runs first; the score of the last place so
far rules out every run whose bound is lower, and the others are scored in a second round. So the places are exact.

An update writes a part: the postings of new and changed documents, and the ids that it replaces or that are gone. Rows of older parts
count only where no later part names their id. The manifest, written last, names the parts and holds the numbers of documents and words.
Ids are whole numbers; rows with a null id are left out, null texts are empty.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, MapType, StringType

from webstrata.functions.slices import sliced
from webstrata.operators.fulltext import K1, B
from webstrata.storage import complete_numbers, once, written

BLOCK = 128
#: Folders of terms in each part; runs of ids that the first round scores.
FOLDERS, FIRST_RUNS = 64, 16
_TERM = re.compile(r"[a-z0-9]+")


@sliced(MapType(StringType(), IntegerType()))
def term_counts(text: list) -> list:
    """Terms (a-z and 0-9, in lower case) with their occurrences."""
    return [list(Counter(_TERM.findall(t or "")).items()) for t in text]


def _manifest(spark: SparkSession, path: str) -> dict:
    done = complete_numbers(spark, path, "manifest")
    return json.loads(spark.read.text(f"{path}/manifest={done[-1]}").first().value) | {"number": done[-1]} if done else {"parts": [], "documents": 0, "words": 0, "number": -1}


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def _ids(spark: SparkSession, path: str, parts: list[int]) -> DataFrame:
    return _union([spark.read.parquet(f"{path}/part={k}/documents") for k in parts])


def _lengths(spark: SparkSession, path: str, parts: list[int]) -> DataFrame:
    """(id, length) of the documents as they are now."""
    read = [spark.read.parquet(f"{path}/part={k}/documents") for k in parts]
    kept = [r.join(_union(read[n + 1 :]).select("id"), "id", "left_anti") if n + 1 < len(read) else r for n, r in enumerate(read)]
    return _union(kept).where("length is not null")


def update(docs: DataFrame, path: str, *, id_col="doc_id", text_col="text", gone: DataFrame | None = None, merge_at: int = 8) -> None:
    """Take in new and changed documents (unique ids) and forget those of ``gone``; ``merge_at`` parts are written together as one."""
    spark, before = docs.sparkSession, _manifest(docs.sparkSession, path)
    number = before["number"] + 1
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    counted = written(once(own, terms=term_counts(F.lower("text"))).select("id", "terms", F.aggregate(F.map_values("terms"), F.lit(0), lambda a, x: a + x).alias("length")), "terms")
    part = f"{path}/part={number}"
    ids = counted.select("id", "length")
    if gone is not None:
        ids = ids.unionByName(gone.select(F.col(id_col).cast("long").alias("id"), F.lit(None).cast("int").alias("length")).join(ids.select("id"), "id", "left_anti"))
    ids.write.mode("overwrite").parquet(f"{part}/documents")
    _write_blocks(counted.select("id", "length", F.explode("terms").alias("term", "tf")), f"{part}/blocks")
    parts = [*before["parts"], number]
    if len(parts) >= merge_at:
        number += 1
        _lengths(spark, path, parts).write.mode("overwrite").parquet(f"{path}/part={number}/documents")
        _write_blocks(_postings(spark, path, parts), f"{path}/part={number}/blocks")
        parts = [number]
    facts = _lengths(spark, path, parts).agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("words")).first()
    manifest = json.dumps({"parts": parts, "documents": facts.n, "words": facts.words})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest={number}")


def _write_blocks(postings: DataFrame, path: str) -> None:
    """postings: (id, length, term, tf)."""
    run = F.floor(F.col("id") / BLOCK).alias("run")
    blocks = postings.groupBy("term", run).agg(F.sort_array(F.collect_list(F.struct("id", "tf", "length"))).alias("postings"), F.max("tf").alias("max_tf"), F.min("length").alias("min_length"))
    folder = F.pmod(F.xxhash64("term"), F.lit(FOLDERS)).cast("int").alias("folder")
    blocks.select("*", folder).repartition("folder").sortWithinPartitions("folder", "term", "run").write.mode("overwrite").partitionBy("folder").parquet(path)


def _blocks(spark: SparkSession, path: str, parts: list[int], terms: list[str] | None) -> DataFrame:
    """(term, run, postings, max_tf, min_length) of all parts; where later parts name ids, without the postings of these."""
    asked = spark.createDataFrame([(t,) for t in terms], "term string").select(F.pmod(F.xxhash64("term"), F.lit(FOLDERS)).alias("f")).distinct().collect() if terms is not None else None
    out = []
    for n, k in enumerate(parts):
        blocks = spark.read.parquet(f"{path}/part={k}/blocks")
        if terms is not None:
            blocks = blocks.where(F.col("folder").isin([r.f for r in asked]) & F.col("term").isin(terms))
        blocks = blocks.select("term", "run", "postings", "max_tf", "min_length")
        if n + 1 < len(parts):
            replaced = _ids(spark, path, parts[n + 1 :]).groupBy(F.floor(F.col("id") / BLOCK).alias("run")).agg(F.collect_set("id").alias("replaced"))  # at most BLOCK ids each
            left = F.filter("postings", lambda p: ~F.coalesce(F.array_contains("replaced", p.id), F.lit(False)))
            blocks = blocks.join(replaced, "run", "left").select("term", "run", left.alias("postings"), "max_tf", "min_length").where(F.size("postings") > 0)
        out.append(blocks)
    return _union(out)


def _postings(spark: SparkSession, path: str, parts: list[int]) -> DataFrame:
    return _blocks(spark, path, parts, None).select("term", F.explode("postings").alias("p")).select("p.id", "p.length", "term", "p.tf")


def top(spark: SparkSession, path: str, query: list[str], k: int, *, k1: float = K1, b: float = B, first_runs: int = FIRST_RUNS) -> tuple[DataFrame, dict[str, int]]:
    """(id, score) of the k best documents, and how many of the question's blocks there are and were read."""
    facts, terms = _manifest(spark, path), list(dict.fromkeys(query))
    if not facts["parts"] or not terms:
        return spark.createDataFrame([], "id long, score double"), {"blocks": 0, "read": 0}
    blocks = written(_blocks(spark, path, facts["parts"], terms), "asked")
    df = {r.term: r.df for r in blocks.groupBy("term").agg(F.sum(F.size("postings")).alias("df")).collect()}  # a row for each term asked
    n, mean = float(facts["documents"]), float(facts["words"] / facts["documents"] if facts["words"] else 1)

    def part(tf: Column, length: Column, frequency: Column) -> Column:
        idf, t = F.ln((F.lit(n) - frequency + 0.5) / (frequency + 0.5) + 1), tf.cast("double")
        return idf * t * (k1 + 1) / (t + k1 * (1 - b + b * length / F.lit(mean)))

    frequency = F.try_element_at(F.create_map(*[F.lit(x) for t in terms for x in (t, float(df.get(t, 0)))]), F.col("term"))
    times = F.try_element_at(F.create_map(*[F.lit(x) for t in terms for x in (t, query.count(t))]), F.col("term"))  # a term asked twice counts twice
    most = blocks.groupBy("run", "term").agg(F.max(times * part(F.col("max_tf"), F.col("min_length"), frequency)).alias("most"), F.count("*").alias("n"))
    bounds = written(most.groupBy("run").agg(F.sum("most").alias("bound"), F.sum("n").alias("n")), "bounds")

    def scored(runs: DataFrame) -> DataFrame:
        own = blocks.join(runs.select("run"), "run", "left_semi").select("term", F.explode("postings").alias("p"))
        by = own.groupBy("p.id").agg(*[F.max(F.when(F.col("term") == t, part(F.col("p.tf"), F.col("p.length"), F.lit(float(df.get(t, 0)))))).alias(f"s{j}") for j, t in enumerate(terms)])
        total = sum((F.coalesce(F.col(f"s{terms.index(t)}"), F.lit(0.0)) for t in query), F.lit(0.0))
        return by.select("id", total.alias("score"))

    order = [F.desc("score"), F.asc("id")]
    first = written(bounds.orderBy(F.desc("bound"), "run").limit(first_runs), "first")
    best = written(scored(first).orderBy(*order).limit(k), "best")
    ends = best.agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
    rest = bounds.join(first.select("run"), "run", "left_anti")
    if ends.n >= k:
        rest = rest.where(F.col("bound") >= ends.least * (1 - 1e-12))  # a bound and a score are sums in different orders
    rest = written(rest, "rest")
    counts = [frame.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n for frame in (bounds, first, rest)]
    found = best.unionByName(scored(rest)).orderBy(*order).limit(k)
    return found, {"blocks": counts[0], "read": counts[1] + counts[2]}
