"""Corpus pipeline: stages over documents, each written and read again as the next one's input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.llm import toxicity as tox
from webstrata.llm.bag_minhash import FEW_IDS, near_duplicates
from webstrata.llm.decontaminate import remove_spans
from webstrata.llm.pii_surrogates import replace, session_key
from webstrata.llm.sentencepiece_codec import encode_decode
from webstrata.llm._common import free_name, model_path, read, shared_folder, written


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars as the text now is."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score under 0.5 stay. The model learns from the labelled documents of the input."""
    weights = tox.fit(tox.labelled_documents(docs, read(spark, sf_dir, "labels"), "toxic"))
    score = free_name(docs.columns, "score")
    return tox.score(docs, weights, keep=docs.columns, out=score).where(F.col(score) < 0.5).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: that with the smallest id.

    Where ids are repeated or null, every row is a document of its own: rows are numbered in a written table, and of a class
    the row with the smallest id (as text, nulls last) and then the smallest number stays.
    """
    key = "doc_id"
    rows = docs
    if not docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        key = free_name(docs.columns, "row")
        number = F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0")
        rows = written(docs.withColumn(key, F.concat(F.coalesce(F.lpad(F.col("doc_id").cast("string"), 20, "0"), F.lit("~")), F.lit(":"), number)), name="numbered")
    gone = written(near_duplicates(rows, id_col=key).where(~F.col("kept")).select(key), name="gone")
    few = gone.count() <= FEW_IDS  # otherwise the ids are joined by shuffle
    return rows.join(F.broadcast(gone) if few else gone, key, "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly such passages go."""
    return _sized(remove_spans(docs, read(spark, sf_dir, "benchmark")))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data get surrogates."""
    return _sized(replace(docs, key=session_key(spark)))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers, with begin and end), their number, and the text they decode to.

    Columns of these names give way to those made here.
    """
    rest = [c for c in docs.columns if c.lower() not in ("text", "ids", "n_tokens", "decoded")]
    coded = encode_decode(docs, model_path("piece_bpe_32k.model"), keep=rest)
    return coded.select(*rest, F.col("decoded").alias("text"), "ids", (F.length("ids") / 4).cast("long").alias("n_tokens"))


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pii", pii),
    ("sentencepiece", sentencepiece),
]

#: Models and tokenizers are not SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_folder(spark).rstrip('/')}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
