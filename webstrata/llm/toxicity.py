"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are binary: words, word stems (first 4 and 5 bytes), pairs of neighbours and pairs with one word between, each
hashed into ``BUCKETS``. The fit uses at most about ``FIT_ROWS`` labelled rows, chosen by a hash of the id, in up to
``SHARDS`` shards of ``FIT_ROWS / SHARDS`` rows; each shard runs ``EPOCHS`` passes of FTRL-proximal with per-coordinate rates, and the shards'
weights are averaged (a weight that is zero in a shard counts as zero). The L1 term leaves few weights, which are
broadcast: at most ``BUCKETS`` pairs, whatever the corpus.

Null or empty texts have the bias only. Rows without label, or of the held-out fold, are never learnt from. No labelled
rows at all: every score is 0, as nothing speaks for label 1. Labels of one id that differ: the larger counts; of texts of one id, the first in
order is learnt from, so a repeated id adds one row. A kept column that is called as the score is gives way to it.
"""

from __future__ import annotations

from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.llm._common import ascii_words, fold, free_name, give_back, hashed_share, map_slices, read, sample_share, schema_of, texts_of

BUCKETS = 1 << 20
FIT_ROWS = 16_000
SHARDS = 4
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 3.0, 0.0
HELD_OUT_FOLDS = 5


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of all texts in one array, and the text that each belongs to; a feature may be there repeatedly."""
    words = [ascii_words(t) for t in texts]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    flat = list(chain.from_iterable(words))
    n = len(flat)
    whole = np.fromiter(map(crc32, flat), np.uint32, n).astype(np.uint64)
    four = np.fromiter((crc32(w[:4]) for w in flat), np.uint32, n).astype(np.uint64)
    five = np.fromiter((crc32(w[:5]) for w in flat), np.uint32, n).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    mixed = whole * np.uint64(0x9E3779B97F4A7C15)
    made, owners = [whole, four * np.uint64(0xC2B2AE3D27D4EB4F), five * np.uint64(0xD6E8FEB86659FD93)], [owner] * 3
    for gap, salt in ((1, 0x165667B19E3779F9), (2, 0xFF51AFD7ED558CCD)):
        same = owner[gap:] == owner[:-gap]
        made.append(((mixed[:-gap] ^ (whole[gap:] * np.uint64(salt))) * np.uint64(0x2545F4914F6CDD1D))[same])
        owners.append(owner[gap:][same])
    buckets = [((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int32) for h in made]
    return np.concatenate(buckets), np.concatenate(owners)


def fit_shard(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over the rows in the given order; buckets and weights that are not zero (bucket -1: bias)."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    rows = []
    for k in range(0, len(texts), 256):
        buckets, owner = features(texts[k : k + 256])
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(len(texts[k : k + 256]) + 1))
        rows += [np.append(np.unique(buckets[order[a:b]]), BUCKETS).astype(np.int32) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def weights(at):
        zs = z[at]
        w = -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        w[(np.abs(zs) <= L1) & (at != BUCKETS)] = 0
        return np.where(at == BUCKETS, -zs / ((BETA + np.sqrt(n[at])) / ALPHA + L2), w)  # the bias has no L1 term

    for _ in range(epochs):
        for at, y in zip(rows, labels, strict=True):
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            g2 = g * g
            z[at] += g - (np.sqrt(n[at] + g2) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g2
    w = weights(np.arange(BUCKETS + 1))
    kept = np.flatnonzero(w)
    return np.where(kept == BUCKETS, -1, kept), w[kept]


def fit(labelled: DataFrame, *, id_col="doc_id", text_col="text", label_col="toxic", rows: int = FIT_ROWS, shards: int = SHARDS, epochs: int = EPOCHS) -> DataFrame:
    """Weights as rows (bucket, weight) from labelled texts; see the module for the bound."""
    own = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label")).where("label is not null")
    n = own.count()
    share, shards = sample_share(n, rows), max(1, min(shards, n * shards // rows))
    sample = own.where(hashed_share("id", share)).withColumn("shard", F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(shards)).cast("int"))

    def learn(rows_: pd.DataFrame) -> pd.DataFrame:
        rows_ = rows_.assign(h=[crc32(str(i).encode()) for i in rows_["id"]]).sort_values(["h", "id", "label"])
        at, w = fit_shard(rows_["text"].fillna("").tolist(), rows_["label"].to_numpy(), epochs)
        give_back()
        return pd.DataFrame({"bucket": at, "weight": w})

    return sample.groupBy("shard").applyInPandas(learn, "bucket int, weight double").groupBy("bucket").agg((F.sum("weight") / shards).alias("weight"))


def score(docs: DataFrame, weights: DataFrame, *, id_col="doc_id", text_col="text", keep: list[str] | None = None, out: str = "score") -> DataFrame:
    """The kept columns (the id if none are given) and the model's probability of label 1, as column ``out``."""
    found = weights.toPandas()  # at most BUCKETS + 1 rows, by construction
    table = np.zeros(BUCKETS, np.float32)
    inner = found[found.bucket >= 0]
    table[inner.bucket.to_numpy()] = inner.weight.to_numpy()
    bias = float(found.loc[found.bucket < 0, "weight"].sum()) if len(found) else -np.inf
    at = np.flatnonzero(table).astype(np.int32)
    shared = docs.sparkSession.sparkContext.broadcast((at, table[at], bias))
    keep = [k for k in keep or [id_col] if k.lower() != out.lower()]
    own_text = free_name(keep, "text")
    own = docs.select(*keep, F.col(text_col).alias(own_text))
    made: dict[int, np.ndarray] = {}

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(part, own_text)
        at, w, bias = shared.value
        if not made:
            made[0] = np.zeros(BUCKETS, np.float32)
            made[0][at] = w
        table = made[0]
        buckets, owner = features(texts)
        value = table[buckets]
        live = np.flatnonzero(value)
        pairs = np.unique(owner[live].astype(np.int64) << 20 | buckets[live])  # a feature counts once in a text
        total = bias + np.bincount(pairs >> 20, weights=table[pairs & (BUCKETS - 1)], minlength=len(texts))
        columns = [part.column(c) for c in range(len(keep))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.where(np.isinf(total), 0.0, 1 / (1 + np.exp(-np.clip(total, -35, 35)))))], names=[*keep, out])

    return map_slices(own, own_text, ", ".join([schema_of(docs, *keep)] * bool(keep) + [f"`{out}` double"]), run)


def labelled_documents(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Texts with their label, without the held-out fold. The labels hold one id and one number per row and join by id."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", HELD_OUT_FOLDS) != 0)).groupBy("doc_id").agg(F.max(label).alias(label))
    share = sample_share(known.count(), FIT_ROWS)
    chosen = known.where(hashed_share("doc_id", share, seed=29))  # about FIT_ROWS pairs of numbers at most
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max(label).alias(label))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    weights = fit(labelled_documents(docs, read(spark, sf_dir, "labels"), "toxic"))
    return score(docs, weights).select(
        "doc_id", (fold("doc_id", HELD_OUT_FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
