"""Arrow functions over slices: what they hold at a time, and their results against plain Python."""

from collections import Counter
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from webstrata import catalog
from webstrata.functions import slices
from webstrata.functions.text import normalize_search
from webstrata.operators import fulltext, hits, history, keyword_scan, postings, refresh, vectors
from webstrata.plans import load_all
from webstrata.sources import bodies

load_all()

TEXTS = ["", None, "a thing in the ether", "é" * 40, "the the thing " * 3000] + [f"word{k} in the page {k % 7}" for k in range(9000)]


def test_slices_hold_few_bytes_and_few_rows(monkeypatch):
    monkeypatch.setattr(slices, "SLICE_BYTES", 1000)
    seen = []

    @slices.sliced(IntegerType())
    def size(texts):
        seen.append(sum(len((t or "").encode()) for t in texts))
        return [len(t or "") for t in texts]

    assert size.func(pa.array(TEXTS, pa.string())).to_pylist() == [len(t or "") for t in TEXTS]
    assert sorted(seen)[-1] == len(TEXTS[4]) and sorted(seen)[-2] <= 1000
    assert size.func(pa.array([], pa.string())).to_pylist() == []
    assert max(b - a for a, b in slices.cuts((pa.array([None] * 9000, pa.string()),), 1 << 20)) == 4096


@pytest.mark.parametrize("made", [normalize_search, history.simhash64, postings.term_counts, vectors.hashed_vector, bodies._is_text, bodies.decode_body])
def test_functions_over_texts_take_slices(made, monkeypatch):
    """Results do not depend on where a batch is cut."""
    columns = [pa.array(TEXTS[:300], pa.string())]
    if made in (bodies._is_text, bodies.decode_body):
        columns = [columns[0].cast(pa.binary()), pa.array(["text/html"] * 300)]
    whole = made.func(*columns)
    monkeypatch.setattr(slices, "SLICE_BYTES", 64)
    assert made.func(*columns).equals(whole) and len(whole) == 300


def test_spans_and_proximity_of_empty_and_null_texts(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS[:5])], "k int, t string")
    got = {r.k: r.s for r in rows.select("k", hits.spans(F.col("t"), ["the", "he", "in"], overlapping=False).alias("s")).collect()}
    assert got[0] == got[1] == [] and [(x.literal, x.start, x.end) for x in got[2]] == [("in", 4, 6), ("in", 8, 10), ("the", 11, 14), ("the", 16, 19)]
    rules = keyword_scan.parse_rules(["thing", "ether"])
    near = {r.k: r.p for r in rows.select("k", keyword_scan.proximity(F.col("t"), rules).alias("p")).collect()}
    assert near[1] == (0, None) and near[2] == (1, 3)


def test_hashed_vectors_equal_the_sum_over_features(monkeypatch):
    """Also when the worker forgets words between texts; features of any order give the same vector."""
    monkeypatch.setattr(vectors, "FEATURES", 3)
    texts = ["alpha beta alpha b ünder", "b ünder alpha beta alpha", None, "x"]
    for text, got in zip(texts, vectors.hashed_vector.func(pa.array(texts, pa.string())).to_pylist(), strict=True):
        words = (text or "").split()
        long = [w for w in words if len(w) > 1]
        features = [f"w:{w}" for w in long] + [f"c:{f'^{w}$'[k : k + 3]}" for w in long for k in range(len(w))] + [f"b:{a} {b}" for a, b in zip(words, words[1:], strict=False)]
        v = np.zeros(256)
        for feature, n in Counter(features).items():
            d = blake2b(feature.encode(), digest_size=16).digest()
            v[int.from_bytes(d[:8], "little") % 256] += (1 if d[8] & 1 else -1) * (1 + np.log1p(n))
        assert np.allclose(got, v / (np.linalg.norm(v) or 1), atol=1e-7)


def test_slices_without_words_and_cosines(monkeypatch):
    """Also when a chunk ends with the last word of a slice; the cosine is that of the vectors."""
    monkeypatch.setattr(vectors, "TOGETHER", 10)
    texts = [None, "", "a thing with the others", "-- --", "漢字 é ß"]
    assert not np.any(vectors.hashed_vector.func(pa.array(["", None], pa.string())).flatten().to_numpy())
    rows = np.array(vectors.hashed_vector.func(pa.array(texts, pa.string())).to_pylist())
    assert [bool(r.any()) for r in rows] == [False, False, True, False, True]


def test_best_documents_by_all_evidence(spark, tmp_path):
    """The same with a vector for each document, whether the best hold a word of the query or not."""
    for k, texts in enumerate([["a thing with some words " + "x" * n for n in range(60)] + ["nothing", "", None, "some words"], ["stupid thing"] + ["thin gs wit"] * 70]):
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/{k}/documents.parquet")
        words = ["thing", "with", "stupid"]
        d = spark.read.parquet(f"{tmp_path}/{k}/documents.parquet")
        rows = dict(zip(range(len(texts)), vectors.hashed_vector.func(normalize_search.func(pa.array(texts, pa.string()))).to_pylist(), strict=True))
        asked = np.array(vectors.hashed_vector.func(pa.array([" ".join(words)])).to_pylist()[0])
        rank = {r.doc_id: r.score for r in fulltext.bm25(d, "doc_id", "text", words).collect()}
        want = []
        for n, text in enumerate(texts):
            v = np.array(rows[n])
            sim = float(v @ asked / (np.linalg.norm(v) * np.linalg.norm(asked) or 1))
            if n in rank or sim >= 0.1:
                hits = sum((text or "").lower().count(w) for w in words)
                want.append((-round(0.58 * (sim + 1) / 2 + 0.24 * rank.get(n, 0) / max(rank.values()) + 0.08 * min(1, np.log1p(hits) / np.log(101)), 6), n))
        got = catalog.QUERIES["hybrid_search"](spark, f"{tmp_path}/{k}").collect()
        assert [(-r.score, r.doc_id) for r in got] == [(pytest.approx(s, abs=2e-6), n) for s, n in sorted(want)[:50]]


def test_ranking_finds_words_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(value):
        seen.add(1)
        return value

    docs = spark.createDataFrame([(k, f"thing {k}") for k in range(5)], "id long, text string").withColumn("text", counted("text"))
    ranked = fulltext.bm25(docs, "id", "text", ["thing", "3"])
    assert ranked.count() == len(ranked.collect()) == 5 and seen.value == 5


def test_near_groups_fingerprint_each_text_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(value):
        seen.add(1)
        return value

    prints = spark.createDataFrame([(1, "x", 5), (2, "x", 5), (3, "y", 4), (4, "z", -1)], "id long, exact_key string, value long")
    got = history.near_groups(prints.withColumn("value", counted("value"))).orderBy("id").collect()
    assert [(r.id, r.group, r.members) for r in got] == [(1, 1, 3), (2, 1, 3), (3, 1, 3)] and seen.value == 4


def test_index_rows_are_made_in_small_batches(spark, tmp_path):
    @F.arrow_udf("int")
    def rows_at_once(text: pa.Array) -> pa.Array:
        return pa.array([len(text)] * len(text), pa.int32())

    docs = spark.range(3000).selectExpr("id AS doc_id", "1 AS revision", "repeat('word ', 400) AS text").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    refresh.refresh(docs, str(tmp_path), also={"n": rows_at_once(F.col("text"))})
    assert refresh.index_rows(spark, str(tmp_path)).agg(F.max("n")).first()[0] < 1500
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_no_join_of_the_index_is_gathered_by_the_driver(spark):
    """Small files may hold rows that explode to fifty times their size; a broadcast of any size fails here."""
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1")
    try:
        rows = catalog.QUERIES["index_refreshed"](spark, "/root/testdata/sf0.001")
        assert rows.where("part > 0").count() > 10
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
