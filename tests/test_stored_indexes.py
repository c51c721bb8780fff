"""Stored postings and vectors against whole computations, with updates, and with what they read."""

import random

import numpy as np
import pytest

from webstrata.operators import fulltext as FT
from webstrata.operators import postings as P
from webstrata.operators import vector_index as VI


def frame(spark, docs):
    return spark.createDataFrame(sorted(docs.items()), "doc_id long, text string")


@pytest.mark.parametrize("merge_at", [8, 2])
def test_postings_equal_bm25_after_updates(spark, tmp_path, merge_at):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(60)]
    text = lambda: " ".join(words[int(rng.random() ** 3 * 60)] for _ in range(rng.randint(0, 40)))
    docs = {k: text() for k in range(1500)} | {5000: "", -3: "w1 W59"}
    P.update(frame(spark, docs), str(tmp_path), merge_at=merge_at)
    for turn in range(2):
        changed = {k: text() + " w59" for k in rng.sample(sorted(docs), 20)} | {6000 + turn: "w58 w58 w1"}
        gone = rng.sample(sorted(docs.keys() - changed.keys()), 10)
        docs = {k: t for k, t in (docs | changed).items() if k not in gone}
        P.update(frame(spark, changed), str(tmp_path), gone=spark.createDataFrame([(k,) for k in gone], "doc_id long"), merge_at=merge_at)
        for query, k in ((["w59", "w1"], 10), (["w0"], 2000), (["w58", "w57", "w58", "none"], 5)):
            found, read = P.top(spark, str(tmp_path), query, k, first_runs=2)
            want = sorted(((round(r.score, 9), -r.doc_id) for r in FT.bm25(frame(spark, docs), "doc_id", "text", query).collect()), reverse=True)[:k]
            assert sorted(((round(r.score, 9), -r.id) for r in found.collect()), reverse=True) == want
            assert 0 < read["read"] <= read["blocks"]


def test_a_question_skips_blocks(spark, tmp_path):
    rng = random.Random(1)
    docs = {k: "common " * rng.randint(1, 3) + "filler " * 40 + ("rare rare rare" if k in (7, 3000) else "") for k in range(4000)}
    P.update(frame(spark, docs), str(tmp_path))
    found, read = P.top(spark, str(tmp_path), ["rare", "common"], 2, first_runs=3)
    assert {r.id for r in found.collect()} == {7, 3000} and read["read"] < read["blocks"] / 4
    assert P.top(spark, str(tmp_path), [], 5)[0].count() == 0 and P.top(spark, str(tmp_path), ["nothing"], 5)[0].count() == 0
    assert P.top(spark, str(tmp_path / "none"), ["rare"], 5)[0].count() == 0


def test_an_unfinished_update_changes_nothing(spark, tmp_path, monkeypatch):
    P.update(frame(spark, {1: "a b", 2: "b"}), str(tmp_path))
    with monkeypatch.context() as m:
        m.setattr(P, "_write_blocks", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            P.update(frame(spark, {1: "c"}), str(tmp_path))
    assert {r.id for r in P.top(spark, str(tmp_path), ["b"], 9)[0].collect()} == {1, 2}


def test_vectors_are_exact_and_skip_lists(spark, tmp_path):
    rng = np.random.default_rng(0)
    middle = rng.normal(size=(12, 16))
    rows = [(k, (middle[k % 12] + 0.15 * rng.normal(size=16)).tolist()) for k in range(600)]
    rows += [(600, [0.0] * 16), (601, None), (602, rows[0][1]), (0, rows[0][1])]
    vectors = spark.createDataFrame(rows, "id long, v array<double>")
    VI.build(vectors, str(tmp_path), id_col="id", vector_col="v", lists=24)
    questions = [(k, v) for k, v in rows[:40]] + [(-1, (middle[0] + middle[1]).tolist()), (-2, None), (-3, [0.0] * 16)]
    found, read = VI.nearest(spark, str(tmp_path), spark.createDataFrame(questions, "question long, vector array<double>"), 7)
    got = {}
    for r in found.orderBy("question", "rank").collect():
        got.setdefault(r.question, []).append((round(r.similarity, 9), r.id))
    good = [(k, np.array(v)) for k, v in rows if v is not None and any(v)]
    for k, v in questions:
        if v is None or not any(v):
            assert k not in got
            continue
        v = np.array(v)
        sims = sorted((round(float(x @ v / np.linalg.norm(x) / np.linalg.norm(v)), 9) for _, x in good), reverse=True)[:7]
        assert [s for s, _ in got[k]] == pytest.approx(sims, abs=1e-8)
    assert read["compared"] < read["pairs"] / 2


def test_an_empty_vector_index(spark, tmp_path):
    VI.build(spark.createDataFrame([], "id long, v array<double>"), str(tmp_path), id_col="id", vector_col="v")
    assert VI.nearest(spark, str(tmp_path), spark.createDataFrame([(1, [1.0])], "question long, vector array<double>"), 3)[0].count() == 0


def test_questions_in_blocks_beside_many_copies(spark, tmp_path, monkeypatch):
    """A vector with thousands of copies, questions in several blocks, products and held pairs cut short: ids as by comparing all."""
    rng = np.random.default_rng(3)
    middle = rng.normal(size=8)
    rows = [(k, (middle if k % 3 == 0 else rng.normal(size=8)).tolist()) for k in range(3000)]
    VI.build(spark.createDataFrame(rows, "id long, v array<double>"), str(tmp_path), id_col="id", vector_col="v", lists=9)
    monkeypatch.setattr(VI, "CELLS", 500)
    monkeypatch.setattr(VI, "HELD", 50)
    asked = [(k, v) for k, v in rows if k % 100 == 0]
    found, read = VI.nearest(spark, str(tmp_path), spark.createDataFrame(asked, "question long, vector array<double>"), 5, block=7)
    got = {}
    for r in found.orderBy("question", "rank").collect():
        got.setdefault(r.question, []).append(r.id)
    v = np.array([x for _, x in rows])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for k, _ in asked:
        s = np.round(unit @ unit[k], 9)
        assert got[k] == sorted(range(3000), key=lambda i: (-s[i], i))[:5]
    assert read["pairs"] == 30 * 3000 and read["compared"] <= read["pairs"]
