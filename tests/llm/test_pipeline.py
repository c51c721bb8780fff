"""The corpus pipeline: every stage on the smallest tables and on odd rows."""

import corpus_pipeline as cp
from webstrata.llm import bag_minhash as bm
from webstrata.llm import decontaminate as dc
from webstrata.llm import pii_surrogates as ps

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    kept = {}
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
        assert set(columns) <= set(docs.columns) and (name == "sentencepiece" or docs.columns == columns)
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_dedup", "decontaminate", "pii", "sentencepiece"]
    assert len(before) >= len(kept["toxicity"]) > len(kept["near_dedup"]) >= len(kept["decontaminate"]) == len(kept["pii"]) == len(kept["sentencepiece"])
    left = bm.near_duplicates(spark.createDataFrame(list(kept["near_dedup"].items()), "doc_id long, text string"))
    assert left.where("class_size > 1").count() == 0
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert dc.find_matches(spark.createDataFrame(list(kept["decontaminate"].items()), "doc_id long, text string"), items).where("n_hit > 0").count() == 0
    assert all(len(ps.find(kept["pii"][k])) == len(ps.find(t)) for k, t in kept["decontaminate"].items())
    assert kept["sentencepiece"] == kept["pii"]


def test_run(spark):
    assert cp.run(spark, SF).count() > 0


def test_odd_rows(spark):
    rows = [(None, "a b c"), (1, None), (1, None), (2, ""), (3, "x " * 30_000), (3, "x " * 30_000), (4, "mail a.b@c.example.com")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name, stage in cp.STAGES:
        got = stage(spark, docs, SF)
        assert got.count() >= 4, name
        assert got.columns[:2] == ["doc_id", "text"] and (name == "sentencepiece" or got.columns == docs.columns)
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_clashing_names(spark):
    names = ["score", "row", "spans", "moved", "n_entities", "kinds", "ids", "decoded", "n_tokens", "__text", "id", "label", "class_id", "kept"]
    rows = [(k, f"some text {k} of a few words, mail a{k}@b.example.com", *[str(k)] * len(names)) for k in (1, 2, 3, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    for name, stage in cp.STAGES:
        got = stage(spark, docs, SF)
        made = {"ids", "n_tokens", "decoded"} if name == "sentencepiece" else set()
        assert got.count() >= 2 and set(got.columns) >= set(docs.columns) - made, name
        assert all(r[n] == str(r.doc_id) for r in got.collect() for n in names if n not in made), name


def test_repeated_ids_are_rows_of_their_own(spark):
    long = " ".join(f"w{k}" for k in range(80))
    rows = [(5, long), (5, "quite another text with words of its own"), (6, long + " x"), (None, long), (None, "nothing like the others in any way")]
    got = cp.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == sorted([(5, long), (5, rows[1][1]), (0, rows[4][1])])
