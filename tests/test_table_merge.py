"""Merges of collections: identities along foreign keys, twice is once, conflicts before anything is written."""

import pytest
from pyspark.sql import functions as F

from webstrata.operators import table_merge as TM
from webstrata.storage import complete_numbers

TABLES = [TM.Table("notes", ("doc_id", "text"), refs={"doc_id": "docs"}), TM.Table("docs", ("url", "day"), "doc_id", {"site_id": "sites"}, "digest"), TM.Table("sites", ("host",), "site_id")]


def collection(spark, sites, docs, notes):
    return {
        "sites": spark.createDataFrame(sites, "site_id long, host string"), "docs": spark.createDataFrame(docs, "doc_id long, url string, day string, site_id long, digest string, title string"),
        "notes": spark.createDataFrame(notes, "doc_id long, text string"),
    }


OWN = ([(1, "a"), (2, "b")], [(1, "u1", "d", 1, "x", "own"), (2, "u2", None, 2, None, "own"), (3, "u3", "d", None, "z", "own")], [(1, "n1"), (2, "n2")])
OTHER = ([(7, "b"), (8, "c"), (9, "c")], [(1, "u1", "d", 7, "x", "other"), (2, "u2", None, 8, "y", "other"), (5, "u5", "d", 9, "q", "other"), (6, "u5", "d", 8, "q", "again"), (4, "u4", "d", None, None, "other")], [(1, "n1"), (1, "m1"), (5, "m5"), (6, "m5"), (2, "n2"), (2, "n2")])


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_identities_follow_foreign_keys(spark, tmp_path):
    own, other = collection(spark, *OWN), collection(spark, *OTHER)
    once = {n: rows(f) for n, f in TM.merge(own, other, TABLES, str(tmp_path)).items()}
    assert sorted(once["sites"]) == [(1, "a"), (2, "b"), (10, "c")]
    assert once["docs"] == sorted([*OWN[1], (8, "u5", "d", 10, "q", "other"), (7, "u4", "d", None, None, "other")], key=str)
    assert once["notes"] == sorted([(1, "n1"), (2, "n2"), (1, "m1"), (8, "m5")], key=str)
    twice = TM.merge(TM.current(spark, str(tmp_path)), other, TABLES, str(tmp_path))
    assert {n: rows(f) for n, f in twice.items()} == once and complete_numbers(spark, str(tmp_path), "manifest") == [0, 1]


def test_conflicts_stop_everything(spark, tmp_path):
    own, other = collection(spark, *OWN), collection(spark, *OTHER)
    other["docs"] = other["docs"].withColumn("digest", F.when(F.col("url") == "u1", "changed").otherwise(F.col("digest")))
    other["notes"] = other["notes"].unionByName(spark.createDataFrame([(99, "lost")], "doc_id long, text string"))
    with pytest.raises(TM.MergeConflict, match="2 conflicts") as e:
        TM.merge(own, other, TABLES, str(tmp_path))
    found = {(r.table, r.own, r.other) for r in e.value.rows.collect()}
    assert found == {("docs", "x", "changed"), ("notes", None, "no row of docs: 99")}
    assert not list(tmp_path.iterdir()) and TM.current(spark, str(tmp_path)) == {}


def test_tables_come_in_order():
    assert [t.name for t in TM.in_order(TABLES)] == ["sites", "docs", "notes"]
    with pytest.raises(ValueError, match="cycle"):
        TM.in_order([TM.Table("a", ("k",), "id", {"b": "b"}), TM.Table("b", ("k",), "id", {"a": "a"})])
