"""Counters kept by changes and the index by revision, against full recounts and full builds."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from webstrata.operators import history as H
from webstrata.operators import refresh as RF
from webstrata.storage import complete_numbers
from webstrata.streaming import counters, jobs

SCHEMA = "id long, sequence long, gone boolean, state string, kind string"


def recount(changes):
    last = {}
    for row in changes:
        if row[0] is not None and row[1] is not None and row[2] is not None and (row[0] not in last or row[1] > last[row[0]][1]):
            last[row[0]] = row
    return dict(collections.Counter(r[3:] for r in last.values() if not r[2]))


def test_counters_equal_recount_after_every_batch(spark, tmp_path):
    rng, done, n = random.Random(130), [], 0
    for batch in range(4):
        rows = []
        for _ in range(150):
            n += 1
            rows.append((rng.randint(0, 40), max(0, n + rng.randint(-60, 60)) * 1000 + n, rng.random() < 0.2, rng.choice(["pending", "done", None]), rng.choice("ab")))
        rows += [rng.choice(done) for _ in range(20) if done] + [(None, 1, False, "x", "y"), (1, None, False, "x", "y")]  # repeated, and incomplete
        rng.shuffle(rows)
        spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
        done += rows
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        kept = counters.keep_counters(stream, str(tmp_path), "id", "sequence", "gone", ["state", "kind"])
        assert {(r.state, r.kind): r.n for r in kept.collect()} == recount(done)
    assert counters.counters(spark, f"{tmp_path}/none", ["state"]).count() == 0


def test_counters_need_no_function_by_row(spark, tmp_path):
    rows = [(k, 1, False, "x", "y") for k in range(500)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/in")
    kept = counters.keep_counters(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), str(tmp_path), "id", "sequence", "gone", ["state", "kind"])
    assert [(r.state, r.kind, r.n) for r in kept.collect()] == [("x", "y", 500)]
    assert not (tmp_path / "checkpoint" / "state").exists()  # a state by row is read and written by a call for each


def test_repeated_batch_changes_nothing(spark, tmp_path):
    write = counters.counted_each_batch(str(tmp_path), ["k"])
    batch = lambda *rows: spark.createDataFrame(rows, "k string, delta int")
    write(batch(("a", 1), ("a", 1), ("b", 1)), 0)
    for _ in range(2):
        write(batch(("a", -1), ("b", -1), ("c", 1)), 1)
        assert {r.k: r.n for r in counters.counters(spark, str(tmp_path), ["k"]).collect()} == {"a": 1, "c": 1}


def test_retry_schedule_over_batches_in_any_order(spark, tmp_path):
    rng = random.Random(4)
    events = [(rng.randint(0, 4), k, rng.choice(["error", "error", "view"]), rng.randint(1, 10**6)) for k in range(120)]
    mixed = rng.sample(events, len(events))
    for k in range(4):
        rows = spark.createDataFrame(mixed[30 * k : 30 * k + 30], "user_id long, event_id long, event_type string, at long")
        rows.select("user_id", "event_id", "event_type", F.timestamp_seconds("at").alias("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("user_id long, event_id long, event_type string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = {r.user_id: r.attempts for r in jobs.run_to_end(jobs.retry_schedule(stream), f"{tmp_path}/out", "update", ["user_id"]).collect() if r.attempts}
    want = {}
    for user in {e[0] for e in events}:
        own = sorted((e for e in events if e[0] == user), key=lambda e: (e[3], e[1]))
        n = next((k for k, e in enumerate(reversed(own)) if e[2] != "error"), len(own))
        if n:
            want[user] = n
    assert got == want


def base_text(k):
    rng = random.Random(k)
    return " ".join(f"w{rng.randint(0, 500)}" for _ in range(80))


def build(rows):
    texts = [(i, rev, base_text(t) + extra if t is not None else extra) for i, (rev, t, extra) in rows.items()]
    return [*texts, (None, 1, "no id")]


@pytest.mark.parametrize("most_parts", [8, 1])
def test_index_refresh_equals_full_build(spark, tmp_path, most_parts):
    rng = random.Random(3)
    rows = {k: (1, k // 3, f" x{k % 3}") for k in range(60)} | {60: (1, None, ""), 61: (1, None, None)}
    frame = lambda: spark.createDataFrame(build(rows), "doc_id long, revision long, text string")

    def check(summary, **want):
        assert summary == want
        full = H.fingerprints(frame().where("doc_id is not null"), "doc_id", "text")
        prints = {r.id: (r.exact_key, r.value) for r in full.collect()}
        index = RF.index_rows(spark, str(tmp_path)).collect()
        assert {r.id: r.revision for r in index} == {k: v[0] for k, v in rows.items()} and len(index) == len(rows)
        assert {r.id: (r.exact_key, r.value) for r in index if r.value is not None} == prints
        labels = {r.id: r.label for r in RF.group_labels(spark, str(tmp_path)).collect()}
        assert labels == {r.id: r.label for r in H.smallest_labels(H.near_links(full)).collect()}
        assert labels

    run = lambda: RF.refresh(frame(), str(tmp_path), most_parts=most_parts)
    check(run(), changed=62, unchanged=0, removed=0)
    for turn in range(3):
        for k in rng.sample(sorted(rows), 3):
            rows[k] = (rows[k][0] + 1, rng.randint(0, 19), f" y{turn}")
        for k in rng.sample(sorted(rows), 2):
            del rows[k]
        rows[100 + turn] = (1, rng.randint(0, 19), " new")
        before = {r.id: r.revision for r in RF.index_rows(spark, str(tmp_path)).collect()}
        changed = sum(before.get(k) != v[0] for k, v in rows.items())
        check(run(), changed=changed, unchanged=len(rows) - changed, removed=len(before.keys() - rows.keys()))
        if most_parts > 1:
            assert spark.read.parquet(f"{tmp_path}/part={turn + 1}/index").count() <= 8
    n = len(complete_numbers(spark, str(tmp_path), "manifest"))
    check(run(), changed=0, unchanged=len(rows), removed=0)
    assert len(complete_numbers(spark, str(tmp_path), "manifest")) == n and len(RF.parts(spark, str(tmp_path))) <= most_parts


def test_readers_keep_the_last_generation(spark, tmp_path, monkeypatch):
    docs = lambda n: spark.createDataFrame([(k, 1, base_text(k)) for k in range(n)], "doc_id long, revision long, text string")
    RF.refresh(docs(5), str(tmp_path))
    with monkeypatch.context() as m:
        m.setattr(RF, "smallest_labels", lambda links: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            RF.refresh(docs(9), str(tmp_path))
    assert RF.index_rows(spark, str(tmp_path)).count() == 5
    assert RF.refresh(docs(9), str(tmp_path), recipe="another") == {"changed": 9, "unchanged": 0, "removed": 0}
    assert RF.index_rows(spark, str(tmp_path)).count() == 9 and RF.refresh(docs(9).limit(0), str(tmp_path), recipe="another")["removed"] == 9
