"""Timers, the resumable index source and cut windows: restarts, rows in any order, ranges covered."""

import json
import random

import pytest
from pyspark.sql import functions as F

from webstrata.operators import windows as W
from webstrata.plans import collection
from webstrata.sources import cdx
from webstrata.streaming import index_source, jobs, timers

HOUR = 3_600_000_000


def brute_timers(events, base, most, limit, seconds):
    """events: (user, micros, number, failed). Rows (user, kind, attempts, at) over all time."""
    out = []
    for user in {e[0] for e in events}:
        own = sorted(e[1:] for e in events if e[0] == user)
        attempts, first, ended = 0, None, False
        for k, (at, _, failed) in enumerate(own):
            if not failed:
                attempts, first, ended = 0, None, False
                continue
            if ended:
                continue
            attempts, first = attempts + 1, at if first is None else first
            stop = first + int(seconds * 1e6)
            if attempts >= limit or at >= stop:
                ended = True
                out.append((user, "end", attempts, at))
                continue
            due = at + timers.delay_micros(user, attempts, base, most)
            nxt = own[k + 1][0] if k + 1 < len(own) else float("inf")
            if min(due, stop) < nxt:
                ended = due >= stop
                out.append((user, "end" if ended else "attempt", attempts, min(due, stop)))
    return sorted(out)


@pytest.mark.parametrize("files", [1, 7])
def test_timers_over_files(spark, tmp_path, files):
    """Files in order of time with rows of neighbouring files mixed up, one batch each; or one file in any order."""
    rng = random.Random(files)
    events = [(rng.randint(0, 5), rng.randint(0, 200) * HOUR // 4 + 1_700_000_000_000_000, k, rng.random() < 0.6) for k in range(150)]
    schema = "user_id long, at long, event_id long, event_type string"
    mixed = sorted(events, key=lambda e: e[1] + rng.random() * 6 * HOUR)
    size = -(-len(events) // files)
    closing = [(None, 1_800_000_000_000_000, -1, None)]
    for k, rows in enumerate([*(mixed[i : i + size] for i in range(0, len(mixed), size)), closing]):
        made = [(u, t, n, None if f is None else "error" if f else "ok") for u, t, n, f in rows]
        spark.createDataFrame(made, schema).select("user_id", F.timestamp_micros("at").alias("ts"), "event_id", "event_type").coalesce(1).write.parquet(f"{tmp_path}/in/{k:03}")
    schema = "user_id long, ts timestamp, event_id long, event_type string"
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    with timers.rocksdb_state(spark):
        out = jobs.run_to_end(timers.retry_timers(reader, late="1 day", base=3 * 3600, most=10 * 3600, limit=3, seconds=9 * 3600), str(tmp_path / "out"), "append")
    got = sorted((r.capture_id, r.kind, r.attempts, r.at) for r in out.select("capture_id", "kind", "attempts", F.unix_micros("at").alias("at")).collect())
    assert got == brute_timers(events, 3 * 3600, 10 * 3600, 3, 9 * 3600)
    assert {g[1] for g in got} == {"attempt", "end"}


def test_timers_of_many_captures_share_state(spark, tmp_path):
    """Over five batches 400 captures (null, 0 and very large ids too) have at most a timer and three state entries for each group."""
    rng = random.Random(20)
    big = 2**53 + 1
    users = [None, 0, big, big + 1, -5, *range(1, 396)]
    events = [(rng.choice(users[:5]) if k % 9 == 0 else users[k % 400], rng.randint(0, 300) * HOUR // 4 + 1_700_000_000_000_000, k, rng.random() < 0.7) for k in range(2800)]
    mixed = sorted(events, key=lambda e: e[1] + rng.random() * 20 * HOUR)
    schema = "user_id long, at long, event_id long, event_type string"
    for k, rows in enumerate([*(mixed[i : i + 700] for i in range(0, 2800, 700)), [(None, 1_800_000_000_000_000, -1, None)]]):
        made = [(u, t, n, None if f is None else "error" if f else "ok") for u, t, n, f in rows]
        spark.createDataFrame(made, schema).select("user_id", F.timestamp_micros("at").alias("ts"), "event_id", "event_type").coalesce(1).write.parquet(f"{tmp_path}/in/{k:03}")
    schema = "user_id long, ts timestamp, event_id long, event_type string"
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    with timers.rocksdb_state(spark):
        out = timers.retry_timers(reader, late="1 day", base=3 * 3600, most=10 * 3600, limit=3, seconds=9 * 3600, groups=6)
        write = lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{tmp_path}/rows/generation={epoch}")
        running = out.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        running.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/rows").select("capture_id", "kind", "attempts", F.unix_micros("at").alias("at")).collect()
    want = brute_timers([e for e in events if e[0] is not None], 3 * 3600, 10 * 3600, 3, 9 * 3600)
    want += [(None, *r[1:]) for r in brute_timers([(0, *e[1:]) for e in events if e[0] is None], 3 * 3600, 10 * 3600, 3, 9 * 3600)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert {None, 0, big, big + 1} <= {r.capture_id for r in got}
    kept = [p.stateOperators[0] for p in running.recentProgress]
    assert 0 < max(o.customMetrics["numRegisteredTimers"] for o in kept) <= 2 * 7  # set on input, and again when it has fired
    assert max(o.numRowsTotal for o in kept) <= 7 * (4 * 2 + 3)  # for each group: a part of what waits for each batch still within the delay, its place, and the other entries


def test_timers_after_a_pause(spark, tmp_path):
    """A group whose timers have all fired, with nothing left in its state, takes up the next events."""
    start = 1_700_000_000_000_000
    events = [(1, start, 0, "ok"), (None, start + 72 * HOUR, 1, None), (1, start + 80 * HOUR, 2, "error"), (None, start + 1000 * HOUR, 3, None)]
    for k, row in enumerate(events):
        made = spark.createDataFrame([row], "user_id long, at long, event_id long, event_type string")
        made.select("user_id", F.timestamp_micros("at").alias("ts"), "event_id", "event_type").coalesce(1).write.parquet(f"{tmp_path}/in/{k:03}")
    schema = "user_id long, ts timestamp, event_id long, event_type string"
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    with timers.rocksdb_state(spark):
        out = jobs.run_to_end(timers.retry_timers(reader, late="1 day", base=3600, most=3600, limit=3, seconds=9 * 3600), str(tmp_path / "out"), "append")
    got = [tuple(r) for r in out.select("capture_id", "kind", "attempts", F.unix_micros("at").alias("at")).collect()]
    assert got == [(1, "attempt", 1, start + 80 * HOUR + timers.delay_micros(1, 1, 3600, 3600))]


def test_index_source_restarts(spark, tmp_path):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    collection.written_index(spark, orders.where("year(o_orderdate) < 1997"), f"{tmp_path}/pages", 500)
    seen = []

    def failing(batch, epoch):
        seen.append(epoch)
        batch.write.mode("overwrite").parquet(f"{tmp_path}/rows/generation={epoch}")
        if len(seen) == 2:
            raise RuntimeError("killed after its rows were written")

    stream = index_source.index_stream(spark, f"{tmp_path}/pages", 2)
    running = stream.writeStream.foreachBatch(failing).option("checkpointLocation", f"{tmp_path}/checkpoint").start()
    with pytest.raises(Exception, match="killed"):
        running.processAllAvailable()
    running.stop()
    assert seen == [0, 1]
    index_source.pages_to_end(index_source.index_stream(spark, f"{tmp_path}/pages", 2), str(tmp_path))
    collection.written_index(spark, orders.where("year(o_orderdate) >= 1997"), f"{tmp_path}/more", 500)
    for folder in (tmp_path / "more").glob("window=*"):
        folder.rename(tmp_path / "pages" / folder.name)  # windows that come later
    out = index_source.pages_to_end(index_source.index_stream(spark, f"{tmp_path}/pages", 2), str(tmp_path))
    pages = [(r.window, r.page) for r in out.collect()]
    assert len(pages) == len(set(pages)) == len(list((tmp_path / "pages").glob("window=*/key=*")))
    rows = cdx.rows_of(cdx.parse_json(out.select(F.concat_ws("/", "window", "page").alias("page"), "value")), ("timestamp", "original"))
    assert sorted(r.original for r in rows.collect()) == sorted(f"http://a.example/{r.o_orderkey}" for r in orders.collect())


def test_index_source_says_what_is_missing(tmp_path):
    (tmp_path / "window=a" / "key=start").mkdir(parents=True)
    with pytest.raises(ValueError, match="0 pages for window a"):
        index_source.IndexReader(str(tmp_path), 1).latestOffset()
    assert index_source.next_key('[["h"], ["r"], [], ["k"]]') == "k" and index_source.next_key('[["h"], ["r"]]') is None and index_source.next_key("[]") is None


@pytest.mark.parametrize("cut", [W.split_until_fit, W.bisect_until_fit])
def test_windows_fit_and_cover(spark, cut):
    rng = random.Random(2)
    ranges = spark.createDataFrame([("a", "20000101000000", "20041231235959", 900), ("b", "20000101000000", "20000101000001", 150), ("c", "20000101000000", "20000601000000", 100)], "k string, low string, high string, page_size int")
    times = [("a", f"2003{rng.randint(1, 2):02}{rng.randint(1, 28):02}{rng.randint(0, 23):02}0000") for _ in range(300)] + [("a", "20020505050505")] * 40 + [("b", "20000101000000")] * 9 + [("z", "20000101000000"), (None, "20000101000000"), ("a", "19990101000000")]
    got = cut(ranges, spark.createDataFrame(times, "k string, at string"), ["k"], "low", "high", "at", 5)
    rows = {}
    for r in got.select("k", W.seconds(F.col("start")).alias("s"), W.seconds(F.col("end")).alias("e"), "start", "end", "page_size", "depth", "n").orderBy("k", "s").collect():
        rows.setdefault(r.k, []).append(r)
    for k, low, high, size in ranges.collect():
        own = rows[k]
        assert own[0].start == low and own[-1].end == high and all(x.e + 1 == y.s for x, y in zip(own, own[1:], strict=False))
        for r in own:
            assert r.n == sum(1 for t in times if t[0] == k and r.start <= t[1] <= r.end)
            if cut is W.split_until_fit:
                assert r.n <= 5 or r.e - r.s < 2
                assert r.page_size == max(100, size >> r.depth)
            else:
                assert r.n <= 5 or r.depth == W.HALVINGS or r.e - r.s < W.HALVED
    assert max(r.depth for r in rows["a"]) >= 5


def brute_rejoined(rows):
    """rows: (start, end, free, state) in order, as seconds."""
    out, i = [], 0
    while i < len(rows):
        j = i
        small = lambda r: r[2] and r[1] - r[0] <= 5
        if small(rows[i]):
            while j + 1 < len(rows) and small(rows[j + 1]) and rows[j + 1][0] == rows[j][1] + 1 and rows[j + 1][3] == rows[i][3] and rows[j + 1][1] - rows[i][0] <= 3600:
                j += 1
        if j - i + 1 >= 8:
            out.append((rows[i][0], rows[j][1]))
            i = j + 1
        else:
            out.append(rows[i][:2])
            i += 1
    return out


def test_micro_windows_any_state(spark):
    rng = random.Random(9)
    rows, at = [], 1_000_000_000
    for _ in range(4000):
        width = rng.choice([0, 2, 4, 5]) if rng.random() < 0.995 else 40
        rows.append((at, at + width, rng.random() < 0.99, "x" if rng.random() < 0.998 else "y"))
        at += width + (1 if rng.random() < 0.998 else 7)
    frame = spark.createDataFrame([("k", *r) for r in rows], "k string, a long, b long, free boolean, s string").repartition(5)
    frame = frame.select("k", W.stamp(F.col("a")).alias("a"), W.stamp(F.col("b")).alias("b"), "free", "s")
    got = W.joined_micro(frame, ["k"], "a", "b", untouched=F.col("free"), state=["s"])
    got = sorted((r.a, r.b) for r in got.select(W.seconds(F.col("a")).alias("a"), W.seconds(F.col("b")).alias("b")).collect())
    want = brute_rejoined(rows)
    assert got == want and len(want) < 3000


def test_pages_hold_the_rows_they_are_asked_to_hold(spark, tmp_path, monkeypatch):
    """Keys of all windows lie in one range; a page still has its rows, and of all but last pages only the end is read."""
    orders = spark.range(2000).selectExpr("id AS o_orderkey", "make_date(cast(1990 + id % 10 AS int), 1, 2) AS o_orderdate")
    collection.written_index(spark, orders, f"{tmp_path}/pages", 100, full=True)
    index = index_source._Index(f"{tmp_path}/pages")
    assert index.windows() == [str(1990 + k) for k in range(10)]
    monkeypatch.setattr(index_source, "TAIL", 64)
    whole = index.page
    for window in index.windows():
        key, sizes, read = index_source.FIRST, [], []
        while key is not None:
            rows = index_source.json.loads(whole(window, key))
            sizes.append(len(rows) - 1 - (2 if rows[-2] == [] else 0))
            monkeypatch.setattr(index, "page", lambda w, k: read.append(k) or whole(w, k))
            key = index.after(window, key)
        assert sizes == [100, 100] and len(read) == 1
    odd = json.dumps([["h"], ["a],[],[\"x\"]]"], [], ["ké\"y\\"]], ensure_ascii=False)
    assert index_source.next_key(odd) == 'ké"y\\' and index_source.next_key(json.dumps([["h"], ['],[],["x"]]']])) is None
