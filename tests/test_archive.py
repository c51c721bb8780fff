"""Saved scans, hits, retries, reports and merges on small tables: edges, ties, empty tables and equal plans on both sides of a choice."""

import base64
import datetime
import hashlib

import pytest
from pyspark.sql import functions as F

from webstrata.functions import text as T
from webstrata.operators import acquisition as A
from webstrata.operators import analysis as AN
from webstrata.operators import history as H
from webstrata.operators import hits as HL
from webstrata.operators import keyword_scan as K
from webstrata.operators import merging as G
from webstrata.operators import reports as R
from webstrata.operators import retries as RT
from webstrata.operators import saved_scan as SC
from webstrata.streaming import jobs

RULES = K.parse_rules(["high: cat", "exclude: dog"])
CAPTURES = "capture_id int, url string, mimetype string, path string, sha256 string"


def test_scan_saved(spark):
    rows = [(1, "http://a/x.txt", "text/plain", "p1", None), (2, "http://a/y", "text/html", "p2", "0" * 64), (3, "http://a/z", None, "p3", None), (4, None, None, "p4", None)]
    files = [("p1", b"cat <b>cat</b>"), ("p2", b"cat"), ("p4", b"")]
    out = {r.capture_id: r for r in SC.scan_saved(spark.createDataFrame(rows, CAPTURES), spark.createDataFrame(files, "path string, content binary"), RULES).collect()}
    assert out[1].body == "cat <b>cat</b>" and out[1].title == "" and out[1].score > 0 and out[1].state == "downloaded"  # plain text stays verbatim
    assert out[2].problem == "local_integrity_failure" and out[2].score is None and out[2].retryable and out[3].problem == "missing_local_file"
    assert out[4].problem is None and out[4].score == 0


def test_scan_of_empty_tables(spark):
    assert SC.scan_saved(spark.createDataFrame([], CAPTURES), spark.createDataFrame([], "path string, content binary"), RULES, reject_shells=True).count() == 0


@pytest.mark.parametrize(
    "text,kind",
    [
        ("<h2>This URL has been <i>excluded</i> from the Wayback Machine</h2>", "wayback_excluded"), ("<title>Internet Archive</title> robots: not saved because of robots.txt", "robots_blocked"),
        ("  \n Not in Archive\nrest", "missing_capture"), ("story: not in archive", None), ("<p>not in archive</p>", None), ("", None), (None, None), ("x" * 30_000 + "<h1>not in archive</h1>", None),
    ],
)
def test_shells(spark, text, kind):
    assert SC.with_shell(spark.createDataFrame([(text,)], "t string"), "t").first().shell == kind


def test_phrases_and_field_hits(spark):
    lines = spark.createDataFrame([(3, "Two  words"), (1, "two_words"), (2, " "), (4, "# no"), (5, "x"), (6, None)], "n int, p string")
    assert {tuple(r) for r in HL.phrase_list(lines, "n", "p").collect()} == {(1, "two_words"), (5, "x")}
    docs = spark.createDataFrame([(1, "xx", "x"), (2, None, "xyx"), (3, "", None)], "id int, url string, text string")
    phrases = spark.createDataFrame([(7, "x"), (8, "xx")], "k int, p string")
    got = {(r.id, r.k): (r.fields, r.counts) for r in HL.field_hits(docs, phrases, {"url": "url", "source": "text"}, id_col="id", phrase_id="k", phrase="p").collect()}
    assert got == {(1, 7): (["url", "source"], [2, 1]), (1, 8): (["url"], [1]), (2, 7): (["source"], [2])}


def test_spans_against_all_places(spark):
    text, literals = "abababa cab", ["aba", "ab", "c", "ab"]
    row = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(HL.spans(F.col("t"), literals).alias("s"), HL.spans(F.col("t"), literals, overlapping=False).alias("o")).collect()
    every = sorted((k, k + len(x), x) for x in set(literals) for k in range(len(text)) if text.startswith(x, k))
    assert [(s.start, s.end, s.literal) for s in row[0].s] == every and row[1].s == row[2].o == []
    assert [(s.start, s.literal) for s in row[0].o] == [(0, "ab"), (2, "ab"), (4, "ab"), (8, "c"), (9, "ab")]


def test_window_snippet(spark):
    one = lambda text, words, n=12: spark.createDataFrame([(text,)], "t string").select(HL.window_snippet("t", words, limit=n).alias("s")).first().s
    assert one("a  b", ["zzz"]) == "a b" and one("", ["abc"]) == "" and one("x" * 20 + " CAT here", ["cat"]) == "…xxx CAT here" and one("y" * 20, ["of"]) == "y" * 12 + "…"


def test_retry_after_and_failures(spark):
    now = F.lit(datetime.datetime(2024, 1, 1))
    rows = spark.createDataFrame([("5",), ("Mon, 01 Jan 2024 00:01:00 GMT",), ("Sun, 06 Nov 1994 08:49:37 GMT",), ("soon",), (None,), ("-3",)], "v string")
    assert [r.s for r in rows.select(RT.retry_after(F.col("v"), now).alias("s")).collect()] == [5.0, 60.0, 0.0, None, None, None]
    kinds = spark.createDataFrame([(None,), ("",), ("HTTP 408",), ("invalid_media_range: x",)], "m string").select(RT.failure_kind(F.col("m")).alias("k")).collect()
    assert [(r.k.category, r.k.retryable) for r in kinds] == [("local_processing_error", False)] * 2 + [("http_client_error", True), ("invalid_media_representation", False)]
    ends = spark.createDataFrame([("failed_size_limit:3",), ("failed_nonretryable:robots_blocked",), (None,), ("queue",)], "r string")
    assert [tuple(r) for r in ends.select(RT.may_retry(F.col("r")), RT.may_retry_by_hand(F.col("r"))).collect()] == [(False, True), (False, False), (True, True), (True, True)]


def test_reports(spark):
    rows = [(k, f"u{k % 3}", str(k % 2), k % 4, False, False) for k in range(20)]
    m = spark.createDataFrame(rows, "doc_id int, url string, timestamp string, score int, excluded boolean, required_missing boolean")
    want = [r[0] for r in sorted((r for r in rows if r[3] >= 1), key=lambda r: (-r[3], r[2], r[0]))]
    full = sorted(R.ranked_matches(m).collect(), key=lambda r: r.rank)
    assert [r.doc_id for r in full] == want and [r.rank for r in full] == list(range(1, len(want) + 1))
    assert [r.doc_id for r in sorted(R.ranked_matches(m, top=5).collect(), key=lambda r: r.rank)] == want[:5]
    for order, key in (("newest", lambda r: (r[2], r[0])), ("url", lambda r: (r[1], r[2], r[0]))):
        seen = list(dict.fromkeys(r[1] for r in sorted(rows, key=key, reverse=order == "newest")))
        assert [r.value for r in R.first_seen(m, F.col("url"), order).collect()] == seen


def test_merges_twice_are_merges_once(spark):
    own = spark.createDataFrame([(1, "a"), (2, "b")], "id int, url string")
    other = spark.createDataFrame([(1, "b"), (5, "c")], "id int, url string")
    merged, moved = G.merged_captures(own, other, ["url"], "id")
    assert sorted(map(tuple, merged.collect())) == [(1, "a"), (2, "b"), (7, "c")] and sorted(map(tuple, moved.collect())) == [(1, 2), (5, 7)]
    again, moved_again = G.merged_captures(merged, other, ["url"], "id")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, merged.collect())) and sorted(map(tuple, moved_again.collect())) == sorted(map(tuple, moved.collect()))
    empty = spark.createDataFrame([], "id int, url string")
    assert G.merged_captures(empty, other, ["url"], "id")[0].count() == 2 and G.merged_captures(own, empty, ["url"], "id")[0].count() == 2


def test_grounded_claims(spark):
    claims = spark.createDataFrame([(1, 1, ["a", "b"], 2.0), (1, 2, ["a", "z"], 0.5), (2, 3, ["a"], 0.5), (1, 4, [], 0.5)], "g int, claim_id int, support array<string>, confidence double")
    evidence = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "b")], "g int, id string")
    assert [(r.claim_id, r.confidence) for r in G.grounded(claims, evidence, "g").collect()] == [(1, 1.0)]


def test_hosts():
    assert T.canonical("http://A.b:80/") == "a.b" and T.canonical("[::1]") == T.canonical("1.2.3.4") == T.canonical(None) == T.canonical("x y.z") == T.canonical("a" * 300 + ".b") == ""


def test_near_links_lose_none(spark):
    """All pairs that share a band and agree in enough bits, by brute force over fingerprints a few bits apart."""
    import random

    rnd = random.Random(3)
    base = [rnd.getrandbits(64) for _ in range(12)]
    values = {k: base[k % 12] ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 6))) for k in range(240)}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    got = H.near_links(spark.createDataFrame([(k, str(k), signed(v)) for k, v in values.items()], "id int, exact_key string, value long"), 0.9).collect()
    first = {}
    for k in sorted(values):
        first.setdefault(values[k], k)
    nodes = sorted(first.values())
    band = lambda v, k: v >> 16 * k & 0xFFFF
    want = {(a, b) for a in nodes for b in nodes if a < b and 1 - bin(values[a] ^ values[b]).count("1") / 64 >= 0.9 and any(band(values[a], k) == band(values[b], k) for k in range(4))}
    assert {(r.a, r.b) for r in got if r.a in nodes and r.b in nodes} == want


def test_searched_domains_defers_nulls_and_strangers(spark):
    pages = spark.createDataFrame([("a.example", 200, None), ("b.example", 200, None), ("c.example", 200, "key"), ("d.example", None, None), ("e.example", 200, None)], "domain string, http_status int, resume string")
    rows = [("a.example", "http://x.a.example./p", "20200101000000", "200"), ("a.example", "http://a.example/q", "20190101000000", "200"), ("b.example", None, "20200101000000", "200"),
            ("c.example", "http://a.example/q", "20180101000000", "200"), ("d.example", "http://d.example/", "20200101000000", "200")]
    states, urls = A.searched_domains(pages, spark.createDataFrame(rows, "domain string, url string, timestamp string, status string"), "2000", "2030", 100)
    assert {r.domain: r.state for r in states.collect()} == {"a.example": "searched", "b.example": "deferred", "c.example": "deferred", "d.example": "deferred", "e.example": "searched"}
    assert {(r.url, r.timestamp) for r in urls.collect()} == {("http://x.a.example./p", "20200101000000"), ("http://a.example/q", "20190101000000")}


def test_adopted_keeps_captures_that_collide(spark):
    captures = spark.createDataFrame([(1, "u", "20200101000000", "old"), (1, "u", "20200101000000", "now"), (1, "v", "20200101000000", "old"), (1, "v", "20210101000000", "old"), (1, "v", "20200101000000", "older")], "target int, url string, timestamp string, signature string")
    coverage = spark.createDataFrame([(1, "old", "20200101000000", "20201231235959"), (1, "older", "20200101000000", "20201231235959")], "target int, signature string, start string, end string")
    moved, covered = A.adopted(captures, coverage, "now", ["old", "older"], "19000101000000", "20991231235959")
    assert sorted((r.url, r.timestamp[:4], r.signature) for r in moved.collect()) == [("u", "2020", "now"), ("u", "2020", "old"), ("v", "2020", "now"), ("v", "2020", "older"), ("v", "2021", "old")]
    assert sorted(r.signature for r in covered.collect()) == ["now", "old", "older"]


def test_base32_and_names(spark):
    texts = ["", "a", "é" * 500]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", A.base32_sha1(F.col("t").cast("binary")).alias("d"), A.file_name(F.concat(F.lit("con/"), "t"), F.lit(None).cast("string"), F.lit(7)).alias("n")).collect()
    assert [r.d for r in got] == [base64.b32encode(hashlib.sha1(r.t.encode()).digest()).decode() for r in got]
    assert all(len(r.n) <= A.NAME_LENGTH and r.n.endswith(".txt") and "/" not in r.n for r in got)
    empty = spark.createDataFrame([], "user int, page long, cursor string")
    assert A.cycling_cursors(empty, "user", "page", "cursor").count() == 0


def test_retry_schedule_over_two_batches(spark, tmp_path):
    schema = "event_id long, user_id long, event_type string, ts timestamp"
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    batches = [[(1, 0, "error", at(0)), (2, 1, "error", at(0))], [(3, 0, "view", at(1)), (4, 1, "error", at(2)), (5, 2, "view", at(3))]]
    for rows in batches:
        frame = spark.createDataFrame(rows, schema)
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.retry_schedule(jobs.event_stream(spark, str(tmp_path / "in"), frame.schema, ""))
        out = jobs.run_to_end(stream, str(tmp_path / "out"), "update", ["user_id"])
    assert {r.user_id: r.attempts for r in out.collect()} == {0: 0, 1: 2}  # a cleared user takes the place of its old row


def test_changed_equals_that_of_similarity(spark):
    texts = [None, "", "a", "a", "b", "x" * 300_000, "x" * 300_000 + "y", "x" * 300_000 + "y"]
    pairs = H.snapshot_pairs(spark.createDataFrame([("u", i, t) for i, t in enumerate(texts)], "url string, doc_id long, text string"), "url", "doc_id", "text").cache()
    assert sorted((r.later, r.changed) for r in H.with_changed(pairs).collect()) == sorted((r.later, r.changed) for r in H.with_similarity(pairs).collect())


def test_manifest_of_complete_and_of_empty_collections(spark):
    def complete(captures, coverage, operations):
        of = lambda rows, schema: spark.createDataFrame(rows, schema)
        states = of([(s,) for s in captures], "state string")
        return AN.manifest(states, states.limit(0), states, of([(c,) for c in coverage], "complete boolean"), of(operations, "sequence int, mode string, status string")).first().complete

    done = [(1, "scan", "failed"), (2, "scan", "complete")]
    assert complete(["downloaded", None], [True], done)
    assert not complete(["pending"], [True], done) and not complete(["downloaded"], [None], done) and not complete(["downloaded"], [], done)
    assert not complete(["downloaded"], [True], []) and not complete(["downloaded"], [True], [(1, "report", "complete")])
