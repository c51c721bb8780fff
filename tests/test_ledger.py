"""Errors, issues, lookups, evidence, routing, redirects, candidates and domain lists against plain loops over small logs."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from webstrata.operators import ledger as L

LOG = "sequence long, at long, operation string, category string, scope string, capture_id long, document_id long, media_id long, message string, http_status int, retryable boolean"


def test_errors_kept_as_one_by_one(spark):
    """A plain table that takes failures and resolutions one by one gives the same rows; one capture has most of the log."""
    rng, rows, marks, table = random.Random(5), [], [], []
    for s in range(600):
        capture = rng.choice([7, 7, 7, 8, None])
        if rng.random() < 0.1:
            marks.append((s, capture))
            for e in table:
                e["resolved"] |= capture is not None and e["key"][3] == capture
            continue
        key = (rng.choice(["scan", "download"]), rng.choice("ab"), rng.choice([None, "x"]), capture, rng.choice([None, 1]), None)
        values = (f"m{s}", rng.choice([None, 404, 500]), rng.random() < 0.5)
        rows.append((s, 10 * s, *key, *values))
        open_ = [e for e in table if e["key"] == key and not e["resolved"]]
        if open_:
            open_[-1].update(n=open_[-1]["n"] + 1, last=10 * s, values=values)
        else:
            table.append({"key": key, "id": s, "n": 1, "first": 10 * s, "last": 10 * s, "values": values, "resolved": False})
    log, done = spark.createDataFrame(rows, LOG), spark.createDataFrame(marks, "sequence long, capture_id long")
    want = {(e["id"], e["key"], e["n"], e["first"], e["last"], e["values"], e["resolved"]) for e in table}
    for block in (1 << 16, 16):  # blocks smaller than a capture's log
        kept = L.errors_kept(log, done, block).collect()
        got = {(r.error_id, tuple(r[c] for c in L.IDENTITY), r.attempt_count, r.first_seen, r.last_seen, (r.message, r.http_status, r.retryable), r.resolved) for r in kept}
        assert got == want
    assert L.errors_kept(log.limit(0), done.limit(0)).count() == 0


def test_site_issue_reopens(spark):
    rows = [(1, 1, " A.com ", "index", "c", None, "t", "one"), (4, 4, "a.com", "index", "c", 0, " ", "x" * 3000), (2, 2, None, "index", "c", 500, None, None)]
    log = spark.createDataFrame(rows, "sequence long, at long, host string, stage string, category string, http_status int, target string, message string")
    closed = spark.createDataFrame([(3, "A.COM", "index", "c", None), (9, "", "index", "c", 500)], "sequence long, host string, stage string, category string, http_status int")
    got = {r.host: r for r in L.site_issues(log, closed).collect()}
    a, u = got["a.com"], got["unknown"]
    assert (a.occurrence_count, a.resolved, a.target, len(a.message), a.first_seen, a.last_seen) == (2, False, "t", 2000, 1, 4) and (u.resolved, u.message, u.http_status) == (True, None, 500)


def test_redirects(spark):
    here, base = "http://www.own.example/a", "https://web.archive.org/web/2001id_/"
    cases = {
        base + "http://www.own.example/b": "allowed", base + "http://x.scope.example/?q=http://z.example": "allowed", base + "http://exact.example": "allowed", base + "http://x.exact.example": "external_redirect_blocked",
        base + "http://WWW.Own.Example:80/": "allowed", base + "http://notscope.example/": "external_redirect_blocked", "https://web.archive.org/save": "allowed", "http://www.own.example/b": "live_redirect_blocked",
        "ftp://web.archive.org/web/1/http://www.own.example": "live_redirect_blocked", "": "live_redirect_blocked", None: "live_redirect_blocked",
    }
    rows = spark.createDataFrame([(here, k) for k in cases], "here string, there string")
    scopes = [("scope.example", True), ("Exact.Example.", False)]
    got = {r.there: r.o for r in rows.select("there", L.redirect_outcome(F.col("here"), F.col("there"), scopes).alias("o")).collect()}
    assert got == cases
    assert {r[0] for r in rows.select(L.redirect_outcome(F.col("here"), F.col("there"), scopes, skip=True)).collect()} == {"redirect_skipped"}
    assert "external_redirect_blocked" not in {r[0] for r in rows.select(L.redirect_outcome(F.col("here"), F.col("there"), scopes, external=True)).collect()}


def test_question_terms_and_candidates(spark):
    words = spark.range(1).select(L.question_terms(F.lit("Find THE pages about cats-and_dogs, 2001 cats CATS ab, which v2x")).alias("t")).first().t
    assert words == ["cats-and_dogs", "cats", "v2x"]
    matches = spark.createDataFrame([(k, k, k % 7) for k in range(40)], "match_id long, document_id long, score int")
    ranked = spark.createDataFrame([(k, float(k % 5)) for k in range(12)], "document_id long, rank_score double")
    got = [(r.position, r.match_id) for r in L.candidates(matches, ranked, least=3, limit=14).orderBy("position").collect()]
    first = sorted(range(12), key=lambda k: (-(k % 5), -(k % 7), k))[:10]
    rest = sorted((k for k in range(40) if k % 7 >= 3 and k not in first), key=lambda k: (-(k % 7), k))[:4]
    assert got == list(enumerate(first + rest, 1))
    assert L.candidates(matches.limit(0), ranked, least=0, limit=5).count() == 0


def test_domains_by_recipe(spark):
    rules, other = (spark.createDataFrame([(x,) for x in v], "suffix string") for v in (["com", "org"], ["org", "com", "net"]))
    assert L.recipe_of(rules) == L.recipe_of(rules.orderBy(F.desc("suffix"))) != L.recipe_of(other)
    inputs = spark.createDataFrame([(1, "a", "x.com"), (2, "b", "y.org z.net"), (3, "c", None)], "capture_id long, digest string, text string")
    none = spark.createDataFrame([], "recipe string, capture_id long, digest string"), spark.createDataFrame([], "recipe string, capture_id long, host string")
    r = L.recipe_of(rules)
    sources, hosts = L.domains_committed(*none, inputs, rules, r)
    assert {(x.capture_id, x.host) for x in hosts.collect()} == {(1, "x.com"), (2, "y.org")}
    kept = hosts.withColumn("host", F.concat(F.lit("kept."), "host"))  # what is unchanged is not read again
    later = inputs.withColumns({"digest": F.when(F.col("capture_id") == 2, "b2").otherwise(F.col("digest")), "text": F.when(F.col("capture_id") == 2, "w.org").otherwise(F.col("text"))})
    sources, hosts = L.domains_committed(sources, kept, later, rules, r)
    lines, status = L.domains_published(sources, hosts, later, r)
    assert {x.line for x in lines.collect()} == {"*.kept.x.com/*", "*.w.org/*"} and tuple(status.first()) == (3, 1, "incomplete")
    assert tuple(L.domains_published(sources, hosts, later, L.recipe_of(other))[1].first()) == (3, 3, "incomplete")


def test_provenance_against_loops(spark):
    rng = random.Random(2)
    groups = [(k % 6, k, "near" if k % 2 else "exact", rng.random()) for k in range(60)]
    captures = [(k, f"u{rng.randrange(9)}", f"{rng.randrange(20):014}") for k in range(60)]
    got = {tuple(r) for r in L.provenance_of_groups(spark.createDataFrame(groups, "group long, id long, method string, similarity double"), spark.createDataFrame(captures, "id long, url string, timestamp string")).collect()}
    want, by_id = set(), {c[0]: c for c in captures}
    for g in range(6):
        own = sorted((r for r in groups if r[0] == g), key=lambda r: (by_id[r[1]][2], r[1]))
        source = by_id[own[0][1]]
        want |= {(source[0], r[1], r[2], r[3], source[2], by_id[r[1]][2]) for r in own[1:] if by_id[r[1]][1] != source[1]}
    assert got == want


def test_lookups_routing_evidence(spark):
    queue = spark.createDataFrame([(1, "s", "pending", 0, None, 1), (2, "s", "pending", 0, None, 0), (3, "s", "odd", 0, None, 0)], "queue_id long, signature string, state string, result_count long, last_error string, lookup_attempts long")
    lookups = spark.createDataFrame([(1, 1, "error", -4, "e" * 3000, None), (0, 1, "indexed", 5, None, False)], "sequence long, queue_id long, state string, result_count long, error string, counted boolean")
    now = L.lookups_marked(queue, lookups)
    one = now.where("queue_id = 1").first()
    assert (one.state, one.result_count, len(one.last_error), one.lookup_attempts) == ("error", 0, 2000, 2)
    assert {tuple(r) for r in L.lookup_counts(now, "s").collect()} == {("pending", 1), ("error", 1), ("indexed", 0), ("unavailable", 0), ("odd", 1)}
    assert [r.queue_id for r in L.lookups_due(now, "s", 2).collect()] == [2]
    captures = spark.createDataFrame([(1, "http://a/x.mov", "text/html", "pending"), (2, "http://a/x.mov", None, "downloaded"), (3, "http://a/x", "text/html", "pending"), (4, "http://a/y.mov", "", "skipped")], "capture_id long, url string, mimetype string, state string")
    routing = spark.createDataFrame([(1, "text", "e", True, "pending", 1), (2, "text", "e", True, "pending", 1), (4, "text", "e", True, "pending", 2)], "capture_id long, resource_class string, evidence string, confident boolean, routing string, revision int")
    got = {r.capture_id: (r.resource_class, r.change, r.revision) for r in L.routing_backfilled(captures, routing, 2).collect()}
    assert got == {1: ("video", "corrected", 2), 2: ("text", "kept", 2), 3: ("text", "added", 2), 4: ("text", "kept", 2)}
    cols = "content_hash string, bytes_saved long, content_type string, final_url string, http_status int"
    before = spark.createDataFrame([(1, "pending", None, None, None, None, None), (2, "error", "h", 1, "t", "u", 404)], f"capture_id long, state string, {cols}")
    results = spark.createDataFrame([(2, 1, True, "h2", 20, "t2", "u2", None), (1, 1, False, "h1", 10, "t1", "u1", 200)], f"sequence long, capture_id long, deferred boolean, {cols}")
    assert {tuple(r) for r in L.evidence_saved(before, results).collect()} == {(1, "downloaded_unscanned", "h2", 20, "t2", "u2", None), (2, "error", "h", 1, "t", "u", 404)}
