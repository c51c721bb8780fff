"""Queries: errors and site issues out of logs, lookups, saved evidence, routing, redirects, candidates and domain lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from webstrata.catalog import query, table
from webstrata.functions import text as T
from webstrata.operators import fulltext as FT
from webstrata.operators import history as H
from webstrata.operators import ledger as L
from webstrata.operators.tables import captures
from webstrata.plans import corpus as Q
from webstrata.plans.review import _matches

_FAILURES = """SELECT event_id AS sequence, ts, event_type, CASE WHEN event_id % 4 = 0 THEN NULL ELSE user_id END AS capture_id, CASE event_type WHEN 'error' THEN 'scan' ELSE 'download' END AS operation,
    'c' || (floor(value)::BIGINT % 3) AS category, CASE WHEN event_id % 2 = 1 THEN 'web' END AS scope, CASE WHEN user_id % 5 = 0 THEN user_id END AS document_id, props AS message,
    CASE WHEN event_id % 3 > 0 THEN 500 + event_id % 5 END AS http_status, value > 20 AS retryable FROM events"""


def _log(spark, sf):
    """Events as failures of captures; purchases resolve, a quarter has no capture."""
    k, u = F.col("event_id"), F.col("user_id")
    return table(spark, sf, "events").select(
        k.alias("sequence"), F.col("ts").alias("at"), "event_type", F.when(k % 4 != 0, u).alias("capture_id"), F.when(F.col("event_type") == "error", "scan").otherwise("download").alias("operation"),
        F.concat(F.lit("c"), (F.floor("value") % 3).cast("string")).alias("category"), F.when(k % 2 == 1, "web").alias("scope"), F.when(u % 5 == 0, u).alias("document_id"),
        F.lit(None).cast("long").alias("media_id"), F.col("props").alias("message"), F.when(k % 3 > 0, 500 + k % 5).alias("http_status"), (F.col("value") > 20).alias("retryable"),
    )


@query(
    "errors_kept",
    f"""WITH f AS ({_FAILURES}), g AS (SELECT *, CASE WHEN capture_id IS NULL THEN 0 ELSE count(*) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY capture_id ORDER BY sequence) END AS before,
    CASE WHEN capture_id IS NULL THEN 0 ELSE count(*) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY capture_id) END AS every FROM f)
    SELECT operation, category, scope, capture_id, document_id, min(sequence) AS error_id, count(*)::BIGINT AS attempt_count, arg_min_null(ts, sequence) AS first_seen, arg_max_null(ts, sequence) AS last_seen, arg_max_null(message, sequence) AS message,
    arg_max_null(http_status, sequence) AS http_status, arg_max_null(retryable, sequence) AS retryable, any_value(every) > before AS resolved
    FROM g WHERE event_type <> 'purchase' GROUP BY operation, category, scope, capture_id, document_id, before""",
)
def errors_kept(spark, sf):
    log = _log(spark, sf)
    kept = L.errors_kept(log.where("event_type <> 'purchase'").drop("event_type"), log.where("event_type = 'purchase'").select("sequence", "capture_id"))
    return kept.drop("media_id")


@query(
    "site_issues",
    """WITH e AS (SELECT event_id AS s, ts, CASE WHEN user_id % 9 = 0 THEN 'unknown' ELSE 'site' || (user_id % 40) END AS host, CASE WHEN event_id % 2 = 0 THEN 'index' ELSE 'download' END AS stage,
    CASE WHEN event_id % 3 = 0 THEN 0 ELSE 500 + event_id % 3 END AS http_status, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN NULL ELSE 'target ' || user_id END AS target, props, event_type FROM events),
    c AS (SELECT host, stage, http_status, max(s) AS closed FROM e WHERE event_type = 'purchase' GROUP BY 1, 2, 3),
    i AS (SELECT host, stage, event_type AS category, http_status, arg_max(target, s) AS target, arg_max_null(props, s) AS message, count(*)::BIGINT AS occurrence_count, arg_min_null(ts, s) AS first_seen, arg_max_null(ts, s) AS last_seen, max(s) AS s
    FROM e WHERE event_type IN ('error', 'view') GROUP BY 1, 2, 3, 4)
    SELECT i.* EXCLUDE (s), coalesce(category = 'error' AND closed > s, false) AS resolved FROM i LEFT JOIN c USING (host, stage, http_status)""",
)
def site_issues(spark, sf):
    """Errors and views as issues of 40 sites, blank sites among them; purchases resolve what is an error."""
    k, u = F.col("event_id"), F.col("user_id")
    e = table(spark, sf, "events").select(
        k.alias("sequence"), F.col("ts").alias("at"), F.when(u % 9 == 0, "  ").otherwise(F.concat(F.lit(" Site"), (u % 40).cast("string"))).alias("host"), F.when(k % 2 == 0, "index").otherwise("download").alias("stage"),
        F.col("event_type").alias("category"), F.when(k % 3 > 0, 500 + k % 3).alias("http_status"), F.when(k % 4 == 1, " ").when(k % 4 > 1, F.concat(F.lit("target "), u.cast("string"))).alias("target"), F.col("props").alias("message"),
    )
    resolved = e.where("category = 'purchase'").select("sequence", "host", "stage", F.lit("error").alias("category"), "http_status")
    return L.site_issues(e.where("category in ('error', 'view')"), resolved)


_HOST = "lower(regexp_extract({}, '//([^/?#:]+)', 1))"


@query(
    "redirects_judged",
    f"""WITH p AS (SELECT page_id, {_HOST.format("url")} AS host, lead(url) OVER (ORDER BY page_id) AS next, url FROM pages), d AS (SELECT *, {_HOST.format("next")} AS other FROM p)
    SELECT page_id, CASE WHEN page_id % 7 = 5 OR next IS NULL AND page_id % 7 <> 6 THEN 'live_redirect_blocked' WHEN page_id % 7 = 6 OR other = host OR other = 'example.com' OR other LIKE '%.example.com' OR other = 'therwh.example.org' THEN 'allowed'
    ELSE 'external_redirect_blocked' END AS outcome FROM d""",
)
def redirects_judged(spark, sf):
    """Each page leads to the replay of the page after it, some to the living web, some to an address of the archive itself."""
    p = table(spark, sf, "pages").select("page_id", "url")
    after = p.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("next"))
    k = F.col("page_id") % 7
    to = F.when(k == 5, F.col("next")).when(k == 6, F.lit("https://web.archive.org/web/timemap")).otherwise(T.replay_url("https://web.archive.org/web/", F.lit("20010101000000"), F.col("next")))
    return p.join(after, "page_id", "left").select("page_id", L.redirect_outcome(F.col("url"), to, [("example.com", True), ("Therwh.example.org", False)]).alias("outcome"))


_QUEUE = """q AS (SELECT p_partkey AS queue_id, 's' || (p_partkey % 2) AS signature, CASE WHEN p_size % 3 = 0 THEN 'indexed' ELSE 'pending' END AS state, p_size % 4 AS result_count, NULL::VARCHAR AS last_error, p_size % 3 AS lookup_attempts FROM part),
    l AS (SELECT l_partkey AS queue_id, l_orderkey * 8 + l_linenumber AS s, CASE l_suppkey % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'indexed' ELSE 'unavailable' END AS state, l_quantity::BIGINT - 10 AS n,
    CASE WHEN l_suppkey % 3 = 0 THEN l_returnflag ELSE '' END AS error, l_linenumber <> 2 AS counted FROM lineitem WHERE l_orderkey % 5 = 0),
    d AS (SELECT queue_id, state, n, error, count(*) FILTER (WHERE counted) OVER (PARTITION BY queue_id) AS more FROM l QUALIFY row_number() OVER (PARTITION BY queue_id ORDER BY s DESC, state DESC, n DESC, error DESC) = 1),
    m AS (SELECT q.queue_id, signature, coalesce(d.state, q.state) AS state, CASE WHEN d.state IS NULL THEN result_count ELSE greatest(0, n) END AS result_count, CASE WHEN d.state IS NULL THEN last_error ELSE nullif(error, '') END AS last_error,
    lookup_attempts + coalesce(more, 0) AS lookup_attempts FROM q LEFT JOIN d USING (queue_id))"""


def _queue(spark, sf):
    """Parts as a queue of media, order lines as lookups of them."""
    k = F.col("p_partkey")
    queue = table(spark, sf, "part").select(
        k.alias("queue_id"), F.concat(F.lit("s"), (k % 2).cast("string")).alias("signature"), F.when(F.col("p_size") % 3 == 0, "indexed").otherwise("pending").alias("state"), (F.col("p_size") % 4).alias("result_count"),
        F.lit(None).cast("string").alias("last_error"), (F.col("p_size") % 3).alias("lookup_attempts"),
    )
    s = F.col("l_suppkey") % 3
    lookups = table(spark, sf, "lineitem").where("l_orderkey % 5 = 0").select(
        F.col("l_partkey").alias("queue_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("sequence"), F.when(s == 0, "error").when(s == 1, "indexed").otherwise("unavailable").alias("state"),
        (F.col("l_quantity").cast("long") - 10).alias("result_count"), F.when(s == 0, F.col("l_returnflag")).otherwise("").alias("error"), (F.col("l_linenumber") != 2).alias("counted"),
    )
    return L.lookups_marked(queue, lookups)


@query("lookups_marked", f"WITH {_QUEUE} SELECT * FROM m")
def lookups_marked(spark, sf):
    return _queue(spark, sf)


@query("lookup_counts", f"WITH {_QUEUE} SELECT v AS state, count(m.state)::BIGINT AS n FROM (VALUES ('pending'), ('indexed'), ('unavailable'), ('error')) t(v) LEFT JOIN m ON m.state = v AND signature = 's1' GROUP BY 1")
def lookup_counts(spark, sf):
    return L.lookup_counts(_queue(spark, sf), "s1")


@query("lookups_due", f"WITH {_QUEUE} SELECT queue_id, state, lookup_attempts FROM m WHERE signature = 's0' AND state IN ('pending', 'error') AND lookup_attempts < 4")
def lookups_due(spark, sf):
    return L.lookups_due(_queue(spark, sf), "s0", 4).select("queue_id", "state", "lookup_attempts")


@query(
    "evidence_saved",
    """SELECT c_custkey AS capture_id, coalesce(r.state, 'pending') AS state, r.h AS content_hash, r.b AS bytes_saved, r.t AS content_type, r.u AS final_url, r.c AS http_status
    FROM customer LEFT JOIN (SELECT o_custkey, arg_max(CASE WHEN o_orderstatus = 'O' THEN 'downloaded_unscanned' ELSE 'downloaded' END, o_orderkey) AS state, arg_max(sha256(o_orderkey::VARCHAR), o_orderkey) AS h,
    arg_max(floor(o_totalprice)::BIGINT, o_orderkey) AS b, arg_max_null(CASE WHEN o_orderkey % 3 > 0 THEN 'text/html' END, o_orderkey) AS t, arg_max('http://s.example/' || o_orderkey, o_orderkey) AS u,
    arg_max_null(CASE WHEN o_orderkey % 4 > 0 THEN 200 END, o_orderkey) AS c FROM orders GROUP BY 1) r ON o_custkey = c_custkey""",
)
def evidence_saved(spark, sf):
    """Customers as captures, orders as what was downloaded for them."""
    k = F.col("o_orderkey")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    waiting = table(spark, sf, "customer").select(F.col("c_custkey").alias("capture_id"), F.lit("pending").alias("state"), none("string", "content_hash"), none("long", "bytes_saved"), none("string", "content_type"), none("string", "final_url"), none("int", "http_status"))
    results = table(spark, sf, "orders").select(
        k.alias("sequence"), F.col("o_custkey").alias("capture_id"), (F.col("o_orderstatus") == "O").alias("deferred"), T.sha256(k.cast("string")).alias("content_hash"), F.floor("o_totalprice").alias("bytes_saved"),
        F.when(k % 3 > 0, "text/html").alias("content_type"), F.concat(F.lit("http://s.example/"), k.cast("string")).alias("final_url"), F.when(k % 4 > 0, 200).alias("http_status"),
    )
    return L.evidence_saved(waiting, results)


@query(
    "routing_backfilled",
    """SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'added' WHEN page_id % 6 < 4 AND page_id % 5 = 0 THEN 'corrected' ELSE 'kept' END AS change,
    CASE WHEN page_id % 5 = 0 AND page_id % 6 < 4 THEN 'video' WHEN page_id % 6 = 0 THEN 'text' ELSE 'old' END AS resource_class, CASE WHEN page_id % 6 = 0 THEN 'pending' WHEN page_id % 6 = 5 THEN 'downloaded_awaiting_scan' ELSE 'deferred_to_media' END AS routing FROM pages""",
)
def routing_backfilled(spark, sf):
    """Pages, a fifth of them films by suffix: a sixth without a row, a sixth done, a sixth of the present revision."""
    k = F.col("page_id")
    own = table(spark, sf, "pages").select(k.alias("capture_id"), F.concat(F.lit("http://p.example/"), k.cast("string"), F.when(k % 5 == 0, ".mov").otherwise("")).alias("url"), F.lit("text/html").alias("mimetype"), F.lit("pending").alias("state"))
    c = F.col("capture_id")
    rows = own.where("capture_id % 6 > 0").select("capture_id", F.lit("old").alias("resource_class"), F.lit("mime:text/html").alias("evidence"), F.lit(False).alias("confident"), F.when(c % 6 == 5, "downloaded_awaiting_scan").otherwise("deferred_to_media").alias("routing"), F.when(c % 6 == 4, 3).otherwise(2).alias("revision"))
    return L.routing_backfilled(own, rows, 3).select(c.alias("page_id"), "change", "resource_class", "routing")


_QUESTION = "Find the specific pages about a stupid thing, 1999 THING"


@query(
    "candidates_selected",
    Q._SCORED + """, ww AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS words FROM documents), cc AS (SELECT doc_id, len(words) AS l, len(list_filter(words, lambda x: x = 'stupid')) AS t0, len(list_filter(words, lambda x: x = 'thing')) AS t1 FROM ww),
    st AS (SELECT count(*)::DOUBLE AS n, avg(l) AS m, count(*) FILTER (WHERE t0 > 0)::DOUBLE AS d0, count(*) FILTER (WHERE t1 > 0)::DOUBLE AS d1 FROM cc),
    bm AS (SELECT doc_id, round(ln((n - d0 + 0.5) / (d0 + 0.5) + 1) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * l / m)) + ln((n - d1 + 0.5) / (d1 + 0.5) + 1) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * l / m)), 6) AS r FROM cc, st WHERE t0 + t1 > 0),
    fts AS (SELECT doc_id, z.score::INTEGER AS score, r FROM z JOIN bm USING (doc_id) WHERE z.score >= 1 ORDER BY r DESC, z.score DESC, doc_id LIMIT 15),
    oth AS (SELECT doc_id, z.score::INTEGER AS score FROM z WHERE z.score >= 5 AND doc_id NOT IN (SELECT doc_id FROM fts) ORDER BY z.score DESC, doc_id LIMIT 30),
    al AS (SELECT doc_id, score, 0 AS part, r FROM fts UNION ALL SELECT doc_id, score, 1, 0 FROM oth)
    SELECT * FROM (SELECT row_number() OVER (ORDER BY part, r DESC, score DESC, doc_id)::INTEGER AS position, doc_id AS match_id, score FROM al) WHERE position <= 30""",
)
def candidates_selected(spark, sf):
    """Half by full text for the terms of a question, then by score."""
    terms = spark.range(1).select(L.question_terms(F.lit(_QUESTION)).alias("terms")).first().terms
    ranked = FT.bm25(table(spark, sf, "documents"), "doc_id", "text", terms).select(F.col("doc_id").alias("document_id"), F.round("score", 6).alias("rank_score"))
    return L.candidates(_matches(spark, sf).where("run_id = 1"), ranked, least=5, limit=30)


def _domain_rounds(spark, sf):
    """Pages read in two rounds: nine tenths, then all as changed since; a seventeenth has no text to read."""
    k = F.col("page_id")
    rules = spark.createDataFrame([("com",), ("net",), ("org",), ("*.ck",), ("!www.ck",)], "suffix string")
    pages = table(spark, sf, "pages").select(k.alias("capture_id"), F.col("url").alias("text"))
    digest = lambda rows: rows.withColumn("digest", T.sha256(F.coalesce("text", F.lit(""))))
    recipe, c = L.recipe_of(rules), F.col("capture_id")
    none = spark.createDataFrame([], "recipe string, capture_id long, digest string"), spark.createDataFrame([], "recipe string, capture_id long, host string")
    first = L.domains_committed(*none, digest(pages.where(c % 10 != 9)), rules, recipe)
    changed = digest(pages.withColumn("text", F.when(c % 17 == 5, F.lit(None)).when(c % 13 == 6, F.concat("text", F.lit(" and shop.co.ck, www.ck"))).otherwise(F.col("text"))))
    return *L.domains_committed(*first, changed, rules, recipe), changed, recipe


_ADMITTED = "SELECT page_id, regexp_extract(lower(url), '//([^/?#:]+)', 1) AS host FROM pages WHERE page_id % 17 <> 5 UNION SELECT page_id, unnest(['shop.co.ck', 'www.ck']) FROM pages WHERE page_id % 13 = 6 AND page_id % 17 <> 5"


@query("domains_published", f"SELECT '*.' || host || '/*' AS line, count(DISTINCT page_id)::BIGINT AS captures FROM ({_ADMITTED}) GROUP BY 1")
def domains_published(spark, sf):
    return L.domains_published(*_domain_rounds(spark, sf))[0]


@query("domains_status", "SELECT count(*)::BIGINT AS inputs, count(*) FILTER (WHERE page_id % 17 = 5)::BIGINT AS gaps, 'incomplete' AS status FROM pages")
def domains_status(spark, sf):
    return L.domains_published(*_domain_rounds(spark, sf))[1]


@query("provenance_near")
def provenance_near(spark, sf):
    """Documents in groups of near and exact copies, from the oldest of each to the others of other sources; ages by number of characters."""
    d = table(spark, sf, "documents")
    groups = H.near_groups(H.fingerprints(d, "doc_id", "text")).select("group", "id", F.col("group_method").alias("method"), "similarity")
    return L.provenance_of_groups(groups, d.select(F.col("doc_id").alias("id"), F.col("source").alias("url"), F.lpad(F.col("n_chars").cast("string"), 14, "0").alias("timestamp")))
