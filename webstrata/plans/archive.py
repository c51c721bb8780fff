"""Queries: scans of saved bodies, hit lists over fields, failures and retries, reports, merges and repairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from webstrata.catalog import query, table
from webstrata.functions import text as T
from webstrata.operators import hits as HL
from webstrata.operators import history as H
from webstrata.operators import merging as G
from webstrata.operators import reports as R
from webstrata.operators import retries as RT
from webstrata.operators import saved_scan as SC
from webstrata.operators import shaping as S
from webstrata.operators import table_merge as TM
from webstrata.operators.extract import raw_links
from webstrata.plans import corpus as Q
from webstrata.storage import new_path

_SHELLS = {
    5: ("<html><head><title>Wayback Machine</title></head><body>Sorry. The Wayback Machine has not archived that URL.</body></html>", "missing_capture"),
    6: ("<html><body><h1>Blocked <b>Site</b> Error</h1></body></html>", "wayback_excluded"),
    7: ("The machine that serves this file is down.\nTry later.", "origin_unavailable"),
    8: ("<html><body><p>An article that says: blocked site error, not in archive.</p></body></html>", None),
}


def _bodies(spark, sf, *, shells: bool):
    """Documents as saved pages: captures and files; some files are missing, some are not those recorded, some are error pages."""
    k, none = F.col("doc_id"), F.lit("")
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(F.lit('<html><head><meta charset="utf-8"><title>'), esc(F.coalesce("source", none)), F.lit("</title></head><body>"), esc(F.col("text")), F.lit("</body></html>"))
    if shells:
        for rest, (text, _) in _SHELLS.items():
            page = F.when(k % 13 == rest, text).otherwise(page)
    d = table(spark, sf, "documents").select("doc_id", page.cast("binary").alias("content"))
    path = F.concat(F.lit("bodies/"), k.cast("string"))
    files = d.where((k % 7 != 2) & F.col("content").isNotNull()).select(path.alias("path"), "content")
    digest = F.when(k % 11 == 3, F.lit("0" * 64)).when(k % 11 != 4, F.sha2("content", 256))
    return d.select(k.alias("capture_id"), F.concat(F.lit("http://site.example/"), k.cast("string"), F.lit(".html")).alias("url"), F.lit("text/html").alias("mimetype"), path.alias("path"), digest.alias("sha256")), files


_PROBLEM = "CASE WHEN doc_id % 7 = 2 OR text IS NULL THEN 'missing_local_file' WHEN doc_id % 11 = 3 THEN 'local_integrity_failure' END"
_PAGES_SQL = "SELECT doc_id, lower('http://site.example/' || doc_id || '.html') AS u, lower(coalesce(source, '')) AS t, lower(coalesce(source, '') || ' ' || text) AS b FROM documents"


@query(
    "rescan_saved",
    Q.scored_sql(_PAGES_SQL)
    + f""" SELECT doc_id AS capture_id, CASE WHEN p IS NULL THEN 'downloaded' ELSE 'error' END AS state, p AS problem, CASE WHEN p IS NULL THEN score::INTEGER END AS score
    FROM (SELECT doc_id, {_PROBLEM} AS p FROM documents) JOIN z USING (doc_id)""",
)
def rescan_saved(spark, sf):
    captures, files = _bodies(spark, sf, shells=False)
    return SC.scan_saved(captures, files, Q.RULES, bonuses=False).select("capture_id", "state", "problem", "score")


_SHELL_SQL = "CASE " + " ".join(f"WHEN doc_id % 13 = {k} THEN '{kind}'" for k, (_, kind) in _SHELLS.items() if kind) + " END"
_MISSING_SHELL = "CASE WHEN doc_id % 7 = 2 OR (text IS NULL AND doc_id % 13 NOT IN (5, 6, 7, 8)) THEN 'missing_local_file' WHEN doc_id % 11 = 3 THEN 'local_integrity_failure' END"


@query(
    "pending_scan",
    Q.scored_sql(_PAGES_SQL)
    + f""" SELECT capture_id, CASE WHEN p IS NULL THEN 'downloaded_scanned' ELSE 'error' END AS routing, p AS problem, p <> 'invalid_archive_replay' OR s = 'origin_unavailable' AS retryable, CASE WHEN p IS NULL AND NOT quoted THEN score::INTEGER END AS score FROM (
    SELECT doc_id AS capture_id, coalesce(m, CASE WHEN s IS NOT NULL THEN 'invalid_archive_replay' END) AS p, CASE WHEN m IS NULL THEN s END AS s, doc_id % 13 = 8 AS quoted, score
    FROM (SELECT doc_id, {_MISSING_SHELL} AS m, {_SHELL_SQL} AS s FROM documents) JOIN z USING (doc_id))""",
)
def pending_scan(spark, sf):
    captures, files = _bodies(spark, sf, shells=True)
    out = SC.scan_saved(captures, files, Q.RULES, reject_shells=True, bonuses=False)
    score = F.when(F.col("capture_id") % 13 != 8, F.col("score"))  # the quoting article is scored by its own words
    return out.select("capture_id", F.coalesce(F.when(F.col("problem").isNull(), F.col("routing")), F.lit("error")).alias("routing"), "problem", "retryable", score.alias("score"))


@query("captures_reconciled", "SELECT page_id AS capture_id, CASE WHEN page_id % 3 = 0 AND page_id % 2 = 1 THEN 'downloaded_unscanned' WHEN page_id % 3 = 0 THEN 'downloaded' ELSE 'pending' END AS state FROM pages")
def captures_reconciled(spark, sf):
    c = table(spark, sf, "pages").select(F.col("page_id").alias("capture_id"), F.when(F.col("page_id") % 3 == 0, "downloaded").otherwise("pending").alias("state"))
    return SC.reconciled(c, c.where("capture_id % 2 = 0"))


@query(
    "rendering_needed",
    """SELECT page_id, k = 0 OR k = 3 OR (k = 1 AND m) OR k = 4 OR (k = 2 AND m) AS markup, k NOT IN (1, 2) OR m AS rendered FROM (
    SELECT page_id, page_id % 5 AS k, regexp_matches(lower(left(html, 8192)), '^[ \\t\\r\\n]*(<!doctype html|<html|<head|<body)') OR regexp_matches(lower(left(html, 8192)), '(?s)<((html|head|body)\\b[^>]*>|title\\b[^>]*>).*?</(html|head|body|title)\\s*>') AS m FROM pages)""",
)
def rendering_needed(spark, sf):
    k = (F.col("page_id") % 5 + 1).cast("int")
    url = F.concat(F.lit("http://a.example/f"), F.element_at(F.array(*map(F.lit, (".php", ".txt", "", ".htm", ""))), k))
    mime = F.element_at(F.array(*map(F.lit, ("", "text/plain", "application/json", "text/plain", "text/html; charset=utf-8"))), k)
    return table(spark, sf, "pages").select("page_id", SC.is_markup(F.col("html"), url, mime).alias("markup"), SC.needs_rendering(F.col("html"), url, mime).alias("rendered"))


_TIMES = lambda field: f"((length({field}) - length(replace({field}, phrase, ''))) // length(phrase))::INTEGER"
_PHRASES = """(SELECT 'i' || item_id AS phrase_id, split_part(text, '.', 1) AS phrase FROM benchmark WHERE length(trim(split_part(text, '.', 1))) > 0
    UNION ALL SELECT 's' || min(doc_id), source FROM documents WHERE source IS NOT NULL GROUP BY source UNION ALL SELECT 'w', 'stupid')"""


@query(
    "hitlist_fields",
    f"""SELECT doc_id, phrase_id, array_to_string(list_filter(['url', 'source'], lambda f, i: [a, b][i] > 0), ',') AS fields, array_to_string(list_filter([a, b], lambda n: n > 0), ',') AS counts FROM (
    SELECT doc_id, phrase_id, {_TIMES("coalesce(source, '')")} AS a, {_TIMES("coalesce(text, '')")} AS b FROM documents JOIN {_PHRASES} ON contains(source, phrase) OR contains(text, phrase)) WHERE a + b > 0""",
)
def hitlist_fields(spark, sf):
    d = table(spark, sf, "documents")
    b = table(spark, sf, "benchmark").select(F.concat(F.lit("i"), F.col("item_id").cast("string")).alias("phrase_id"), F.substring_index("text", ".", 1).alias("phrase"))
    s = d.where("source is not null").groupBy("source").agg(F.min("doc_id").alias("k")).select(F.concat(F.lit("s"), F.col("k").cast("string")).alias("phrase_id"), F.col("source").alias("phrase"))
    phrases = b.unionByName(s).unionByName(S.frame(spark, [("w", "stupid")], "phrase_id string, phrase string"))
    found = HL.field_hits(d, phrases, {"url": "source", "source": "text"}, id_col="doc_id", phrase_id="phrase_id", phrase="phrase")
    return found.select("doc_id", "phrase_id", F.array_join("fields", ",").alias("fields"), F.array_join(F.col("counts").cast("array<string>"), ",").alias("counts"))


@query(
    "phrase_list",
    r"""SELECT arg_min(trim(role || '_' || text), (conv_id, turn)) AS phrase FROM conversations WHERE trim(role || '_' || text) <> '' GROUP BY trim(regexp_replace(lower(role || '_' || text), '[ \t\n\r_]+', ' ', 'g'))""",
)
def phrase_list(spark, sf):
    c = table(spark, sf, "conversations").select(F.struct("conv_id", "turn").alias("position"), F.concat_ws("_", "role", "text").alias("phrase")).where("text is not null")
    return HL.phrase_list(c, "position", "phrase").select("phrase")


_LITERALS = ("the", "he", "thing", "in")


@query(
    "literal_spans",
    f"""SELECT doc_id, {" + ".join(f"(length(text) - length(replace(text, '{x}', ''))) // {len(x)}" for x in _LITERALS)}::INTEGER AS every, len(regexp_extract_all(text, '{"|".join(_LITERALS)}'))::INTEGER AS apart FROM documents WHERE text IS NOT NULL""".replace(
        "SELECT doc_id, ", "SELECT doc_id, ("
    ).replace("::INTEGER AS every", ")::INTEGER AS every"),
)
def literal_spans(spark, sf):
    d = table(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", F.size(HL.spans(F.col("text"), _LITERALS)).alias("every"), F.size(HL.spans(F.col("text"), _LITERALS, overlapping=False)).alias("apart"))


@query(
    "search_availability",
    "SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'discarded' WHEN 1 THEN 'partial' WHEN 2 THEN 'non_text' WHEN 3 THEN 'missing' END AS reason, count(*) OVER (PARTITION BY page_id % 6)::BIGINT AS n FROM pages",
)
def search_availability(spark, sf):
    k = F.col("page_id") % 6
    payload = F.when(k == 0, "discarded").when(k == 1, "partial").when(k == 5, "available")
    reason = HL.availability(payload, F.when(k == 2, "video").when(k == 4, "text"), k > 3)
    p = table(spark, sf, "pages").select("page_id", k.alias("k"), reason.alias("reason"))
    return p.join(p.groupBy("k").agg(F.count("*").alias("n")), "k").select("page_id", "reason", "n")


@query("search_again", "SELECT page_id FROM pages WHERE page_id % 10 = 3 OR page_id % 5 = 1 OR page_id % 7 = 6")
def search_again(spark, sf):
    """Pages whose type changed, whose body changed, or that are new since the last search."""
    p, k = table(spark, sf, "pages"), F.col("page_id")
    body = F.sha2(F.col("html").cast("binary"), 256)
    old = p.where(k % 7 != 6).select("page_id", HL.coverage_print([F.col("url"), F.lit("text/html")], body).alias("seen"))
    now = p.select("page_id", HL.coverage_print([F.col("url"), F.when(k % 10 == 3, "text/plain").otherwise("text/html")], F.when(k % 5 == 1, F.lit("other")).otherwise(body)).alias("seen"))
    return HL.to_search_again(old, now, "page_id", "seen")


_CLEAN = r"trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g'))"


@query(
    "search_snippets",
    f"""SELECT doc_id, CASE WHEN c = '' THEN '' ELSE (CASE WHEN b > 0 THEN '…' ELSE '' END) || substr(c, b + 1, least(length(c), b + 520) - b) || (CASE WHEN b + 520 < length(c) THEN '…' ELSE '' END) END AS snippet
    FROM (SELECT doc_id, c, greatest(coalesce(least(nullif(strpos(lower(c), 'stupid'), 0), nullif(strpos(lower(c), 'license'), 0)) - 1, 0) - 173, 0) AS b FROM (SELECT doc_id, {_CLEAN} AS c FROM documents WHERE text IS NOT NULL))""",
)
def search_snippets(spark, sf):
    d = table(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", HL.window_snippet("text", ["stupid", "of", "License"]).alias("snippet"))


_FAILURES = {
    "missing_capture: gone": ("missing_capture", 404, False), "HTTP 404 for page": ("missing_capture", 404, False), "HTTP 503 from server": ("http_server_error", 503, True), "http 425 early": ("http_client_error", 425, True),
    "HTTP 403 no": ("http_client_error", 403, False), "rate limit reached": ("rate_limit", 429, True), "read timed out": ("timeout", None, True), "bad certificate": ("ssl", None, True), "body exceeds 900 bytes": ("oversized_response", None, False),
    "connection reset": ("connection", None, True), "blocked by robots.txt": ("robots_blocked", 403, False), "incomplete_media_range 3-9": ("incomplete_media_representation", None, True), "no such column": ("local_processing_error", None, False),
}
_PICK = lambda xs: "[" + ", ".join("NULL" if x is None else repr(x) for x in xs) + f"][event_id % {len(_FAILURES)} + 1]"


@query(
    "failure_kinds",
    f"SELECT {_PICK([v[0] for v in _FAILURES.values()])} AS category, {_PICK([v[1] for v in _FAILURES.values()])}::INTEGER AS status, {_PICK([v[2] for v in _FAILURES.values()])}::BOOLEAN AS retryable, count(*)::BIGINT AS n FROM events GROUP BY 1, 2, 3",
)
def failure_kinds(spark, sf):
    message = F.element_at(F.array(*map(F.lit, _FAILURES)), (F.col("event_id") % len(_FAILURES) + 1).cast("int"))
    return table(spark, sf, "events").select(RT.failure_kind(message).alias("k")).groupBy("k.category", "k.status", "k.retryable").agg(F.count("*").alias("n"))


@query(
    "retry_after",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN (event_id % 900)::DOUBLE WHEN 1 THEN greatest(0.0, (epoch(date_trunc('second', ts)) - epoch(TIMESTAMP '2024-01-01 00:00:00'))::DOUBLE) END AS seconds FROM events""",
)
def retry_after(spark, sf):
    k = F.col("event_id") % 3
    value = F.when(k == 0, (F.col("event_id") % 900).cast("string")).when(k == 1, F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).otherwise("soon")
    return table(spark, sf, "events").select("event_id", RT.retry_after(value, F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("seconds"))


def _attempts(spark, sf):
    """Pages as failed captures, with their routing and errors."""
    k = F.col("page_id")
    c = table(spark, sf, "pages").select(k.alias("capture_id"), F.when(k % 5 == 4, "pending").otherwise("error").alias("state"))
    routing = c.select("capture_id", F.element_at(F.array(*map(F.lit, ("failed_retryable", "failed_nonretryable:missing_capture", "failed_size_limit:9", "failed_redirect_policy", "failed_nonretryable:robots_blocked"))), (F.col("capture_id") % 5 + 1).cast("int")).alias("routing"))
    k = F.col("capture_id")
    errors = c.select(
        "capture_id", F.lit("download").alias("operation"), (k % 2 == 0).alias("retryable"), (k % 11 == 0).alias("resolved"), F.lit(False).alias("ignored"),
        F.when(k % 3 == 0, "robots_blocked").otherwise("missing_capture").alias("category"),
    )
    return c, routing, errors


@query("captures_due", "SELECT page_id AS capture_id FROM pages WHERE page_id % 2 = 0 AND page_id % 11 <> 0 AND page_id % 5 = 0")
def captures_due(spark, sf):
    return RT.due_captures(*_attempts(spark, sf)).select("capture_id")


@query("captures_unavailable", "SELECT page_id AS capture_id FROM pages WHERE page_id % 2 = 1 AND page_id % 11 <> 0 AND page_id % 5 = 1 AND page_id % 3 <> 0")
def captures_unavailable(spark, sf):
    return RT.unavailable_captures(*_attempts(spark, sf)).select("capture_id")


@query("next_attempts", "SELECT user_id AS capture_id, min(ts) AS due FROM events GROUP BY user_id ORDER BY 2, 1 LIMIT 128")
def next_attempts(spark, sf):
    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("capture_id")).agg(F.min("ts").alias("due"))
    return RT.next_attempts(e, F.lit("2100-01-01").cast("timestamp"))


def _matches(spark, sf):
    """Labelled documents as scored matches."""
    score = (F.col("doc_id") % 50 - 5).cast("int")
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("url"), F.lpad((F.col("doc_id") % 97).cast("string"), 14, "0").alias("timestamp"), F.substring("lang", 1, 2).alias("title"))
    return d.withColumns({"score": score, "excluded": F.col("doc_id") % 9 == 4, "required_missing": F.col("doc_id") % 17 == 3})


_KEPT = "(SELECT doc_id, source AS url, lpad((doc_id % 97)::VARCHAR, 14, '0') AS timestamp, (doc_id % 50 - 5)::INTEGER AS score FROM documents WHERE doc_id % 50 - 5 >= 1 AND doc_id % 9 <> 4 AND doc_id % 17 <> 3)"


@query("ranked_matches", f"SELECT doc_id, score, (row_number() OVER (ORDER BY score DESC, timestamp, doc_id))::INTEGER AS rank FROM {_KEPT}")
def ranked_matches(spark, sf):
    return R.ranked_matches(_matches(spark, sf)).select("doc_id", "score", "rank")


@query("matched_urls", f"SELECT url AS value FROM {_KEPT} GROUP BY url ORDER BY min((-score, timestamp, doc_id))")
def matched_urls(spark, sf):
    m = _matches(spark, sf).where("score >= 1 and not excluded and not required_missing")
    return R.first_seen(m, F.col("url"))


@query(
    "interesting_links",
    """SELECT DISTINCT url AS source_url, link FROM (SELECT url, unnest(list_filter(regexp_extract_all(html, '<a href="([^"]*)"', 1), lambda x: x <> '')) AS link FROM pages
    UNION ALL SELECT url, 'http://x.example/' || (page_id % 30) || ['.zip', '.mp3', '.jpg', '.txt'][page_id % 4 + 1] FROM pages)
    WHERE regexp_matches(lower(regexp_extract(link, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '[^./][.](zip|jpg)$') OR contains(lower(link), 'page=2')""",
)
def interesting_links(spark, sf):
    p, k = table(spark, sf, "pages"), F.col("page_id")
    named = F.concat(F.lit("http://x.example/"), (k % 30).cast("string"), F.element_at(F.array(*map(F.lit, (".zip", ".mp3", ".jpg", ".txt"))), (k % 4 + 1).cast("int")))
    links = p.select("url", F.explode(F.concat(raw_links(F.col("html")), F.array(named))).alias("link"))
    return R.interesting_links(links, Q.K.parse_rules(["page=2", "exclude: zip"]), "url", "link")


@query(
    "scan_comparison",
    """WITH a AS (SELECT doc_id, (doc_id % 20)::INTEGER AS s FROM documents WHERE doc_id % 3 <> 0), b AS (SELECT doc_id, (doc_id % 31)::INTEGER AS s FROM documents WHERE doc_id % 4 <> 0),
    j AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.s AS x, b.s AS y FROM a FULL JOIN b ON a.doc_id = b.doc_id),
    r AS (SELECT j.*, lpad((doc_id % 97)::VARCHAR, 14, '0') || chr(9) || coalesce(source, '') || chr(9) || coalesce(nullif(left(lang, 2), ''), '(untitled)') AS tail FROM j JOIN documents USING (doc_id))
    SELECT 1 AS section, 'delta=' || CASE WHEN y >= x THEN '+' ELSE '' END || (y - x) || chr(9) || 'first=' || x || chr(9) || 'second=' || y || chr(9) || tail AS line FROM r WHERE x IS NOT NULL AND y IS NOT NULL
    UNION ALL SELECT 2, x || chr(9) || tail FROM r WHERE y IS NULL UNION ALL SELECT 3, y || chr(9) || tail FROM r WHERE x IS NULL
    UNION ALL SELECT 0, 'Documents in both: ' || format('{:,}', count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL)) FROM r UNION ALL SELECT 0, 'Only in first: ' || format('{:,}', count(*) FILTER (WHERE y IS NULL)) FROM r
    UNION ALL SELECT 0, 'Only in second: ' || format('{:,}', count(*) FILTER (WHERE x IS NULL)) FROM r""",
)
def scan_comparison(spark, sf):
    m, k = _matches(spark, sf), F.col("doc_id")
    a, b = m.where(k % 3 != 0).select("doc_id", (k % 20).cast("int").alias("score")), m.where(k % 4 != 0).select("doc_id", (k % 31).cast("int").alias("score"))
    return R.comparison(S.compare_runs(a, b, "doc_id", "score"), m.select("doc_id", "timestamp", "url", "title"), "doc_id").select("section", "line")


_HOSTS = ("WWW.Example.COM.", "https://user@Bücher.example:81/x", "192.168.0.1", "localhost", "a。b.example", "//cdn.example/y")
_HOSTS_OUT = ("www.example.com", "xn--bcher-kva.example", "", "", "a.b.example", "cdn.example")


@query("canonical_hosts", "SELECT page_id, [" + ", ".join(f"'{h}'" for h in _HOSTS_OUT) + f"][page_id % {len(_HOSTS)} + 1] AS host FROM pages")
def canonical_hosts(spark, sf):
    T.register_functions(spark)
    spelt = F.element_at(F.array(*map(F.lit, _HOSTS)), (F.col("page_id") % len(_HOSTS) + 1).cast("int"))
    return table(spark, sf, "pages").select("page_id", spelt.alias("spelt")).selectExpr("page_id", "canonical_host(spelt) as host")


def _two(spark, sf):
    """Orders as two collections that share some captures."""
    o = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("http://a.example/"), F.col("o_orderkey").cast("string")).alias("url"), F.date_format("o_orderdate", "yyyyMMddHHmmss").alias("timestamp"))
    k = F.col("o_orderkey")
    own = o.where(k % 3 != 0).select(k.alias("capture_id"), "url", "timestamp", F.concat(F.lit("d"), (k % 10).cast("string")).alias("digest"))
    other = o.where(k % 2 == 0).select((k * 2).alias("capture_id"), "url", "timestamp", F.when(k % 7 == 0, "zz").otherwise(F.concat(F.lit("d"), (k % 10).cast("string"))).alias("digest"))
    return own, other


@query(
    "merged_captures",
    """SELECT o_orderkey AS capture_id, 'http://a.example/' || o_orderkey AS url FROM orders WHERE o_orderkey % 3 <> 0
    UNION ALL SELECT o_orderkey * 2 + (SELECT max(o_orderkey) FROM orders WHERE o_orderkey % 3 <> 0), 'http://a.example/' || o_orderkey FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 = 0""",
)
def merged_captures(spark, sf):
    return G.merged_captures(*_two(spark, sf), ["url", "timestamp"], "capture_id")[0].select("capture_id", "url")


@query(
    "merged_facts",
    """SELECT o_orderkey AS capture_id, 'own' AS note FROM orders WHERE o_orderkey % 3 <> 0
    UNION SELECT CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey ELSE o_orderkey * 2 + (SELECT max(o_orderkey) FROM orders WHERE o_orderkey % 3 <> 0) END, CASE WHEN o_orderkey % 4 = 0 THEN 'own' ELSE 'theirs' END FROM orders WHERE o_orderkey % 2 = 0""",
)
def merged_facts(spark, sf):
    own, other = _two(spark, sf)
    _, moved = G.merged_captures(own, other, ["url", "timestamp"], "capture_id")
    note = F.when(F.col("capture_id") % 8 == 0, "own").otherwise("theirs")
    return G.merged_facts(own.select("capture_id", F.lit("own").alias("note")), other.select("capture_id", note.alias("note")), moved, "capture_id")


@query(
    "merge_conflicts",
    "SELECT 'http://a.example/' || o_orderkey AS url, 'd' || (o_orderkey % 10) AS own, 'zz' AS other FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0 AND o_orderkey % 7 = 0",
)
def merge_conflicts(spark, sf):
    return G.conflicts(*_two(spark, sf), ["url", "timestamp"], "digest").select("url", "own", "other")


@query(
    "merged_reviews",
    """SELECT doc_id AS match_id, CASE WHEN doc_id % 2 = 0 AND s <> 'unreviewed' THEN s WHEN doc_id % 3 = 0 THEN 'duplicate' WHEN doc_id % 2 = 0 THEN s END AS status
    FROM (SELECT doc_id, CASE WHEN toxic = 1 THEN 'false_positive' WHEN quality = 1 THEN 'relevant' ELSE 'unreviewed' END AS s FROM labels) WHERE doc_id % 2 = 0 OR doc_id % 3 = 0""",
)
def merged_reviews(spark, sf):
    from webstrata.plans.relational import _reviews

    r = _reviews(spark, sf).withColumnRenamed("doc_id", "match_id")
    return G.merged_reviews(r.where("match_id % 2 = 0"), r.where("match_id % 3 = 0").withColumn("status", F.lit("duplicate")))


@query("paths_rebased", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '/new/p' || page_id WHEN page_id % 3 = 1 THEN '/old/homes/p' || page_id ELSE '/new/w/p' || page_id END AS path FROM pages")
def paths_rebased(spark, sf):
    k = F.col("page_id")
    path = F.concat(F.when(k % 3 == 0, "/old/home/p").when(k % 3 == 1, "/old/homes/p").otherwise("\\old\\home\\w\\p"), k.cast("string"))
    return table(spark, sf, "pages").select("page_id", G.rebased(path, "/old/home/", "/new").alias("path"))


@query(
    "captures_repaired",
    """SELECT page_id AS capture_id, CASE WHEN k = 0 THEN 'pending' WHEN k IN (1, 2) AND page_id % 3 = 0 THEN 'pending' WHEN k IN (1, 2) AND page_id % 5 = 0 THEN 'downloaded_unscanned' WHEN k IN (1, 2) THEN 'downloaded' ELSE 'pending' END AS state,
    CASE WHEN k = 0 THEN 'interrupted' WHEN k IN (1, 2) AND page_id % 3 = 0 THEN 'file_missing' WHEN k = 1 AND page_id % 5 = 0 THEN 'document_missing' WHEN k = 2 AND page_id % 5 <> 0 THEN 'already_scanned' END AS mended
    FROM (SELECT page_id, page_id % 4 AS k FROM pages)""",
)
def captures_repaired(spark, sf):
    k = F.col("page_id")
    state = F.element_at(F.array(*map(F.lit, ("downloading", "downloaded", "downloaded_unscanned", "pending"))), (k % 4 + 1).cast("int"))
    c = table(spark, sf, "pages").select(k.alias("capture_id"), F.concat(F.lit("f"), k.cast("string")).alias("path"), state.alias("state"))
    return G.repaired(c, c.where("capture_id % 3 <> 0"), c.where("capture_id % 5 <> 0")).select("capture_id", "state", "mended")


@query(
    "results_judged",
    """SELECT user_id AS match_id, greatest(0, least(100, round_even(arg_max(value * 3 - 20, event_id), 0)))::INTEGER AS relevance_score, greatest(0.0, least(1.0, arg_max(value / 50 - 0.2, event_id)))::DOUBLE AS confidence, arg_max(event_type, event_id) AS category
    FROM events GROUP BY user_id""",
)
def results_judged(spark, sf):
    v = F.col("value")
    return G.judged(table(spark, sf, "events").select(F.col("user_id").alias("match_id"), F.col("event_id").alias("sequence"), (v * 3 - 20).alias("relevance_score"), (v / 50 - 0.2).alias("confidence"), F.col("event_type").alias("category")), ["match_id"])


@query(
    "claims_grounded",
    """SELECT o_custkey AS topic, o_orderkey AS claim_id, least(1.0, o_totalprice / 100000)::DOUBLE AS confidence FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM (SELECT l_orderkey, max(l_quantity) AS q FROM lineitem GROUP BY l_orderkey, l_linenumber) GROUP BY l_orderkey HAVING bool_and(q > 5))""",
)
def claims_grounded(spark, sf):
    """Orders as claims on their customer, supported by parts; parts of small quantities are no evidence."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("topic"), F.col("o_orderkey").alias("claim_id"), (F.col("o_totalprice") / 100000).cast("double").alias("confidence"))
    part = F.concat_ws("-", "l_orderkey", "l_linenumber")
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("claim_id"), part.alias("id"), "l_quantity")
    claims = o.join(lines.groupBy("claim_id").agg(F.collect_list("id").alias("support")), "claim_id")  # a few lines an order
    evidence = lines.where("l_quantity > 5").join(o.select("topic", "claim_id"), "claim_id").select("topic", "id")
    return G.grounded(claims, evidence, "topic").select("topic", "claim_id", "confidence")


@query("near_groups_by_method")
def near_groups_by_method(spark, sf):
    """Groups of near and of exact copies, and how many documents are in them."""
    g = H.near_groups(H.fingerprints(table(spark, sf, "documents"), "doc_id", "text"))
    return g.groupBy("group_method").agg(F.count_distinct("group").alias("groups"), F.count("*").alias("documents"))


#: Six tables of a collection, with their keys.
COLLECTION = [
    TM.Table("notes", ("match_id", "text"), refs={"match_id": "matches"}), TM.Table("matches", ("run_id", "document_id"), "match_id", {"run_id": "runs", "document_id": "documents"}),
    TM.Table("documents", ("capture_id",), "document_id", {"capture_id": "captures"}, "digest"), TM.Table("captures", ("url", "timestamp"), "capture_id", {"target_id": "targets"}),
    TM.Table("runs", ("name",), "run_id"), TM.Table("targets", ("pattern",), "target_id"),
]


def _collection(d, scale: int, shift: int, note):
    """Documents as a collection whose numbers are those of the documents, scaled and shifted."""
    k = F.col("doc_id") * scale + shift
    first = lambda c, name, number: d.groupBy(F.col(c).alias(name)).agg((F.min("doc_id") * scale + shift).alias(number))
    targets, runs = first("lang", "pattern", "target_id"), first("source", "name", "run_id")
    numbered = d.join(targets.withColumnRenamed("pattern", "lang"), "lang").join(runs.withColumnRenamed("name", "source"), "source")
    return {
        "targets": targets, "runs": runs, "captures": numbered.select(k.alias("capture_id"), F.concat(F.lit("http://d.example/"), F.col("doc_id").cast("string")).alias("url"), F.lit("20010101000000").alias("timestamp"), "target_id"),
        "documents": numbered.select(k.alias("document_id"), k.alias("capture_id"), F.sha2(F.col("text").cast("binary"), 256).alias("digest")),
        "matches": numbered.select(k.alias("match_id"), "run_id", k.alias("document_id"), F.col("n_chars").alias("score")), "notes": numbered.select(k.alias("match_id"), note.alias("text")),
    }


@query(
    "collections_merged",
    """SELECT lang AS pattern, 'http://d.example/' || doc_id AS url, source AS run, n_chars AS score, 'own' AS note FROM documents WHERE doc_id % 3 <> 0
    UNION SELECT lang, 'http://d.example/' || doc_id, source, n_chars, CASE WHEN doc_id % 4 = 0 THEN 'own' ELSE 'theirs' END FROM documents WHERE doc_id % 2 = 0""",
)
def collections_merged(spark, sf):
    """Two collections of six tables with other numbers, merged twice, and read along all their foreign keys."""
    d, path = table(spark, sf, "documents"), new_path(spark, "collections")
    own, other = _collection(d.where("doc_id % 3 <> 0"), 1, 0, F.lit("own")), _collection(d.where("doc_id % 2 = 0"), 10, 7, F.when(F.col("doc_id") % 4 == 0, "own").otherwise("theirs"))
    m = TM.merge(TM.merge(own, other, COLLECTION, path), other, COLLECTION, path)
    rows = m["notes"].withColumnRenamed("text", "note").join(m["matches"], "match_id").join(m["documents"], "document_id").join(m["captures"], "capture_id").join(m["targets"], "target_id").join(m["runs"], "run_id")
    return rows.select("pattern", "url", F.col("name").alias("run"), "score", "note")
