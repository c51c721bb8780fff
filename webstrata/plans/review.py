"""Queries: results as they are listed and reviewed, scan coverage, upkeep of runs and errors, and the smaller functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from webstrata.catalog import query, table
from webstrata.functions import text as T
from webstrata.operators import classify as C
from webstrata.operators import keyword_scan as K
from webstrata.operators import media as M
from webstrata.operators import reviews as V
from webstrata.operators import rule_sets as RS
from webstrata.plans import corpus as Q
from webstrata.plans.relational import _REVIEWS, _reviews
from webstrata.sources import bodies, cdx


def _matches(spark, sf):
    """Documents scanned by the rules as matches of run 1, of run 2 where their number is even."""
    scanned = RS.scan(Q._fields(spark, sf), Q.RULES, Q._F3, bonuses=False).where("score >= 1")
    one = scanned.select(F.col("doc_id").alias("match_id"), F.lit(1).alias("run_id"), F.col("doc_id").alias("document_id"), "score")
    return one.unionByName(one.where("match_id % 2 = 0").withColumns({"match_id": F.col("match_id") + 10_000_000_000, "run_id": F.lit(2)}))


@query(
    "result_rows",
    Q._SCORED + f""", r AS (SELECT z.doc_id AS match_id, z.score::INTEGER AS score, coalesce(v.status, 'unreviewed') AS review_status, f.t AS title, 'http://d.example/' || (z.doc_id % 90) AS url,
    lpad((z.doc_id % 70)::VARCHAR, 14, '0') AS timestamp, CASE WHEN z.doc_id % 4 = 0 THEN 'first ' || z.doc_id ELSE '' END AS note, CASE WHEN z.doc_id % 6 = 0 THEN 'a, b' WHEN z.doc_id % 3 = 0 THEN 'b' ELSE '' END AS tags
    FROM z JOIN f USING (doc_id) LEFT JOIN {_REVIEWS} v USING (doc_id) WHERE z.score >= 10 AND (contains(f.b, 'thing') OR contains(f.t, 'thing')) AND coalesce(v.status, 'unreviewed') = 'unreviewed')
    SELECT * FROM r ORDER BY score DESC, timestamp, url, match_id LIMIT 100 OFFSET 5""",
)
def result_rows(spark, sf):
    """The second part of the unreviewed results that hold a word, with their notes and tags."""
    d = table(spark, sf, "documents")
    k = F.col("doc_id")
    docs = d.select(k.alias("document_id"), k.alias("capture_id"), F.lower(F.substring_index("text", "\n", 1)).alias("title"), F.col("text").alias("body"))
    captures = d.select(k.alias("capture_id"), F.concat(F.lit("http://d.example/"), (k % 90).cast("string")).alias("url"), F.lpad((k % 70).cast("string"), 14, "0").alias("timestamp"))
    notes = d.where("doc_id % 4 = 0").select(k.alias("match_id"), F.explode(F.array(F.struct(F.lit(1).alias("note_id"), F.concat(F.lit("first "), k.cast("string")).alias("text")), F.struct(F.lit(2).alias("note_id"), F.lit("second").alias("text")))).alias("n")).select("match_id", "n.*")
    tags = d.where("doc_id % 3 = 0").select(k.alias("match_id"), F.explode(F.when(k % 6 == 0, F.array(F.lit("b"), F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b")))).alias("tag"))
    reviews = _reviews(spark, sf).withColumnRenamed("doc_id", "match_id")
    return V.result_rows(_matches(spark, sf), docs, captures, reviews, notes, tags, run=1, least=10, status="unreviewed", search="Thing", limit=100, offset=5)


@query(
    "scan_coverage",
    Q._SCORED + """, m AS (SELECT count(*) FILTER (WHERE score >= 1) AS a, count(*) FILTER (WHERE score >= 1 AND doc_id % 2 = 0) AS b, count(*) AS n FROM z), e AS (SELECT count(*) FILTER (WHERE event_type = 'error' AND user_id % 5 = 0) AS n FROM events)
    SELECT 1 AS run_id, m.n AS documents, a AS scanned, e.n AS open_errors, a = m.n AND e.n = 0 AS complete FROM m, e UNION ALL SELECT 2, m.n, b, 0, b = m.n FROM m, e UNION ALL SELECT 3, m.n, m.n, 0, true FROM m, e""",
)
def scan_coverage(spark, sf):
    """Three runs: two that lack documents, one of them with open errors, and one that has scanned all."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"))
    every = docs.select(F.lit(0).cast("long").alias("match_id"), F.lit(3).alias("run_id"), "document_id", F.lit(0).alias("score"))
    e = table(spark, sf, "events").select(F.when(F.col("user_id") % 5 == 0, 1).otherwise(2).alias("run_id"), F.when(F.col("event_type") == "error", "scan").otherwise("download").alias("operation"), (F.col("user_id") % 5 != 0).alias("resolved"), F.lit(False).alias("ignored"))
    return V.coverage(docs, _matches(spark, sf).unionByName(every), e, spark.range(1, 4).select(F.col("id").cast("int").alias("run_id")))


@query("documents_unscanned", Q._SCORED + " SELECT 1 AS run_id, doc_id AS document_id FROM z WHERE score < 1 UNION ALL SELECT 2, doc_id FROM z WHERE score < 1 OR doc_id % 2 = 1")
def documents_unscanned(spark, sf):
    matches = _matches(spark, sf)
    return V.unscanned(table(spark, sf, "documents").select(F.col("doc_id").alias("document_id")), matches, matches.select("run_id"))


@query("runs_deleted", Q._SCORED + " SELECT run_id, count(*)::BIGINT AS n FROM (SELECT 1 AS run_id FROM z WHERE score >= 1 UNION ALL SELECT 3 FROM z) GROUP BY 1")
def runs_deleted(spark, sf):
    """A run is deleted from two tables that hang on it."""
    docs = table(spark, sf, "documents").select(F.lit(3).alias("run_id")).unionByName(table(spark, sf, "documents").select(F.lit(2).alias("run_id")))
    a, b = V.without_run(2, _matches(spark, sf).select("run_id"), docs)
    return a.unionByName(b).groupBy("run_id").agg(F.count("*").alias("n"))


@query("errors_resolved", "SELECT event_id, value > 50 OR user_id % 3 = 0 AS resolved, user_id % 7 = 1 AND event_type = 'error' AS ignored FROM events")
def errors_resolved(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", (F.col("value") > 50).alias("resolved"), F.lit(None).cast("boolean").alias("ignored"))
    e = V.resolved(V.resolved(e, F.col("user_id") % 3 == 0), (F.col("user_id") % 7 == 1) & (F.col("event_type") == "error"), "ignored")
    return e.select("event_id", "resolved", "ignored")


@query("dimension_keys", "SELECT DISTINCT source FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 50 = 0 AND source IS NOT NULL) AND source IS NOT NULL")
def dimension_keys(spark, sf):
    d = table(spark, sf, "documents")
    return V.new_keys(d.where("doc_id % 50 = 0").select("source"), d.where("source is not null"), "source")


@query(
    "documents_to_scan",
    "SELECT doc_id FROM documents WHERE doc_id % 5 <> 2 OR doc_id % 7 = 3",
)
def documents_to_scan(spark, sf):
    """Documents whose digest was not scanned: a fifth was, a seventh of it in another version."""
    d = table(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"))
    done = d.where("doc_id % 5 = 2").withColumn("digest", F.when(F.col("doc_id") % 7 == 3, F.lit("old")).otherwise(F.col("digest")))
    return M.changed_documents(d, done, "doc_id", "digest").select("doc_id")


@query(
    "archive_dates",
    """SELECT o_orderkey, strftime(d, '%Y%m%d') || '000000' AS first, CASE WHEN k = 3 THEN strftime(last_day(d), '%Y%m%d') WHEN k = 4 THEN strftime(d, '%Y') || '1231' ELSE strftime(d, '%Y%m%d') END || '235959' AS last
    FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 3 THEN date_trunc('month', o_orderdate) WHEN o_orderkey % 6 = 4 THEN date_trunc('year', o_orderdate) ELSE date_trunc('day', o_orderdate) END::DATE AS d, o_orderkey % 6 AS k FROM orders WHERE o_orderkey % 6 <> 5)
    UNION ALL SELECT o_orderkey, NULL, NULL FROM orders WHERE o_orderkey % 6 = 5""",
)
def archive_dates(spark, sf):
    """Dates of orders in six spellings, the last of them none."""
    spelt = F.element_at(F.array(*[F.date_format("o_orderdate", f) for f in ("yyyy-MM-dd", "MM/dd/yyyy", "yyyyMMdd", "yyyyMM", "yyyy", "'on' d MMMM")]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", T.archive_date(spelt).alias("first"), T.archive_date(spelt, end=True).alias("last"))


@query("replay_urls", "SELECT page_id, 'https://web.archive.org/web/2001' || lpad((page_id % 12 + 1)::VARCHAR, 2, '0') || '01000000id_/' || url AS replay, url AS original FROM pages")
def replay_urls(spark, sf):
    """Replay addresses of pages, and the pages' own addresses back out of them."""
    stamp = F.concat(F.lit("2001"), F.lpad((F.col("page_id") % 12 + 1).cast("string"), 2, "0"), F.lit("01000000"))
    p = table(spark, sf, "pages").select("page_id", T.replay_url("https://web.archive.org/web/", stamp, F.col("url")).alias("replay"))
    return p.select("page_id", "replay", T.without_replay(F.col("replay")).alias("original"))


@query("page_counts", "SELECT event_id, CASE event_id % 5 WHEN 3 THEN NULL ELSE (event_id * 7)::BIGINT END AS pages FROM events")
def page_counts(spark, sf):
    n = (F.col("event_id") * 7).cast("string")
    shapes = [n, F.concat(F.lit("["), n, F.lit("]")), F.concat(F.lit('{"numpages": "'), n, F.lit('"}')), F.lit("<html>no</html>"), F.concat(F.lit('{"a": 1, "pages" : '), n, F.lit("}"))]
    return table(spark, sf, "events").select("event_id", cdx.page_count(F.element_at(F.array(*shapes), (F.col("event_id") % 5 + 1).cast("int"))).alias("pages"))


@query(
    "files_integrity",
    "SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 11 = 1 THEN 'orphan' WHEN doc_id % 11 = 2 THEN 'size_differs' WHEN doc_id % 11 = 3 THEN 'digest_differs' ELSE 'ok' END AS state FROM documents",
)
def files_integrity(spark, sf):
    """Texts as files and what is recorded of them: some are missing, unknown, of another size or with another digest."""
    k = F.col("doc_id")
    d = table(spark, sf, "documents").select("doc_id", k.cast("string").alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content")).withColumn("size", F.octet_length("content"))
    records = d.where(k % 11 != 1).select("path", F.when(k % 11 == 2, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(k % 11 == 3, F.lit("0")).otherwise(F.sha2("content", 256)).alias("sha256"))
    return bodies.integrity(d.where(k % 11 != 0), records).select(F.col("path").cast("long").alias("doc_id"), "state")


@query("text_candidates", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE false END AS candidate FROM pages")
def text_candidates(spark, sf):
    from webstrata.operators.tables import captures

    return captures(spark, sf).select("page_id", C.text_candidate(F.col("url"), F.col("mimetype")).alias("candidate"))


@query(
    "media_policies",
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'video' WHEN 1 THEN 'audio' WHEN 2 THEN 'image' WHEN 3 THEN lower(p_brand) ELSE 'video' END AS kind, p_partkey % 5 IN (1, 2) AS allowed, p_partkey % 5 = 0 AS by_pattern FROM part""",
)
def media_policies(spark, sf):
    """Addresses made of parts: kinds by suffix or hint, an included and an excluded suffix, and a pattern over addresses."""
    k = F.col("p_partkey")
    ext = F.element_at(F.array(*map(F.lit, (".WMV;1", ".mp3", ".png?x=.wmv2", "", ".mp4"))), (k % 5 + 1).cast("int"))
    url = F.concat(F.lit("http://m.example/"), F.replace("p_name", F.lit(" "), F.lit("-")), ext)
    return table(spark, sf, "part").select("p_partkey", M.media_kind(url, F.col("p_brand")).alias("kind"), M.allowed(url, [".mp3"], [".wmv", ".mp4"]).alias("allowed"), F.rlike(url, F.lit(M.suffix_pattern([".wmv"]))).alias("by_pattern"))


@query("match_snippets")
def match_snippets(spark, sf):
    """All matches of three rules with their surroundings, title before body."""
    rules = K.parse_rules(["stupid", "regex: (?:disgust|idiot)\\w*", "License | case"])
    return RS.snippets(Q._fields(spark, sf), rules, {"title": ("title", "title_s"), "body": ("body", "body_s")}, "doc_id", radius=60)
