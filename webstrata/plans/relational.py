"""Queries: counts, joins, windows, sets, ordering and merges over the collection's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from webstrata.catalog import query, table
from webstrata.operators import shaping as S
from webstrata.operators.tables import REVIEW_STATES, operation_log, snapshots


def _reviews(spark, sf):
    """Labels as reviews: quality 1 is relevant, toxic 1 is false_positive, the rest open."""
    state = F.when(F.col("toxic") == 1, "false_positive").when(F.col("quality") == 1, "relevant").otherwise("unreviewed")
    return table(spark, sf, "labels").select("doc_id", state.alias("status"))


_REVIEWS = "(SELECT doc_id, CASE WHEN toxic = 1 THEN 'false_positive' WHEN quality = 1 THEN 'relevant' ELSE 'unreviewed' END AS status FROM labels)"


@query("status_counts", f"SELECT status, count(*)::BIGINT AS n FROM {_REVIEWS} GROUP BY status")
def status_counts(spark, sf):
    return S.counts_of(_reviews(spark, sf), "status")


_STATES_SQL = ", ".join(f"('{s}')" for s in REVIEW_STATES)


@query("class_totals_zero_filled", f"SELECT s.status, count(r.doc_id)::BIGINT AS n FROM (VALUES {_STATES_SQL}) s(status) LEFT JOIN {_REVIEWS} r ON r.status = s.status GROUP BY s.status")
def class_totals_zero_filled(spark, sf):
    return S.zero_filled(S.counts_of(_reviews(spark, sf), "status"), "status", list(REVIEW_STATES))


@query(
    "three_key_counts",
    f"""SELECT d.lang, d.source, coalesce(r.status, 'none') AS status, count(*)::BIGINT AS n
    FROM documents d LEFT JOIN {_REVIEWS} r USING (doc_id) GROUP BY 1, 2, 3""",
)
def three_key_counts(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    return S.counts_of(d.join(_reviews(spark, sf), "doc_id", "left"), "lang", "source", "status")


@query(
    "conditional_counts",
    """SELECT count(*) FILTER (WHERE value > 50)::BIGINT AS high, count(*) FILTER (WHERE event_type = 'error')::BIGINT AS errors,
    count(*) FILTER (WHERE user_id % 2 = 0)::BIGINT AS even_users, count(*) FILTER (WHERE props IS NULL)::BIGINT AS bare FROM events""",
)
def conditional_counts(spark, sf):
    e = table(spark, sf, "events")
    return S.conditional_counts(e, high=F.col("value") > 50, errors=F.col("event_type") == "error", even_users=F.col("user_id") % 2 == 0, bare=F.col("props").isNull())


@query("distinct_counts", "SELECT lang, count(DISTINCT source)::BIGINT AS sources, count(DISTINCT md5(text))::BIGINT AS texts FROM documents GROUP BY lang")
def distinct_counts(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.count_distinct("source").alias("sources"), F.count_distinct(F.md5(F.col("text").cast("binary"))).alias("texts"))


@query("groups_of_several", "SELECT md5(text) AS digest, count(*)::BIGINT AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def groups_of_several(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    return d.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query(
    "size_totals",
    "SELECT source, sum(n_chars)::BIGINT AS total, max(n_chars) AS longest, min(n_chars) AS shortest, coalesce(sum(CASE WHEN lang = 'de' THEN n_chars END), 0)::BIGINT AS german FROM documents GROUP BY source",
)
def size_totals(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(
        F.sum("n_chars").alias("total"), F.max("n_chars").alias("longest"), F.min("n_chars").alias("shortest"),
        F.coalesce(F.sum(F.when(F.col("lang") == "de", F.col("n_chars"))), F.lit(0)).cast("long").alias("german"),
    )


@query("tags_joined", "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS tags FROM events GROUP BY user_id")
def tags_joined(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("tags"))


@query(
    "error_rollup",
    """SELECT user_id AS capture_id, event_type AS category, CAST(json_extract_string(props, '$.k') AS INTEGER) AS stage, count(*)::BIGINT AS attempts,
    min(ts) AS first_seen, max(ts) AS last_seen, arg_max(value, event_id) AS last_value
    FROM events WHERE event_type = 'error' GROUP BY 1, 2, 3""",
)
def error_rollup(spark, sf):
    log = operation_log(spark, sf).where(F.col("category") == "error")
    return log.groupBy("capture_id", "category", "stage").agg(
        F.count("*").alias("attempts"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max_by("value", "event_id").alias("last_value")
    )


@query(
    "error_rollup_daily",
    """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS category, left(sha256(event_type || chr(0) || left(coalesce(props, ''), 200)), 20) AS fingerprint,
    count(*)::BIGINT AS n, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY 1, 2, 3""",
)
def error_rollup_daily(spark, sf):
    e = table(spark, sf, "events")
    mark = F.substring(F.sha2(F.concat(F.col("event_type"), F.lit("\0"), F.substring(F.coalesce("props", F.lit("")), 1, 200)).cast("binary"), 256), 1, 20)
    return e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("category"), mark.alias("fingerprint")).agg(
        F.count("*").alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")
    )


@query(
    "thread_stats",
    """SELECT conv_id, count(*)::BIGINT AS posts, count(DISTINCT role)::BIGINT AS roles, min(turn) AS first_turn, max(turn) AS last_turn,
    arg_min(text, (-length(text), turn)) AS longest FROM conversations GROUP BY conv_id""",
)
def thread_stats(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("posts"), F.count_distinct("role").alias("roles"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"),
        F.min_by("text", F.struct(-F.length("text"), "turn")).alias("longest"),
    )


@query(
    "run_summary",
    f"""SELECT count(*)::BIGINT AS documents, count(r.doc_id)::BIGINT AS matches, max(d.n_chars) AS largest,
    round(coalesce(avg(d.n_chars), 0), 4) AS mean_chars FROM documents d LEFT JOIN {_REVIEWS} r ON r.doc_id = d.doc_id AND r.status = 'relevant'""",
)
def run_summary(spark, sf):
    r = _reviews(spark, sf).where("status = 'relevant'")
    return table(spark, sf, "documents").select("doc_id", "n_chars").join(r, "doc_id", "left").agg(
        F.count("*").alias("documents"), F.count("status").alias("matches"), F.max("n_chars").alias("largest"), F.round(F.coalesce(F.avg("n_chars"), F.lit(0)), 4).alias("mean_chars")
    )


@query(
    "first_note_and_best",
    """SELECT c.c_custkey, (SELECT min(o_orderkey) FROM orders o WHERE o.o_custkey = c.c_custkey) AS first_order,
    (SELECT max(o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS best FROM customer c""",
)
def first_note_and_best(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("first_order"), F.max("o_totalprice").alias("best"))
    return table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left")


@query("earliest_per_url", "SELECT source AS url, doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1")
def earliest_per_url(spark, sf):
    return S.pick(snapshots(spark, sf).select("url", "doc_id", "lang"), ["url"], [F.asc("doc_id")])


@query("latest_per_url", "SELECT source AS url, doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) = 1")
def latest_per_url(spark, sf):
    return S.pick(snapshots(spark, sf).select("url", "doc_id", "lang"), ["url"], [F.desc("doc_id")])


@query(
    "snapshot_states",
    """SELECT source AS url, doc_id, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1 THEN 'pending' ELSE 'skipped_strategy' END AS state FROM documents""",
)
def snapshot_states(spark, sf):
    w = Window.partitionBy("url").orderBy("doc_id")
    return snapshots(spark, sf).select("url", "doc_id", F.when(F.row_number().over(w) == 1, "pending").otherwise("skipped_strategy").alias("state"))


@query("first_last_in_group", "SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_type, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY user_id")
def first_last_in_group(spark, sf):
    at = F.struct("ts", "event_id")
    return table(spark, sf, "events").groupBy("user_id").agg(F.min_by("event_type", at).alias("first_type"), F.max_by("event_type", at).alias("last_type"))


@query("distinct_pairs", "SELECT DISTINCT lang, source FROM documents")
def distinct_pairs(spark, sf):
    return table(spark, sf, "documents").select("lang", "source").distinct()


@query("ordered_distinct", "SELECT event_type, min(event_id) AS event_id FROM events GROUP BY event_type")
def ordered_distinct(spark, sf):
    return S.ordered_distinct(table(spark, sf, "events"), "event_type", "event_id")


@query(
    "set_ops",
    """SELECT 'union' AS op, count(*)::BIGINT AS n FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)
    UNION ALL SELECT 'both', count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)
    UNION ALL SELECT 'customers_only', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)
    UNION ALL SELECT 'all', count(*) FROM (SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier)""",
)
def set_ops(spark, sf):
    c, s = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    parts = {"union": c.union(s).distinct(), "both": c.intersect(s), "customers_only": c.subtract(s), "all": c.unionAll(s)}
    out = None
    for name, rows in parts.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("ranked_orders", "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderdate, o_orderkey)::INTEGER AS rank FROM orders ORDER BY rank LIMIT 100")
def ranked_orders(spark, sf):
    # a report of the best 100: the limit comes first, so only those rows are numbered
    top = table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderdate", "o_orderkey").limit(100)
    return top.select("o_orderkey", "o_totalprice", F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderdate", "o_orderkey")).alias("rank"))


@query("result_page", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50 OFFSET 100")
def result_page(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").offset(100).limit(50)


@query(
    "ordered_queue",
    """SELECT doc_id, n_chars, CASE WHEN n_chars <= 0 THEN 1 ELSE 0 END AS unknown FROM documents ORDER BY unknown, n_chars, doc_id LIMIT 500""",
)
def ordered_queue(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars", F.when(F.col("n_chars") <= 0, 1).otherwise(0).alias("unknown"))
    return d.orderBy("unknown", "n_chars", "doc_id").limit(500)


def _runs(spark, sf):
    """Two runs with scores: by price for even orders and orders over a price, by another formula for the rest."""
    o = table(spark, sf, "orders")
    a = o.where("o_orderkey % 3 <> 0").select("o_orderkey", (F.col("o_totalprice") % 100).cast("int").alias("score"))
    b = o.where("o_orderkey % 4 <> 0").select("o_orderkey", (F.col("o_totalprice") % 77).cast("int").alias("score"))
    return a, b


_RUNS = """a AS (SELECT o_orderkey, CAST(trunc(o_totalprice % 100) AS INTEGER) AS score FROM orders WHERE o_orderkey % 3 <> 0),
b AS (SELECT o_orderkey, CAST(trunc(o_totalprice % 77) AS INTEGER) AS score FROM orders WHERE o_orderkey % 4 <> 0)"""


@query(
    "run_comparison",
    f"""WITH {_RUNS} SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, a.score AS score_a, b.score AS score_b,
    CASE WHEN a.o_orderkey IS NULL THEN 'only_b' WHEN b.o_orderkey IS NULL THEN 'only_a' ELSE 'both' END AS bucket, b.score - a.score AS delta
    FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey""",
)
def run_comparison(spark, sf):
    return S.compare_runs(*_runs(spark, sf), "o_orderkey", "score")


@query("largest_deltas", f"WITH {_RUNS} SELECT o_orderkey, b.score - a.score AS delta FROM a JOIN b USING (o_orderkey) ORDER BY abs(b.score - a.score) DESC, o_orderkey LIMIT 50")
def largest_deltas(spark, sf):
    both = S.compare_runs(*_runs(spark, sf), "o_orderkey", "score").where("bucket = 'both'")
    return both.orderBy(F.desc(F.abs("delta")), "o_orderkey").limit(50).select("o_orderkey", "delta")


@query("admission_check", "SELECT c_mktsegment, bool_or(NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS has_gap FROM customer GROUP BY 1")
def admission_check(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    open_ = c.join(o, "c_custkey", "left_anti").groupBy("c_mktsegment").agg(F.lit(True).alias("g"))
    return c.select("c_mktsegment").distinct().join(open_, "c_mktsegment", "left").select("c_mktsegment", F.coalesce("g", F.lit(False)).alias("has_gap"))


@query("dashboard_buckets", "SELECT source, " + ", ".join(f"count(*) FILTER (WHERE lang = '{x}')::BIGINT AS {x}" for x in ("de", "en", "es", "fr")) + " FROM documents GROUP BY source")
def dashboard_buckets(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(*[F.count_if(F.col("lang") == x).alias(x) for x in ("de", "en", "es", "fr")])


@query("cube_rollup", "SELECT lang, source, count(*)::BIGINT AS n, grouping(lang, source)::INTEGER AS level FROM documents GROUP BY CUBE (lang, source)")
def cube_rollup(spark, sf):
    d = table(spark, sf, "documents")
    return d.cube("lang", "source").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


@query(
    "match_document_capture",
    """SELECT l.l_orderkey, l.l_linenumber, o.o_custkey, c.c_name FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey WHERE l.l_quantity > 45""",
)
def match_document_capture(spark, sf):
    l = table(spark, sf, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_linenumber")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    return l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).select("l_orderkey", "l_linenumber", "o_custkey", "c_name")


@query("review_default", f"SELECT d.doc_id, coalesce(r.status, 'unreviewed') AS status FROM documents d LEFT JOIN {_REVIEWS} r USING (doc_id)")
def review_default(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(_reviews(spark, sf), "doc_id", "left").select("doc_id", F.coalesce("status", F.lit("unreviewed")).alias("status"))


@query(
    "error_context",
    """SELECT e.event_id, c.c_name, n.n_name, r.r_name FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
    LEFT JOIN region r ON r.r_regionkey = n.n_regionkey WHERE e.event_type = 'error'""",
)
def error_context(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'error'").select("event_id", "user_id")
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    joined = e.join(c, e.user_id == c.c_custkey, "left").join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left")
    return joined.select("event_id", "c_name", "n_name", "r_name")


@query("semi_scope", "SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def semi_scope(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels").where("quality = 1"), "doc_id", "left_semi")


@query("anti_unscanned", "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_unscanned(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id", "left_anti")


@query(
    "or_semi_scope",
    """SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""",
)
def or_semi_scope(spark, sf):
    c = table(spark, sf, "customer")
    direct = c.where("c_mktsegment = 'BUILDING'").select("c_custkey")
    member = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return c.select("c_custkey").join(direct.union(member), "c_custkey", "left_semi")


_SCOPES = [("BUILDING", 0.0, 2000.0), ("AUTOMOBILE", 1000.0, 5000.0), ("BUILDING", 8000.0, 9000.0)]
_SCOPES_SQL = ", ".join(f"('{a}', {b}, {c})" for a, b, c in _SCOPES)


@query("range_join_scope", f"SELECT DISTINCT c_custkey FROM customer JOIN (VALUES {_SCOPES_SQL}) s(seg, low, high) ON c_mktsegment = seg AND c_acctbal BETWEEN low AND high")
def range_join_scope(spark, sf):
    scope = S.frame(spark, _SCOPES, "seg string, low double, high double")  # parameters: a few rows
    c = table(spark, sf, "customer")
    return c.join(F.broadcast(scope), (c.c_mktsegment == scope.seg) & c.c_acctbal.between(scope.low, scope.high), "left_semi").select("c_custkey")


@query("prefix_range_join", "SELECT p_partkey, p_name FROM part WHERE p_name >= 'b' AND p_name < 'b' || chr(1114111)")
def prefix_range_join(spark, sf):
    return table(spark, sf, "part").where(F.startswith("p_name", F.lit("b"))).select("p_partkey", "p_name")


@query(
    "edges_of_results",
    """SELECT src, dst FROM (SELECT l_partkey AS src, l_suppkey AS dst FROM lineitem) e WHERE src IN (SELECT p_partkey FROM part WHERE p_size = 1)
    UNION SELECT src, dst FROM (SELECT l_partkey AS src, l_suppkey AS dst FROM lineitem) e WHERE dst IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3)""",
)
def edges_of_results(spark, sf):
    e = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    p = table(spark, sf, "part").where("p_size = 1").select(F.col("p_partkey").alias("src"))
    s = table(spark, sf, "supplier").where("s_nationkey = 3").select(F.col("s_suppkey").alias("dst"))
    return e.join(p, "src", "left_semi").select("src", "dst").union(e.join(s, "dst", "left_semi").select("src", "dst")).distinct()


@query(
    "merge_upsert",
    """WITH old AS (SELECT p_partkey, p_brand, p_size, p_name FROM part WHERE p_partkey % 5 <> 0),
    new AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'Brand#99' ELSE p_brand END AS p_brand, p_size, 'new ' || p_name AS p_name FROM part WHERE p_partkey % 3 = 0)
    SELECT coalesce(o.p_partkey, n.p_partkey) AS p_partkey, CASE WHEN n.p_partkey IS NOT NULL THEN n.p_brand ELSE o.p_brand END AS p_brand,
    CASE WHEN n.p_partkey IS NOT NULL THEN n.p_size ELSE o.p_size END AS p_size, CASE WHEN o.p_partkey IS NOT NULL THEN o.p_name ELSE n.p_name END AS p_name,
    CASE WHEN o.p_partkey IS NULL THEN 'added' WHEN n.p_partkey IS NULL THEN 'kept'
    WHEN o.p_brand IS NOT DISTINCT FROM n.p_brand AND o.p_size IS NOT DISTINCT FROM n.p_size THEN 'unchanged' ELSE 'changed' END AS change
    FROM old o FULL JOIN new n ON o.p_partkey = n.p_partkey""",
)
def merge_upsert(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size", "p_name")
    new = p.where("p_partkey % 3 = 0").withColumns({"p_brand": F.when(F.col("p_partkey") % 7 == 0, "Brand#99").otherwise(F.col("p_brand")), "p_name": F.concat(F.lit("new "), F.col("p_name"))})
    return S.merged(p.where("p_partkey % 5 <> 0"), new, ["p_partkey"], ["p_brand", "p_size"], ["p_name"])


@query(
    "review_overlay",
    """SELECT user_id AS match_id, arg_max(event_type, event_id) AS status, CASE WHEN arg_max(event_type, event_id) = 'view' THEN NULL ELSE arg_max(ts, event_id) END AS reviewed_at
    FROM events GROUP BY user_id""",
)
def review_overlay(spark, sf):
    log = table(spark, sf, "events").select(F.col("user_id").alias("match_id"), F.col("event_type").alias("status"), "ts", "event_id")
    now = S.latest(log, ["match_id"], "event_id", ["status", "ts"])
    return now.select("match_id", "status", F.when(F.col("status") != "view", F.col("ts")).alias("reviewed_at"))


@query(
    "repeat_failures",
    """WITH o AS (SELECT *, first_value(event_type) OVER w AS last_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id DESC)),
    s AS (SELECT *, sum(CASE WHEN event_type = last_type THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM o)
    SELECT user_id, any_value(event_type) AS event_type, count(*)::BIGINT AS repeats FROM s WHERE k = 0 GROUP BY user_id""",
)
def repeat_failures(spark, sf):
    return S.consecutive_repeats(table(spark, sf, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type")


@query(
    "coverage_gaps",
    """WITH r AS (SELECT user_id, (event_id % 997)::BIGINT AS a, (event_id % 997 + 3 + user_id % 5)::BIGINT AS b FROM events),
    c AS (SELECT user_id, greatest(a, 10) AS a, least(b, 900) AS b FROM r WHERE b >= 10 AND a <= 900),
    m AS (SELECT user_id, a, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM c
    UNION ALL SELECT u, 901, (SELECT max(b) FROM c WHERE c.user_id = u) FROM (SELECT DISTINCT user_id AS u FROM r))
    SELECT user_id, coalesce(seen + 1, 10) AS gap_start, a - 1 AS gap_end FROM m WHERE a > coalesce(seen + 1, 10)""",
)
def coverage_gaps(spark, sf):
    e = table(spark, sf, "events")
    r = e.select("user_id", (F.col("event_id") % 997).alias("a"), (F.col("event_id") % 997 + 3 + F.col("user_id") % 5).alias("b"))
    return S.gaps(r, ["user_id"], "a", "b", F.lit(10).cast("long"), F.lit(900).cast("long"))


@query(
    "window_split",
    """SELECT o_orderkey, strftime(s, '%Y%m%d%H%M%S') AS start, strftime(s + to_minutes(m) - INTERVAL 1 SECOND, '%Y%m%d%H%M%S') AS "end"
    FROM (SELECT o_orderkey, m, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + to_minutes(m * unnest(range(0, (120 + 60 * (o_orderkey % 2)) // m))) AS s
    FROM (SELECT *, CASE WHEN o_orderkey % 2 = 1 THEN 60 ELSE 15 END AS m FROM orders))""",
)
def window_split(spark, sf):
    """Windows of three hours are cut into hours; those of two hours, a second short of two hours from start to end, into quarters of an hour."""
    from webstrata.operators import windows as W

    o = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").cast("timestamp").alias("d"))
    high = F.col("d") + F.make_dt_interval(hours=(F.col("o_orderkey") % 2 + 2).cast("int")) - F.expr("interval 1 second")
    return W.split(o.select("o_orderkey", F.date_format("d", "yyyyMMddHHmmss").alias("low"), F.date_format(high, "yyyyMMddHHmmss").alias("high")), ["o_orderkey"], "low", "high")


@query(
    "missing_page",
    """SELECT l_orderkey, min(k)::INTEGER AS first_missing FROM (SELECT l_orderkey, unnest(range(1, 9)) AS k FROM (SELECT DISTINCT l_orderkey FROM lineitem))
    WHERE (l_orderkey, k) NOT IN (SELECT l_orderkey, l_linenumber FROM lineitem) GROUP BY l_orderkey""",
)
def missing_page(spark, sf):
    l = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("have"))
    return l.select("l_orderkey", F.array_min(F.array_except(F.sequence(F.lit(1), F.lit(8)), "have")).alias("first_missing")).where("first_missing is not null")


@query("site_reasons", "SELECT user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'error' THEN 0 ELSE 1 END, ts DESC, event_id DESC) = 1")
def site_reasons(spark, sf):
    e = table(spark, sf, "events")
    first = F.struct(F.when(F.col("event_type") == "error", 1).otherwise(0), "ts", "event_id")
    return e.groupBy("user_id").agg(F.max_by(F.struct("event_type", "value"), first).alias("v")).select("user_id", "v.*")


@query(
    "outcome_counts",
    """SELECT o_orderstatus, sum(CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END)::BIGINT AS done, sum(CASE WHEN o_totalprice BETWEEN 50000 AND 200000 THEN 1 ELSE 0 END)::BIGINT AS open,
    sum(CASE WHEN o_totalprice < 50000 THEN 1 ELSE 0 END)::BIGINT AS unavailable FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY 1""",
)
def outcome_counts(spark, sf):
    scope = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    p = F.col("o_totalprice")
    return table(spark, sf, "orders").join(scope, "o_custkey", "left_semi").groupBy("o_orderstatus").agg(
        F.count_if(p > 200000).alias("done"), F.count_if(p.between(50000, 200000)).alias("open"), F.count_if(p < 50000).alias("unavailable")
    )


@query("retry_plan", "SELECT event_id, round(least(3600.0, 30.0 * pow(2.0, least(12, user_id % 9))) * (0.90 + (event_id % 17) / 85.0), 6) AS delay FROM events")
def retry_plan(spark, sf):
    from webstrata.functions.text import retry_delay

    e = table(spark, sf, "events")
    return e.select("event_id", F.round(retry_delay(F.col("user_id") % 9 + 1, F.col("event_id"), 30, 3600), 6).alias("delay"))


@query(
    "session_windows",
    """WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM m)
    SELECT user_id, min(ts) AS session_start, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""",
)
def session_windows(spark, sf):
    e = table(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("t", "30 minutes")).agg(F.min("ts").alias("session_start"), F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).drop("session_window")


@query("tumbling_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def tumbling_windows(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("n"))
