"""Queries: capture-index pages, domain lists, coverage, streams and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from webstrata.catalog import query, table
from webstrata.operators import reports as R
from webstrata.operators.tables import captures
from webstrata.sources import bodies, cdx
from webstrata.storage import new_path
from webstrata.streaming import counters, index_source, jobs, timers


def _index_pages(spark, sf):
    """Orders as pages of a capture index in JSON: a page for each customer, some of them broken on purpose."""
    o = table(spark, sf, "orders").select("o_custkey", F.struct(F.date_format("o_orderdate", "yyyyMMddHHmmss").alias("ts"), F.concat(F.lit("http://a.example/"), F.col("o_orderkey").cast("string")).alias("u")).alias("r"))
    rows = F.transform(F.sort_array(F.collect_list("r")), lambda r: F.array(r.ts, r.u))
    g = o.groupBy("o_custkey").agg(rows.alias("rows"))
    head = F.array(F.array(F.lit("timestamp"), F.lit("original")))
    ragged = F.array(F.array(F.lit("20000101000000")))
    tail = F.array(F.array().cast("array<string>"), F.array(F.lit("next")))
    k = F.col("o_custkey") % 10
    value = F.to_json(F.when(k == 3, F.concat(head, "rows", ragged)).when(k == 4, F.concat(head, "rows", tail)).otherwise(F.concat(head, "rows")))
    return g.select(F.col("o_custkey").cast("string").alias("page"), F.when(k == 5, "oops").otherwise(value).alias("value"))


@query(
    "cdx_json_pages",
    """SELECT o_custkey::VARCHAR AS page, CASE o_custkey % 10 WHEN 3 THEN 'ragged_row' WHEN 5 THEN 'not_an_array' END AS problem,
    CASE WHEN o_custkey % 10 = 4 THEN 'next' END AS resume, CASE WHEN o_custkey % 10 IN (3, 5) THEN 0 ELSE count(*) END::BIGINT AS n FROM orders GROUP BY o_custkey""",
)
def cdx_json_pages(spark, sf):
    p = cdx.parse_json(_index_pages(spark, sf))
    return p.select("page", "problem", "resume", F.when(F.col("problem").isNull(), F.size("records")).otherwise(0).cast("long").alias("n"))


@query(
    "cdx_json_rows",
    """SELECT o_custkey::VARCHAR AS page, strftime(o_orderdate, '%Y%m%d%H%M%S') AS timestamp, 'http://a.example/' || o_orderkey AS original,
    CASE WHEN strftime(o_orderdate, '%Y%m%d%H%M%S') BETWEEN '19930101' AND '1996' THEN 'ok' ELSE 'out_of_range' END AS scope
    FROM orders WHERE o_custkey % 10 NOT IN (3, 5)""",
)
def cdx_json_rows(spark, sf):
    rows = cdx.rows_of(cdx.parse_json(_index_pages(spark, sf)), ("timestamp", "original", "statuscode"))
    return cdx.in_scope(rows, "a.example", "19930101", "1996").select("page", "timestamp", "original", "scope")


@query(
    "cdx_text_pages",
    """SELECT conv_id::VARCHAR AS page, CASE WHEN conv_id % 7 = 1 THEN 'ragged_row' END AS problem, CASE WHEN conv_id % 5 = 2 THEN 'tok' END AS resume FROM conversations GROUP BY conv_id""",
)
def cdx_text_pages(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    line = F.lit("20060102030405 text/html 200 ABC 100 http://x.example/a b")
    value = F.concat(F.concat_ws("\n", F.array_repeat(line, F.col("n").cast("int"))), F.when(F.col("conv_id") % 7 == 1, "\nbroken line").otherwise(""), F.when(F.col("conv_id") % 5 == 2, "\n\ntok\n").otherwise("\n"))
    return cdx.parse_text(c.select(F.col("conv_id").cast("string").alias("page"), value.alias("value"))).select("page", "problem", "resume")


@query(
    "domain_list",
    """SELECT lower(regexp_extract(url, '//([^/?#:]+)', 1)) AS domain, count(*)::BIGINT AS lines FROM pages GROUP BY 1""",
)
def domain_list(spark, sf):
    return bodies.domain_list(table(spark, sf, "pages").select(F.concat(F.col("url"), F.lit(" # seen")).alias("value")))


@query("capture_inventory", """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'saved' WHEN page_id % 4 = 1 THEN 'skipped:media' ELSE 'pending' END AS coverage FROM pages""")
def capture_inventory(spark, sf):
    p = captures(spark, sf).select("page_id", "url")
    return R.inventory(p, p.where("page_id % 3 = 0"), p.where("page_id % 4 = 1").withColumn("routing", F.lit("media")), "page_id").select("page_id", "coverage")


@query("report_digest", "SELECT 'same rows' AS compared, count(*)::BIGINT AS n, true AS equal FROM labels UNION ALL SELECT 'one row less', count(*) - 1, false FROM labels")
def report_digest(spark, sf):
    """The digest does not depend on order and repartitioning, and tells when a row is gone."""
    rows = table(spark, sf, "labels")
    whole, dealt = R.digest_of(rows), R.digest_of(rows.repartition(7, "quality").select(*rows.columns))
    less = R.digest_of(rows.join(rows.agg(F.min("doc_id").alias("doc_id")), "doc_id", "left_anti").select(*rows.columns))
    pair = lambda name, other: whole.select(F.col("digest").alias("d")).join(other, F.lit(True)).select(F.lit(name).alias("compared"), "n", (F.col("d") == F.col("digest")).alias("equal"))  # noqa: E731 - one row each
    return pair("same rows", dealt).unionByName(pair("one row less", less))


@query("report_lines", "SELECT '| ' || r_regionkey || ' | ' || r_name || ' |' AS line FROM region UNION ALL SELECT * FROM (VALUES ('# regions'), (''), ('| r_regionkey | r_name |'), ('| --- | --- |')) v(x)")
def report_lines(spark, sf):
    return R.markdown_lines(table(spark, sf, "region").select("r_regionkey", "r_name"), "regions")


def _streamed(spark, sf, build, mode: str, keys: list[str] | None = None, closing: bool = False):
    """Run a stream over the event files to its end and return what it wrote.

    ``closing``: events are copied to a folder of their own and, once they are read, one event a year after the last follows,
    so that every window is closed; what that event makes is left out.
    """
    e, path = table(spark, sf, "events"), new_path(spark, "stream")
    if not closing:
        return jobs.run_to_end(build(jobs.event_stream(spark, sf, e.schema)), path, mode, keys)
    last = e.agg(F.max("ts").alias("ts")).select((F.col("ts") + F.expr("interval 365 days")).alias("ts"))
    end = last.select(*[F.col("ts") if c == "ts" else F.lit(None).cast(e.schema[c].dataType).alias(c) for c in e.columns])
    e.write.mode("append").parquet(f"{path}/in")
    for _ in range(2):
        stream = build(jobs.event_stream(spark, f"{path}/in", e.schema, ""))
        out = jobs.run_to_end(stream, path, mode, keys)
        end.write.mode("append").parquet(f"{path}/in")
    return out


@query("stream_running_counts", "SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY 1")
def stream_running_counts(spark, sf):
    return _streamed(spark, sf, lambda e: jobs.running_counts(e, "event_type"), "complete").select("event_type", "n")


@query("stream_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark, sf):
    out = _streamed(spark, sf, jobs.windowed_counts, "append", closing=True)
    return out.where("event_type is not null").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "stream_sessions",
    """WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM m)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*)::BIGINT AS n FROM s GROUP BY user_id, k""",
)
def stream_sessions(spark, sf):
    out = _streamed(spark, sf, jobs.sessions, "append", closing=True).where("user_id is not null")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query(
    "stream_retry_schedule",
    """SELECT user_id, n::INTEGER AS attempts, last + to_microseconds(floor(least(3600::DOUBLE, 30 * power(2::DOUBLE, least(12, n - 1))) * (0.9::DOUBLE + (user_id % 17)::DOUBLE / 85) * 1000000)::BIGINT) AS due FROM (
    SELECT user_id, max(ts) AS last, count(*) FILTER (WHERE k > coalesce(other, 0)) AS n FROM (SELECT *, max(k) FILTER (WHERE event_type <> 'error') OVER (PARTITION BY user_id) AS other FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)) GROUP BY user_id) WHERE n > 0""",
)
def stream_retry_schedule(spark, sf):
    out = _streamed(spark, sf, jobs.retry_schedule, "update", ["user_id"]).where("attempts > 0")
    return out.select("user_id", "attempts", F.col("due").cast("timestamp_ntz").alias("due"))


_TIMER_HOURS, _TIMER_LIMIT, _BUDGET_HOURS = 6, 3, 20


@query(
    "stream_retry_timers",
    f"""WITH o AS (SELECT *, event_type = 'error' AS failed, epoch_us(ts) AS t FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL),
    s AS (SELECT *, lead(t) OVER w AS next_t, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER w AS streak FROM o WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
    k AS (SELECT *, row_number() OVER w AS k, min(t) OVER (PARTITION BY user_id, streak) + {_BUDGET_HOURS}::BIGINT * 3600000000 AS stop FROM s WHERE failed WINDOW w AS (PARTITION BY user_id, streak ORDER BY t, event_id)),
    d AS (SELECT *, t + floor(least(86400::DOUBLE, {_TIMER_HOURS * 3600} * power(2::DOUBLE, least(12, k - 1))) * (0.9::DOUBLE + (user_id % 17)::DOUBLE / 85) * 1000000)::BIGINT AS due, k >= {_TIMER_LIMIT} OR t >= stop AS spent FROM k),
    e AS (SELECT *, NOT spent AND due >= stop AND (next_t IS NULL OR next_t > stop) AS ran_out FROM d),
    f AS (SELECT *, coalesce(bool_or(spent OR ran_out) OVER (PARTITION BY user_id, streak ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS before FROM e)
    SELECT user_id AS capture_id, CASE WHEN spent OR ran_out THEN 'end' ELSE 'attempt' END AS kind, k::INTEGER AS attempts, make_timestamp(CASE WHEN spent THEN t WHEN ran_out THEN stop ELSE due END) AS "at" FROM f
    WHERE NOT before AND (spent OR ran_out OR (due < stop AND (next_t IS NULL OR next_t > due)))""",
)
def stream_retry_timers(spark, sf):
    """Errors as failed attempts: six hours to the first attempt, at most three failures or twenty hours without a success."""
    made = lambda e: timers.retry_timers(e, base=_TIMER_HOURS * 3600, most=86400, limit=_TIMER_LIMIT, seconds=_BUDGET_HOURS * 3600)
    with timers.rocksdb_state(spark):
        out = _streamed(spark, sf, made, "append", closing=True)
    return out.select("capture_id", "kind", "attempts", F.col("at").cast("timestamp_ntz").alias("at"))


def written_index(spark, orders, path: str, rows_in_page: int, full: bool = False) -> None:
    """Orders as an index on disk: a window for each year, a chain of pages by ranges of order keys, each with the key of the next.

    A range has as many keys as a page may have rows, most of them in other windows; ``full``: ranges are put together until a page has its rows.
    """
    r = F.array(F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.concat(F.lit("http://a.example/"), F.col("o_orderkey").cast("string")))
    placed = orders.select(F.date_format("o_orderdate", "yyyy").alias("window"), F.floor(F.col("o_orderkey") / rows_in_page).alias("number"), r.alias("r"))
    if full:
        w = Window.partitionBy("of").orderBy("range")  # of a window's ranges, not its rows
        sums = placed.groupBy(F.col("window").alias("of"), F.col("number").alias("range")).count()
        page = sums.select("of", "range", F.floor((F.sum("count").over(w) - 1) / rows_in_page).alias("page"))
        placed = placed.join(page, F.col("window").eqNullSafe(F.col("of")) & F.col("number").eqNullSafe(F.col("range"))).select("window", F.col("page").alias("number"), "r")
    pages = placed.groupBy("window", "number").agg(F.sort_array(F.collect_list("r")).alias("rows"))
    w = Window.partitionBy("window").orderBy("number")  # of a window's pages, not its rows
    key = F.substring(F.sha2(F.concat_ws("|", "window", F.col("number").cast("string")), 256), 1, 16)
    keyed = pages.withColumn("own", key).withColumn("next", F.lead("own").over(w)).withColumn("key", F.when(F.lag("own").over(w).isNull(), index_source.FIRST).otherwise(F.col("own")))
    tail = F.when(F.col("next").isNotNull(), F.array(F.array().cast("array<string>"), F.array("next"))).otherwise(F.array().cast("array<array<string>>"))
    value = F.to_json(F.concat(F.array(F.array(F.lit("timestamp"), F.lit("original"))), "rows", tail))
    keyed.select("window", "key", value.alias("value")).repartition("window", "key").write.partitionBy("window", "key").text(path)


@query("stream_index_pages", "SELECT strftime(o_orderdate, '%Y') AS window, strftime(o_orderdate, '%Y%m%d%H%M%S') AS timestamp, 'http://a.example/' || o_orderkey AS original FROM orders")
def stream_index_pages(spark, sf):
    """The index read as a stream, five pages of each window at a time, by the resume keys in its pages."""
    path = new_path(spark, "index")
    written_index(spark, table(spark, sf, "orders"), f"{path}/pages", 5000, full=True)
    pages = index_source.pages_to_end(index_source.index_stream(spark, f"{path}/pages", 5), path)
    named = pages.select(F.concat_ws("/", "window", "page").alias("page"), "value")
    return cdx.rows_of(cdx.parse_json(named), ("timestamp", "original")).select(F.substring_index("page", "/", 1).alias("window"), "timestamp", "original")


_STATE = "CASE WHEN b >= 2 AND o_orderkey % 3 = 0 THEN 'audited' ELSE o_orderstatus END"


@query(
    "dashboard_maintained",
    f"""SELECT b AS batch, {_STATE} AS status, o_orderpriority AS priority, count(*)::BIGINT AS n FROM orders, (VALUES (1), (2), (3)) v(b)
    WHERE b < 3 OR o_orderkey % 5 <> 0 GROUP BY ALL""",
)
def dashboard_maintained(spark, sf):
    """Counters after each of three batches of changes: all orders come, some change their status, some go and late changes come."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    row = lambda rows, n, gone=False: rows.withColumns({"sequence": F.lit(n), "gone": F.lit(gone)})
    changes = [
        row(o, 10),
        row(o.where("o_orderkey % 3 = 0").withColumn("status", F.lit("audited")), 20).unionByName(row(o.where("o_orderkey % 4 = 1"), 15)),
        row(o.where("o_orderkey % 5 = 0"), 30, True).unionByName(row(o.where("o_orderkey % 7 = 0").withColumn("status", F.lit("late")), 5)),
    ]
    path, out = new_path(spark, "changes"), []
    for k, batch in enumerate(changes, 1):
        batch.write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(batch.schema).parquet(f"{path}/in")
        kept = counters.keep_counters(stream, path, "o_orderkey", "sequence", "gone", ["status", "priority"])
        out.append(kept.select(F.lit(k).alias("batch"), "status", "priority", "n"))
    return out[0].unionByName(out[1]).unionByName(out[2])
