"""Queries: searches by domain, adopted inventories, media checks, sweeps and reports, names and proofs of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from webstrata.catalog import query, table
from webstrata.operators import acquisition as A

_LOW, _HIGH = "20000101000000", "20991231235959"


def _searches(spark, sf):
    """Users as domains and their events as the first page of captures of each."""
    e, u, k = table(spark, sf, "events"), F.col("user_id"), F.col("event_id")
    domain = F.concat(F.lit("d"), u.cast("string"), F.lit(".example"))
    scheme = F.when((u % 7 == 3) & (k % 5 == 0), "ftp://").when(k % 4 == 0, "https://www.").otherwise("http://")
    rows = e.select(domain.alias("domain"), F.concat(scheme, domain, F.lit("/p"), (k % 3).cast("string")).alias("url"), F.date_format("ts", "yyyyMMddHHmmss").alias("timestamp"), F.lit("200").alias("status"))
    pages = e.select(u.alias("u"), domain.alias("domain")).distinct()
    pages = pages.select("domain", F.when(F.col("u") % 11 == 4, 503).otherwise(200).alias("http_status"), F.when(F.col("u") % 5 == 0, "next").alias("resume"))
    return A.searched_domains(pages, rows, _LOW, _HIGH, 10**9)


_STATES_SQL = """SELECT user_id AS u, CASE WHEN user_id % 11 = 4 THEN 'HTTP 503' WHEN bool_or(user_id % 7 = 3 AND event_id % 5 = 0) THEN 'row out of scope' WHEN user_id % 5 = 0 THEN 'page limit' ELSE '' END AS reason FROM events GROUP BY user_id"""


@query("searched_domains", f"SELECT 'd' || u || '.example' AS domain, CASE reason WHEN '' THEN 'searched' WHEN 'page limit' THEN 'limited' ELSE 'deferred' END AS state, reason FROM ({_STATES_SQL})")
def searched_domains(spark, sf):
    return _searches(spark, sf)[0].select("domain", "state", "reason")


@query(
    "discovered_urls",
    f"""SELECT CASE WHEN user_id % 7 = 3 AND event_id % 5 = 0 THEN 'ftp://' WHEN event_id % 4 = 0 THEN 'https://www.' ELSE 'http://' END || 'd' || user_id || '.example/p' || (event_id % 3) AS url, min(strftime(ts, '%Y%m%d%H%M%S')) AS timestamp
    FROM events JOIN ({_STATES_SQL}) ON u = user_id WHERE reason IN ('', 'page limit') GROUP BY 1""",
)
def discovered_urls(spark, sf):
    return _searches(spark, sf)[1].select("url", "timestamp")


def _signatures(spark, sf):
    """Orders as captures under three signatures, and years of them as coverage."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = table(spark, sf, "orders").select(k.alias("capture_id"), (c % 5).alias("target"), F.concat(F.lit("http://a.example/"), (k % 400).cast("string")).alias("url"), F.date_format("o_orderdate", "yyyyMM'01000000'").alias("timestamp"), (k % 3).alias("s"))
    o = o.groupBy("url", "timestamp", "s").agg(F.min("capture_id").alias("capture_id"), F.min_by("target", "capture_id").alias("target"))
    captures = o.select("capture_id", "target", "url", "timestamp", F.concat(F.lit("s"), F.col("s").cast("string")).alias("signature"))
    years = captures.select("target", "signature", F.substring("timestamp", 1, 4).alias("y")).distinct().where("not (signature = 's0' and y % 2 = 0) and not (signature = 's1' and y % 3 = 0)")
    coverage = years.select("target", "signature", F.concat("y", F.lit("0101000000")).alias("start"), F.concat("y", F.lit("1231235959")).alias("end"))
    return A.adopted(captures, coverage, "s0", ["s1", "s2"], _LOW.replace("2000", "1900"), _HIGH)


_SIGNED_SQL = """WITH c AS (SELECT 'http://a.example/' || (o_orderkey % 400) AS url, strftime(o_orderdate, '%Y%m01000000') AS timestamp, o_orderkey % 3 AS s, min(o_orderkey) AS capture_id, arg_min(o_custkey, o_orderkey) % 5 AS target FROM orders GROUP BY 1, 2, 3),
    v AS (SELECT DISTINCT target, s, left(timestamp, 4)::INTEGER AS y FROM c WHERE NOT (s = 0 AND left(timestamp, 4)::INTEGER % 2 = 0) AND NOT (s = 1 AND left(timestamp, 4)::INTEGER % 3 = 0)),
    m AS (SELECT target, y, min(s) AS s FROM v WHERE s > 0 AND NOT EXISTS (SELECT 1 FROM v o WHERE o.target = v.target AND o.y = v.y AND o.s = 0) GROUP BY target, y)"""


@query(
    "adopted_captures",
    f"""{_SIGNED_SQL}, i AS (SELECT url, timestamp, min(c.s) AS s FROM c JOIN m ON m.target = c.target AND m.s = c.s AND m.y = left(timestamp, 4)::INTEGER GROUP BY url, timestamp)
    SELECT capture_id, 's' || CASE WHEN EXISTS (SELECT 1 FROM i WHERE i.url = c.url AND i.timestamp = c.timestamp AND i.s = c.s) AND NOT EXISTS (SELECT 1 FROM c o WHERE o.url = c.url AND o.timestamp = c.timestamp AND o.s = 0) THEN 0 ELSE s END AS signature FROM c""",
)
def adopted_captures(spark, sf):
    return _signatures(spark, sf)[0].select("capture_id", "signature")


@query("adopted_coverage", f"{_SIGNED_SQL} SELECT target, 's' || s AS signature, y || '0101000000' AS start FROM v UNION ALL SELECT target, 's0', y || '0101000000' FROM m")
def adopted_coverage(spark, sf):
    return _signatures(spark, sf)[1].select("target", "signature", "start")


#: status, bytes, first bytes, suffix, Content-Range, Content-Length, Content-Type, and what the check has to say.
_RESPONSES = (
    (200, 900, b"\xff\xd8\xff\xe0abcdefgh", ".jpg", "", "900", "image/jpeg", None), (404, 900, b"GIF89a", ".gif", "", "900", "", "not_successful"), (200, 0, b"", ".gif", "", "", "", "empty"),
    (206, 50, b"\x00\x00\x00\x18ftypmp42", ".mp4", "bytes 0-49/50", "50", "", None), (206, 50, b"\x00\x00\x00\x18ftypmp42", ".mp4", "bytes 0-49/90", "50", "", "part_of_range"),
    (206, 50, b"OggS", ".ogg", "", "", "", "part_of_range"), (200, 50, b"OggS", ".ogg", "bytes 0-49/50", "", "", "range_contradicts"), (200, 50, b"OggS", ".ogg", "", "51", "", "other_length"),
    (200, 99, b"\xef\xbb\xbf <HTML><body>", ".jpg", "", "", "", "page_instead"), (200, 99, b"<?xml version='1.0'?>\n<asx version='3'>", ".asx", "", "", "text/html", None), (200, 99, b"<?xml version='1.0'?><error>", ".asx", "", "", "", "page_instead"),
    (200, 99, b"#EXTM3U\nhttp://a", ".m3u", "", "", "text/html", None), (200, 99, b"<p>gone", ".wmv", "", "", "text/html; charset=x", "page_instead"), (200, 99, b"anything else", ".xyz", "", "", "", None),
    (200, 99, b"RIFF\x00\x00\x00\x00WEBP", ".webp", "", "", "", None), (200, 99, b"<tt:MPD xmlns:tt='x'>", ".mpd", "", "", "text/html", None),
)


@query("media_checked", "SELECT problem, count(*)::BIGINT AS n FROM (SELECT [" + ", ".join(f"'{r[-1]}'" if r[-1] else "NULL" for r in _RESPONSES) + f"][event_id % {len(_RESPONSES)} + 1] AS problem FROM events) GROUP BY problem")
def media_checked(spark, sf):
    at = (F.col("event_id") % len(_RESPONSES) + 1).cast("int")
    pick = lambda i: F.element_at(F.array(*[F.unhex(F.lit(r[i].hex())) if isinstance(r[i], bytes) else F.lit(r[i]) for r in _RESPONSES]), at)
    e = table(spark, sf, "events").select(*[pick(i).alias(c) for i, c in enumerate(("status", "size", "prefix", "suffix", "ranged", "length", "mime"))])
    headers = {"content_range": F.col("ranged"), "content_length": F.col("length"), "content_encoding": F.lit(None).cast("string"), "content_type": F.col("mime")}
    return e.select(A.media_problem(F.col("status"), F.col("size"), F.col("prefix"), F.col("suffix"), headers).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


@query("embedded_kinds", "SELECT page_id, ['image', NULL, 'video', 'image', NULL, 'video'][page_id % 6 + 1] AS kind FROM pages")
def embedded_kinds(spark, sf):
    at = (F.col("page_id") % 6 + 1).cast("int")
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), at)
    url = F.concat(F.lit("http://m.example/a"), pick(".jpg", ".mp3", ".mp4", "", "", ""))
    return table(spark, sf, "pages").select("page_id", A.embedded_kind(url, pick("", "", "", "application/octet-stream", "text/html", ""), pick("", "", "", "image", "image", "video"), [], []).alias("kind"))


@query(
    "asset_states",
    """SELECT page_id AS asset_id, CASE WHEN page_id % 5 = 1 THEN 'blocked_domain' WHEN page_id % 5 = 2 THEN 'retry' WHEN page_id % 2 = 0 THEN 'found' ELSE 'not_found' END AS state,
    CASE WHEN page_id % 5 NOT IN (1, 2) AND page_id % 2 = 0 THEN '20050101000000' END AS timestamp FROM pages""",
)
def asset_states(spark, sf):
    k = F.col("page_id")
    host = F.when(k % 5 == 1, "other.example").otherwise("cdn.media.example")
    assets = table(spark, sf, "pages").select(k.alias("asset_id"), F.concat(F.lit("http://"), host, F.lit("/f"), k.cast("string")).alias("url"))
    year = F.explode(F.array(*map(F.lit, ("19990101000000", "20050101000000", "20060101000000"))))
    captures = assets.where("asset_id % 2 = 0").select("url", year.alias("timestamp"), F.lit(200).alias("status")).unionByName(assets.select("url", F.lit("20010101000000").alias("timestamp"), F.lit(404).alias("status")))
    return A.asset_states(assets, captures, assets.where("asset_id % 5 = 2"), ["media.example"], _LOW, _HIGH)


def _media(spark, sf):
    """Events as media captures and their errors."""
    k = F.col("event_id")
    pick = lambda n, *xs: F.element_at(F.array(*map(F.lit, xs)), (k % n + 1).cast("int"))
    c = table(spark, sf, "events").select(k.alias("capture_id"), "ts", pick(4, "error", "downloaded", "pending", "skipped").alias("state"), F.when(k % 3 == 0, "old").otherwise("now").alias("signature"), (k % 9).alias("attempts"))
    i = F.col("capture_id")
    errors = c.where("state = 'error'").select("capture_id", F.lit("media").alias("operation"), (i % 5 != 0).alias("retryable"), (i % 7 == 0).alias("resolved"), F.lit(False).alias("ignored"))
    return c, errors


@query(
    "media_sweep",
    """SELECT event_id AS capture_id, CASE WHEN event_id % 8 = 4 THEN 'adopt' WHEN ts <= TIMESTAMP '2024-01-16' THEN 'due' ELSE 'waiting' END AS step, CASE WHEN event_id % 8 <> 4 THEN ts END AS due
    FROM events WHERE event_id % 4 = 0 AND event_id % 3 <> 0 AND event_id % 5 <> 0 AND event_id % 7 <> 0 AND NOT (event_id % 8 = 4 AND event_id % 11 = 0)""",
)
def media_sweep(spark, sf):
    c, errors = _media(spark, sf)
    schedule = c.where("capture_id % 8 <> 4").select("capture_id", F.col("ts").alias("due"))
    return A.media_sweep(c, errors, schedule, c.where("capture_id % 11 = 0").select("capture_id"), "now", F.lit("2024-01-16").cast("timestamp"))


@query(
    "media_report",
    """SELECT count(*)::BIGINT AS indexed, count(*) FILTER (WHERE event_id % 4 = 1)::BIGINT AS downloaded, count(*) FILTER (WHERE event_id % 4 = 2)::BIGINT AS pending, count(*) FILTER (WHERE event_id % 4 = 0)::BIGINT AS errors,
    count(*) FILTER (WHERE event_id % 4 = 2 AND event_id % 9 >= 5)::BIGINT AS pending_over, count(*) FILTER (WHERE event_id % 4 = 0 AND event_id % 9 >= 5)::BIGINT AS errors_over,
    count(*) FILTER (WHERE event_id % 3 <> 0 AND event_id % 4 IN (0, 2))::BIGINT AS unfinished, count(*) FILTER (WHERE event_id % 4 = 0 AND event_id % 7 <> 0)::BIGINT AS unresolved, 2 AS coverage_gaps, FALSE AS complete FROM events""",
)
def media_report(spark, sf):
    return A.media_report(*_media(spark, sf), "now", 5, 2)


_ENCODED = "url_encode(url)"
for _mark in A.KEPT_MARKS:
    _ENCODED = f"replace({_ENCODED}, '%{ord(_mark):02X}', '{_mark.replace(chr(39), chr(39) * 2)}')"


@query(
    "file_names",
    f"""SELECT page_id, regexp_replace(left(label, 140 - length(tail)), '%[0-9A-F]?$', '') || tail AS name FROM (SELECT page_id, {_ENCODED} AS label, '__20240102030405_' || page_id || '_' || left(sha256(url || chr(0) || '2024-01-02 03:04:05' || chr(0) || page_id), 16) || '.txt' AS tail
    FROM (SELECT page_id, url || '?q=é*[' || repeat('x ', (page_id % 60)::INTEGER) AS url FROM pages))""",
)
def file_names(spark, sf):
    k = F.col("page_id")
    url = F.concat("url", F.lit("?q=é*["), F.repeat(F.lit("x "), (k % 60).cast("int")))
    return table(spark, sf, "pages").select("page_id", A.file_name(url, F.lit("2024-01-02 03:04:05"), k).alias("name"))


@query(
    "digests_proved",
    f"""SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE doc_id % 4 < 2 END AS proved, array_to_string(list_transform(range(32), lambda j: substr('{A.BASE32}', 1 + list_sum(list_transform(range(5), lambda b:
    (strpos('0123456789abcdef', substr(sha1(text), 1 + (j * 5 + b) // 4, 1)) - 1) // (1 << (3 - (j * 5 + b) % 4)) % 2 * (1 << (4 - b))))::INTEGER, 1)), '') AS digest FROM documents WHERE text IS NOT NULL""",
)
def digests_proved(spark, sf):
    k, content = F.col("doc_id"), F.col("text").cast("binary")
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", content.alias("content"), A.base32_sha1(content).alias("digest"))
    given = F.when(k % 4 == 0, F.col("digest")).when(k % 4 == 1, F.concat(F.lit("sha1:"), F.lower("digest"))).when(k % 4 == 2, F.reverse("digest")).otherwise("short")
    return d.select("doc_id", A.digest_proves(F.col("content"), given).alias("proved"), "digest")


@query(
    "cycling_cursors",
    """WITH p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS page, 'c' || (event_id % 40) AS cursor FROM events)
    SELECT a.user_id, a.page, a.cursor, min(a.page - b.page)::BIGINT AS length FROM p a JOIN p b ON a.user_id = b.user_id AND a.cursor = b.cursor AND b.page < a.page AND a.page - b.page <= 3 GROUP BY ALL""",
)
def cycling_cursors(spark, sf):
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    p = table(spark, sf, "events").select("user_id", at.alias("page"), F.concat(F.lit("c"), (F.col("event_id") % 40).cast("string")).alias("cursor"))
    return A.cycling_cursors(p, "user_id", "page", "cursor", 3)
