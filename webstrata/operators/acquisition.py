"""What a collection still has to fetch: searches by domain, inventories under an older signature, media and their evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webstrata.functions.text import extension_of, host_of, host_within, mime_of
from webstrata.operators.media import allowed, media_kind
from webstrata.operators.retries import open_errors

#: What media files begin with, as hexadecimal digits, and what stands at their fifth byte.
BEGINNINGS = "FFD8FF 89504E470D0A1A0A 474946383761 474946383961 464C56 494433 1A45DFA3 4F676753 664C6143 255044462D 000001BA".split()
AT_FIFTH = "66747970 6D6F6F76 6D646174 77696465 66726565".split()
RIFF_TYPES = "41564920 57415645 57454250".split()
#: Root elements of descriptors, and the first words of those without markup, by suffix.
ROOTS = {".asx": ["asx"], ".wax": ["asx"], ".wvx": ["asx"], ".wmx": ["asx"], ".wpl": ["smil", "playlist"], ".smil": ["smil"], ".smi": ["smil"], ".mpd": ["mpd"]}
FIRST_WORDS = {".m3u": "#extm3u", ".m3u8": "#extm3u", ".pls": "[playlist]", ".vtt": "webvtt"}
#: States of media that need no more work.
FINISHED = ("downloaded", "skipped", "skipped_strategy")
#: Marks that a file name keeps as they are, names that some systems reserve, and the length of a file name.
KEPT_MARKS = "!$&'()+,-.;=@_~[]#"
RESERVED = r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])([.]|$)"
NAME_LENGTH = 140
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def searched_domains(pages: DataFrame, rows: DataFrame, low: str, high: str, size: int) -> tuple[DataFrame, DataFrame]:
    """The state of each domain after its first page of captures, and the earliest capture of each URL.

    pages: (domain, http_status, resume); rows: (domain, url, timestamp, status), hosts in ASCII. A page that failed or
    holds a row out of scope defers its domain and yields nothing; one with a resume key or ``size`` rows is limited.
    A null in url, timestamp or status is out of scope. The earliest capture goes by timestamp, status and domain.
    """
    host = F.regexp_replace(host_of(F.col("url"), ""), r"[.]+$", "")
    fits = F.rlike("url", F.lit(r"^(?i:https?)://")) & host_within(host, F.col("domain")) & ~F.rlike("url", F.lit(r"[\x00-\x1F\x7F]"))
    fits = fits & F.rlike("timestamp", F.lit(r"^[0-9]{14}$")) & F.col("timestamp").between(low, high) & F.col("status").isNotNull()
    seen = rows.groupBy("domain").agg(F.count("*").alias("n"), F.count_if(~F.coalesce(fits, F.lit(False))).alias("bad"))
    reason = (
        F.when(F.coalesce(F.col("http_status"), F.lit(0)) != 200, F.concat(F.lit("HTTP "), F.coalesce(F.col("http_status").cast("string"), F.lit("none"))))
        .when(F.col("bad") > 0, "row out of scope").when((F.coalesce("resume", F.lit("")) != "") | (F.col("n") >= size), "page limit").otherwise("")
    )
    told = pages.join(seen, "domain", "left").withColumn("reason", reason)
    state = F.when(F.col("reason") == "", "searched").when(F.col("reason") == "page limit", "limited").otherwise("deferred")
    states = told.select("domain", state.alias("state"), "reason", F.coalesce("resume", F.lit("")).alias("resume"))
    kept = rows.join(states.where("state <> 'deferred'").select("domain"), "domain", "left_semi")
    first = kept.groupBy("url").agg(F.min(F.struct("timestamp", "status", "domain")).alias("f"))
    return states, first.select("url", F.col("f.timestamp").alias("timestamp"), F.col("f.status").alias("status"), F.col("f.domain").alias("domain"))


def adopted(captures: DataFrame, coverage: DataFrame, current: str, earlier: list[str], low: str, high: str) -> tuple[DataFrame, DataFrame]:
    """Captures and coverage with what compatible earlier signatures hold of [low, high], under the current one.

    captures: (target, url, timestamp, signature, ...); coverage: (target, signature, start, end, ...). A range that the
    current signature has stays as it is; of equal ranges the one first in ``earlier`` counts. Captures whose URL and time
    are taken keep their own signature, so nothing is lost.
    """
    place = F.array_position(F.array(*map(F.lit, earlier)), F.col("signature"))
    at = ["target", "start", "end"]
    old = coverage.where(F.col("signature").isin(earlier) & (F.col("start") >= low) & (F.col("end") <= high)).withColumn("__place", place)
    fresh = old.join(coverage.where(F.col("signature") == current).select(at), at, "left_anti")
    best = fresh.groupBy(at).agg(F.min("__place").alias("__place"))
    ranges = fresh.join(best, [*at, "__place"], "left_semi").drop("__place")
    moved = ranges.withColumn("signature", F.lit(current)).select(coverage.columns)
    r, c = ranges.select("target", "signature", "start", "end").alias("r"), captures.where(F.col("signature").isin(earlier)).withColumn("__place", place).alias("c")
    inside = c.join(r, (F.col("c.target") == F.col("r.target")) & (F.col("c.signature") == F.col("r.signature")) & F.col("c.timestamp").between(F.col("r.start"), F.col("r.end")), "left_semi")
    key = ["url", "timestamp"]
    free = inside.groupBy(key).agg(F.min("__place").alias("__place")).join(captures.where(F.col("signature") == current).select(key), key, "left_anti")
    chosen = free.select(*key, F.element_at(F.array(*map(F.lit, earlier)), F.col("__place").cast("int")).alias("signature"), F.lit(True).alias("__moves"))
    renamed = captures.join(chosen, [*key, "signature"], "left").withColumn("signature", F.when(F.col("__moves"), current).otherwise(F.col("signature")))
    return renamed.select(captures.columns), coverage.unionByName(moved)


def embedded_kind(url: Column, mimetype: Column, hint: Column, include: list[str], exclude: list[str]) -> Column:
    """Kind of an embedded file that is wanted, else null: by suffix, or by the hint of its tag if suffix and type tell nothing."""
    vague = (extension_of(url) == "") & mime_of(mimetype).isin("", "application/octet-stream", "binary/octet-stream")
    by_suffix = F.when(allowed(url, include, exclude), media_kind(url, F.split_part(mime_of(mimetype), F.lit("/"), F.lit(1))))
    return F.coalesce(by_suffix, F.when(vague & hint.isin("image", "video"), hint))


def media_problem(status: Column, size: Column, prefix: Column, suffix: Column, headers: dict[str, Column]) -> Column:
    """Why a response is no whole media file, or null.

    prefix: its first bytes; headers: content_range, content_length, content_encoding and content_type. Containers that are
    not known pass; pages instead of media do not, unless they are descriptors by their suffix and first words.
    """
    h = {k: F.lower(F.trim(F.coalesce(v, F.lit("")))) for k, v in headers.items()}
    part = lambda n: F.regexp_extract(h["content_range"], r"^bytes\s+(\d{1,18})-(\d{1,18})/(\d{1,18})$", n).try_cast("long")
    whole = (part(1) == 0) & (part(2) + 1 == part(3)) & (part(3) == size)
    plain = h["content_encoding"].isin("", "identity")
    short = plain & F.rlike(h["content_length"], F.lit(r"^\d{1,18}$")) & (h["content_length"].try_cast("long") != size)
    digits = F.hex(F.substring(prefix, 1, 12))
    fifth, enough = F.substring(digits, 9, 8), F.length(digits) == 24
    known = F.rlike(digits, F.lit("^(" + "|".join(BEGINNINGS) + "|FF[EF])")) | fifth.isin(AT_FIFTH[1:]) | (enough & (fifth == AT_FIFTH[0]))
    known = known | (F.startswith(digits, F.lit("52494646")) & F.substring(digits, 17, 8).isin(RIFF_TYPES))
    text = F.lower(F.regexp_replace(F.decode(F.substring(prefix, 1, 8192), "ISO-8859-1"), "^[ï»¿\t\r\n ]+", ""))
    root = F.regexp_extract(F.regexp_replace(F.substring(text, 1, 2048), r"^<\?xml[^>]*>\s*", ""), r"^<(?:[a-z][a-z0-9_-]*:)*([a-z][a-z0-9_-]*)[\s>]", 1)
    roots = F.coalesce(*[F.when(suffix == s, root.isin(names)) for s, names in ROOTS.items()], F.lit(False))
    words = F.coalesce(*[F.when(suffix == s, F.startswith(text, F.lit(w))) for s, w in FIRST_WORDS.items()], F.lit(False))
    service = F.contains(F.substring(text, 1, 1024), F.lit("<title>wayback machine"))
    described = (roots | words) & ~service & ~F.contains(F.substring(text, 1, 1024), F.lit("<html"))
    page = F.rlike(text, F.lit(r"^(<!doctype html|<html|<\?xml)")) | F.contains(F.substring(text, 1, 512), F.lit("<html")) | service
    page = page | (F.contains(h["content_type"], F.lit("text/html")) & F.startswith(text, F.lit("<")))
    return (
        F.when(~F.coalesce(status.isin(200, 206), F.lit(False)), "not_successful").when(F.coalesce(size, F.lit(0)) <= 0, "empty")
        .when((status == 206) & ~F.coalesce(whole, F.lit(False)), "part_of_range").when((status == 200) & (h["content_range"] != ""), "range_contradicts")
        .when(short, "other_length").when(~F.coalesce(known, F.lit(False)) & ~described & page, "page_instead")
    )


def asset_states(assets: DataFrame, captures: DataFrame, failed: DataFrame, domains: list[str], low: str, high: str) -> DataFrame:
    """(asset_id, state, timestamp) of outside files: blocked_domain, retry, found (with its earliest capture) or not_found.

    assets: (asset_id, url); captures: (url, timestamp, status); failed: (url) whose lookup did not end.
    """
    host = host_of(F.col("url"), "")
    inside = F.lit(False)
    for d in domains:
        inside = inside | host_within(host, F.lit(d))
    first = captures.where((F.col("status") == 200) & F.col("timestamp").between(low, high)).groupBy("url").agg(F.min("timestamp").alias("timestamp"))
    rows = assets.withColumn("__inside", inside).join(failed.select("url").distinct().withColumn("__failed", F.lit(True)), "url", "left").join(first, "url", "left")
    state = F.when(~F.col("__inside"), "blocked_domain").when(F.col("__failed"), "retry").when(F.col("timestamp").isNotNull(), "found").otherwise("not_found")
    return rows.select("asset_id", state.alias("state"), "timestamp").withColumn("timestamp", F.when(F.col("state") == "found", F.col("timestamp")))


def media_sweep(captures: DataFrame, errors: DataFrame, schedule: DataFrame, decided: DataFrame, signature: str, now: Column) -> DataFrame:
    """(capture_id, step, due): media in error that deserve another attempt, all of them, in the order of a sweep.

    step: adopt for errors without schedule or decision, due and waiting for those with a time. Batches are slices of the order.
    """
    failed = captures.where((F.col("signature") == signature) & (F.col("state") == "error")).select("capture_id")
    failed = failed.join(open_errors(errors, "media", True).select("capture_id"), "capture_id", "left_semi")
    timed = failed.join(schedule.select("capture_id", "due"), "capture_id").withColumn("step", F.when(F.col("due") <= now, "due").otherwise("waiting"))
    new = failed.join(schedule, "capture_id", "left_anti").join(decided, "capture_id", "left_anti").select("capture_id", F.lit(None).cast("timestamp").alias("due"), F.lit("adopt").alias("step"))
    return timed.unionByName(new).select("capture_id", "step", "due").orderBy(F.col("due").asc_nulls_first(), "capture_id")


def media_report(captures: DataFrame, errors: DataFrame, signature: str, attempts: int, n_gaps: int) -> DataFrame:
    """One row of counts over all media, and whether those of the current signature are complete: no gap, nothing unfinished."""
    mine, state = F.col("signature") == signature, F.coalesce("state", F.lit("unknown"))
    kinds = {"downloaded": "downloaded", "pending": "pending", "errors": "error"}
    used = F.col("attempts") >= attempts
    counts = captures.agg(
        F.count("*").alias("indexed"), *[F.count_if(state == v).alias(k) for k, v in kinds.items()],
        F.count_if((state == "pending") & used).alias("pending_over"), F.count_if((state == "error") & used).alias("errors_over"),
        F.count_if(mine & ~state.isin(*FINISHED)).alias("unfinished"),
    )
    open_now = errors.agg(F.count_if(~F.col("resolved") & ~F.col("ignored")).alias("unresolved"))
    one = counts.join(F.broadcast(open_now))  # a row each
    return one.withColumns({"coverage_gaps": F.lit(n_gaps), "complete": (F.col("unfinished") == 0) & F.lit(n_gaps == 0)})


def file_name(url: Column, timestamp: Column, ident: Column, suffix: str = ".txt") -> Column:
    """A portable file name of a capture: the escaped URL, then time, id and the start of a digest that tells equal beginnings apart."""
    digest = F.substring(F.sha2(F.concat_ws("\0", url, timestamp, ident.cast("string")).cast("binary"), 256), 1, 16)
    tail = F.concat(F.lit("__"), F.concat_ws("_", F.nullif(F.substring(F.regexp_replace(timestamp, "[^0-9]", ""), 1, 14), F.lit("")), ident.cast("string"), digest), F.lit(suffix))
    label = F.replace(F.replace(F.url_encode(url), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    for mark in KEPT_MARKS:
        label = F.replace(label, F.lit(f"%{ord(mark):02X}"), F.lit(mark))
    label = F.when(F.rlike(label, F.lit(RESERVED)), F.concat(F.lit("url_"), label)).otherwise(label)
    return F.concat(F.regexp_replace(F.substring(label, F.lit(1), F.lit(NAME_LENGTH) - F.length(tail)), "%[0-9A-F]?$", ""), tail)


def base32_sha1(content: Column) -> Column:
    """SHA-1 of bytes in base 32, as capture indexes give it."""
    digits = F.sha1(content)
    four = lambda i: F.conv(F.substring(digits, i * 5 + 1, F.lit(5)), 16, 10).cast("long")  # noqa: E731 - five hexadecimal digits are four of base 32
    letter = lambda v, k: F.substring(F.lit(BASE32), F.shiftright(v, k).bitwiseAND(31).cast("int") + 1, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.concat(*[letter(four(i), k) for k in (15, 10, 5, 0)])), "")


def digest_proves(content: Column, digest: Column) -> Column:
    """Whether a digest of a capture index, with or without its mark, is that of the bytes; null for digests of another form."""
    plain = F.rtrim(F.regexp_replace(F.upper(digest), "^SHA1:", ""), F.lit("="))
    return F.when(F.rlike(plain, F.lit("^[A-Z2-7]{32}$")), base32_sha1(content) == plain)


def cycling_cursors(committed: DataFrame, key: str, order: str, cursor: str, last: int = 64) -> DataFrame:
    """Rows whose cursor was already committed within the ``last`` pages before: the continuation runs in a circle.

    ``order`` numbers the pages of a key one by one. Only equal cursors of a key meet, not all of its pages.
    """
    w = Window.partitionBy(key, cursor).orderBy(order)
    rows = committed.where(F.col(cursor).isNotNull() & (F.col(cursor) != "")).withColumn("__before", F.lag(order).over(w))
    return rows.where(F.col(order) - F.col("__before") <= last).select(key, order, cursor, (F.col(order) - F.col("__before")).alias("length"))
