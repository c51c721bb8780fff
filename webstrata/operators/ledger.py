"""Errors, site issues, lookups, saved evidence and routing, kept from logs of what happened; redirects; candidates for a question; domain lists by recipe."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webstrata.functions.text import host_of, host_within
from webstrata.operators.classify import classify
from webstrata.operators.shaping import zero_filled
from webstrata.operators.suffixes import domains

#: What makes two errors one, nulls being equal.
IDENTITY = ("operation", "category", "scope", "capture_id", "document_id", "media_id")
#: Rows of a log whose places are counted in one group.
BLOCK = 1 << 16


def marks_before(log: DataFrame, key: str, sequence: str, mark: str, out: str, block: int = BLOCK) -> DataFrame:
    """The log with the number of marked rows of a row's key before it.

    The sequence is cut into blocks: marks are summed by key and block first, and only rows of one block are sorted together,
    so a key with a third of the log is no task of its own.
    """
    own = log.withColumn("__block", F.floor(F.col(sequence) / block))
    sums = own.groupBy(key, "__block").agg(F.sum(mark).alias("__marks"))
    earlier = Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(key, "__block", F.coalesce(F.sum("__marks").over(earlier), F.lit(0)).alias("__earlier"))
    within = Window.partitionBy(key, "__block").orderBy(sequence).rowsBetween(Window.unboundedPreceding, -1)
    return own.withColumn("__within", F.coalesce(F.sum(mark).over(within), F.lit(0))).join(sums, [key, "__block"]).withColumn(out, F.col("__earlier") + F.col("__within")).drop("__block", "__within", "__earlier")


def errors_kept(log: DataFrame, resolutions: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per error out of a log of failures.

    log: (sequence, at, message, http_status, retryable) and the columns of ``IDENTITY``; resolutions: (sequence, capture_id), each
    resolving what is open of its capture. A failure of the same identity counts up the open error and renews its message, status
    and time; after a resolution the next one is a new error. Failures without a capture are never resolved by one.
    error_id is the sequence of the first failure.
    """
    marks = resolutions.where("capture_id is not null").select("sequence", "capture_id", F.lit(1).alias("__mark"))
    of_captures = log.where("capture_id is not null").withColumn("__mark", F.lit(0)).unionByName(marks, allowMissingColumns=True)
    counted = marks_before(of_captures, "capture_id", "sequence", "__mark", "__before", block).where("__mark = 0").drop("__mark")
    rows = counted.unionByName(log.where("capture_id is null").withColumn("__before", F.lit(0).cast("long")))
    last = lambda c: F.max_by(c, "sequence").alias(c)
    errors = rows.groupBy(*IDENTITY, "__before").agg(
        F.min("sequence").alias("error_id"), F.count("*").alias("attempt_count"), F.min_by("at", "sequence").alias("first_seen"), F.max_by("at", "sequence").alias("last_seen"),
        last("message"), last("http_status"), last("retryable"),
    )
    all_marks = marks.groupBy("capture_id").agg(F.count("*").alias("__all"))
    return errors.join(all_marks, "capture_id", "left").withColumn("resolved", F.coalesce("__all", F.lit(0)) > F.col("__before")).drop("__all", "__before")


def site_issues(log: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Issues by (host, stage, category, http_status) with a counter; a new occurrence reopens a resolved issue.

    log: (sequence, at, host, stage, category, http_status, target, message); resolutions: (sequence, host, stage, category,
    http_status). Hosts are trimmed and in lower case, blank ones ``unknown``; no status is 0. The last target that is
    not blank stays; messages end at 2,000 characters.
    """
    named = lambda rows: rows.withColumns({"host": F.coalesce(F.nullif(F.lower(F.trim("host")), F.lit("")), F.lit("unknown")), "http_status": F.coalesce("http_status", F.lit(0))})
    keys = ["host", "stage", "category", "http_status"]
    target = F.nullif(F.trim("target"), F.lit(""))
    issues = named(log).groupBy(*keys).agg(
        F.max_by(target, F.when(target.isNotNull(), F.col("sequence"))).alias("target"), F.substring(F.max_by("message", "sequence"), 1, 2000).alias("message"), F.count("*").alias("occurrence_count"),
        F.min_by("at", "sequence").alias("first_seen"), F.max_by("at", "sequence").alias("last_seen"), F.max("sequence").alias("__last"),
    )
    closed = named(resolutions).groupBy(*keys).agg(F.max("sequence").alias("__closed"))
    return issues.join(closed, keys, "left").withColumn("resolved", F.coalesce(F.col("__closed") > F.col("__last"), F.lit(False))).drop("__closed", "__last")


#: Hosts of the archive, and the form of its addresses with another address inside.
ARCHIVE_HOSTS = ("web.archive.org", "wwwb-app0.us.archive.org")
_EMBEDDED = r"(?i)^https?://[^/?#]*/web/[^/]+/(https?://[^#]+)"


def redirect_outcome(source: Column, destination: Column, scopes: list[tuple[str, bool]], *, external: bool = False, skip: bool = False) -> Column:
    """What becomes of a redirect of a saved capture: allowed, redirect_skipped, live_redirect_blocked or external_redirect_blocked.

    source: the captured page's own address; destination: where the archive leads to. scopes: (host, whether names below it count).
    A destination outside the archive is live; one within it is judged by the host of the address inside, and allowed without one.
    """
    if skip:
        return F.lit("redirect_skipped")
    bare = lambda url: F.rtrim(host_of(url, ""), F.lit("."))
    of_archive = F.rlike(destination, F.lit("(?i)^https?://")) & bare(destination).isin(*ARCHIVE_HOSTS)
    inside = F.when(of_archive, F.nullif(F.regexp_extract(destination, _EMBEDDED, 1), F.lit("")))
    host = bare(inside)
    names = [(name.lower().rstrip("."), below) for name, below in scopes]
    in_scope = reduce(lambda a, b: a | b, [host_within(host, F.lit(name)) if below else host == name for name, below in names], host == bare(source))
    return (
        F.when(~F.coalesce(of_archive, F.lit(False)), "live_redirect_blocked").when(inside.isNull() | in_scope | F.lit(external), "allowed").otherwise("external_redirect_blocked")
    )


LOOKUP_STATES = ("pending", "indexed", "unavailable", "error")


def lookups_marked(queue: DataFrame, lookups: DataFrame) -> DataFrame:
    """The queue after its lookups: last state, count (0 at least) and error (2,000 characters, null if empty), attempts added up.

    queue: (queue_id, signature, state, result_count, last_error, lookup_attempts); lookups: (sequence, queue_id, state, result_count,
    error, counted), where counted tells whether it is an attempt; of equal sequences the greatest values count. Other columns of
    the queue stay.
    """
    newest = F.max(F.struct("sequence", "state", "result_count", "error")).alias("__new")
    done = lookups.groupBy("queue_id").agg(newest, F.count_if(F.coalesce("counted", F.lit(True))).alias("__more"))
    has = F.col("__new").isNotNull()
    return queue.join(done, "queue_id", "left").withColumns({
        "state": F.when(has, F.col("__new.state")).otherwise(F.col("state")),
        "result_count": F.when(has, F.greatest(F.lit(0), F.coalesce("__new.result_count", F.lit(0)))).otherwise(F.col("result_count")),
        "last_error": F.when(has, F.nullif(F.substring("__new.error", 1, 2000), F.lit(""))).otherwise(F.col("last_error")),
        "lookup_attempts": F.col("lookup_attempts") + F.coalesce("__more", F.lit(0)),
    }).drop("__new", "__more")


def lookup_counts(queue: DataFrame, signature: str) -> DataFrame:
    """(state, n) of a signature's queue, all four states present, and others as they come."""
    counts = queue.where(F.col("signature") == signature).groupBy("state").agg(F.count("*").alias("n"))
    return zero_filled(counts, "state", list(LOOKUP_STATES)).unionByName(counts.where(~F.col("state").isin(*LOOKUP_STATES)))


def lookups_due(queue: DataFrame, signature: str, most: int) -> DataFrame:
    """Rows to look up: pending or failed, with fewer attempts than the most."""
    return queue.where((F.col("signature") == signature) & F.col("state").isin("pending", "error") & (F.col("lookup_attempts") < most))


def evidence_saved(captures: DataFrame, results: DataFrame) -> DataFrame:
    """The captures after downloads: (capture_id, state, content_hash, bytes_saved, content_type, final_url, http_status).

    captures: these columns; results: (sequence, capture_id, deferred, content_hash, bytes_saved, content_type, final_url,
    http_status). The last result of a capture counts; it is downloaded, or downloaded_unscanned where its scan is deferred.
    """
    values = ["content_hash", "bytes_saved", "content_type", "final_url", "http_status"]
    state = F.when(F.col("deferred"), "downloaded_unscanned").otherwise("downloaded")
    last = results.groupBy("capture_id").agg(F.max_by(F.struct(state.alias("state"), *values), "sequence").alias("__new"))
    joined = captures.join(last, "capture_id", "left")
    return joined.select("capture_id", *[F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) for c in ("state", *values)])


#: Routes and states whose class may still be corrected.
OPEN_ROUTES = ("pending", "skipped_non_text", "deferred_to_media", "unsupported_non_text")
OPEN_STATES = ("pending", "skipped")


def routing_backfilled(captures: DataFrame, routing: DataFrame, revision: int) -> DataFrame:
    """Routing rows under a revision of the classes: (capture_id, resource_class, evidence, confident, routing, revision, change).

    captures: (capture_id, url, mimetype, state); routing: the columns without change. Captures without a row are classified. A row
    of an older revision takes the class of a suffix that is never text if its capture and route are still open; all else stays.
    """
    rows = captures.join(routing, "capture_id", "left").withColumn("__own", F.explode(F.array(classify(F.col("url"), F.col("mimetype")))))
    none = F.col("routing").isNull()
    open_ = F.col("state").isin(*OPEN_STATES) & F.col("routing").isin(*OPEN_ROUTES) & (F.col("revision") < revision)
    change = F.when(none, "added").when(open_ & F.startswith("__own.reason", F.lit("suffix_policy:")), "corrected").otherwise("kept")
    rows = rows.withColumn("change", change)
    new = F.col("change") != "kept"
    return rows.select(
        "capture_id", F.when(new, F.col("__own.class")).otherwise(F.col("resource_class")).alias("resource_class"), F.when(new, F.col("__own.reason")).otherwise(F.col("evidence")).alias("evidence"),
        F.when(new, F.col("__own.confident")).otherwise(F.col("confident")).alias("confident"), F.coalesce("routing", F.lit("pending")).alias("routing"), F.lit(revision).alias("revision"), "change",
    )


#: Words of a question that ask for nothing.
QUESTION_STOPS = (
    "about after also and are been being from have into look looking most pages page that the their there this what when where which with would your "
    "search searching find finding specific relevant"
).split()


def question_terms(question: Column) -> Column:
    """The words of a question to look for: of three characters or more, each once, without numbers and stop words, 24 at most."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(question), F.lit("[a-z0-9][a-z0-9_-]{2,}"), 0))
    return F.slice(F.filter(words, lambda w: ~w.isin(*QUESTION_STOPS) & ~F.rlike(w, F.lit("^[0-9]+$"))), 1, 24)


def candidates(matches: DataFrame, ranked: DataFrame, *, least: int, limit: int) -> DataFrame:
    """(position, match_id, score): matches to be judged for a question. The limit is the feature.

    matches: (match_id, document_id, score); ranked: (document_id, rank_score) by full text, larger is better. First the best half of
    the limit (ten at least) by full text, then the others by score, ties by match_id. Only the second part needs the least score.
    """
    found = matches.join(ranked, "document_id").orderBy(F.desc("rank_score"), F.desc("score"), "match_id").limit(min(limit, max(10, limit // 2)))
    first = found.select("match_id", "score", F.lit(0).alias("__part"), "rank_score")
    others = matches.where(F.col("score") >= least).join(first.select("match_id"), "match_id", "left_anti").orderBy(F.desc("score"), "match_id").limit(limit)
    both = first.unionByName(others.select("match_id", "score", F.lit(1).alias("__part"), F.lit(0.0).alias("rank_score")))
    place = F.row_number().over(Window.orderBy("__part", F.desc("rank_score"), F.desc("score"), "match_id"))  # two lists of at most ``limit``
    return both.select(place.alias("position"), "match_id", "score").where(F.col("position") <= limit)


def recipe_of(suffixes: DataFrame) -> str:
    """The name of a set of suffix rules: a digest that does not depend on their order."""
    digests = F.transform(F.array_sort(F.collect_set("suffix")), lambda s: F.sha2(s.cast("binary"), 256))  # ``domains`` bounds the rules
    return suffixes.agg(F.sha2(F.array_join(digests, ",").cast("binary"), 256)).first()[0]


def domains_committed(sources: DataFrame, hosts: DataFrame, inputs: DataFrame, suffixes: DataFrame, recipe: str) -> tuple[DataFrame, DataFrame]:
    """Sources and hosts after inputs were read: only those whose text changed, or that the recipe has not seen, are read again.

    sources: (recipe, capture_id, digest), hosts: (recipe, capture_id, host), inputs: (capture_id, digest, text). An input without a
    text is not read and stays a gap.
    """
    known = sources.where(F.col("recipe") == recipe).select("capture_id", "digest")
    todo = inputs.where("text is not null").join(known, ["capture_id", "digest"], "left_anti")
    found = domains(todo, "capture_id", "text", suffixes).select(F.lit(recipe).alias("recipe"), "capture_id", F.col("domain").alias("host"))
    read = todo.select(F.lit(recipe).alias("recipe"), "capture_id", "digest")
    ids = ["recipe", "capture_id"]
    return sources.join(read.select(*ids), ids, "left_anti").unionByName(read), hosts.join(read.select(*ids), ids, "left_anti").unionByName(found)


def domains_published(sources: DataFrame, hosts: DataFrame, inputs: DataFrame, recipe: str) -> tuple[DataFrame, DataFrame]:
    """(line, captures) for each host of inputs that are covered as they are now, and one row (inputs, gaps, status)."""
    covered = inputs.select("capture_id", "digest").join(sources.where(F.col("recipe") == recipe).select("capture_id", "digest").distinct().withColumn("__read", F.lit(True)), ["capture_id", "digest"], "left")
    own = hosts.where(F.col("recipe") == recipe).join(covered.where("__read").select("capture_id"), "capture_id", "left_semi")
    lines = own.groupBy("host").agg(F.count_distinct("capture_id").alias("captures")).select(F.concat(F.lit("*."), "host", F.lit("/*")).alias("line"), "captures")
    gaps = F.count_if(F.col("__read").isNull())
    return lines, covered.agg(F.count("*").alias("inputs"), gaps.alias("gaps"), F.when(gaps > 0, "incomplete").otherwise("complete_for_saved_inputs").alias("status"))


def provenance_of_groups(groups: DataFrame, captures: DataFrame) -> DataFrame:
    """(source, mirror, method, similarity, source_time, mirror_time): from the oldest of each group to the others at other addresses.

    groups: (group, id, method, similarity), exact or near, method being the group's and similarity that of the document to the group's
    representative; captures: (id, url, timestamp). Age is by time, then by id. The first of a group comes by aggregation, so groups
    of any size are no task of their own.
    """
    members = groups.join(captures, "id")
    first = members.groupBy("group").agg(F.min_by(F.struct("id", "url", "timestamp"), F.struct("timestamp", "id")).alias("__s"))
    pairs = members.join(first, "group").where((F.col("id") != F.col("__s.id")) & ~F.col("url").eqNullSafe(F.col("__s.url")))
    return pairs.select(F.col("__s.id").alias("source"), F.col("id").alias("mirror"), "method", "similarity", F.col("__s.timestamp").alias("source_time"), F.col("timestamp").alias("mirror_time"))
