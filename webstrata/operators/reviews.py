"""Review overlay and run lifecycle as logs of changes: the present state is the latest of each key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webstrata.operators.shaping import latest
from webstrata.operators.tables import REVIEW_STATES


def reviews_now(log: DataFrame) -> DataFrame:
    """(match_id, status, reviewer, reviewed_at) from (match_id, sequence, status, reviewer, at); unknown states are an error."""
    checked = log.withColumn("status", F.when(F.col("status").isin(*REVIEW_STATES), F.col("status")).otherwise(F.raise_error(F.concat(F.lit("no review state "), F.col("status")))))
    now = latest(checked, ["match_id"], "sequence", ["status", "reviewer", "at"])
    return now.select("match_id", "status", "reviewer", F.when(F.col("status") != "unreviewed", F.col("at")).alias("reviewed_at"))


def notes_now(log: DataFrame) -> DataFrame:
    """(match_id, text): the text last saved for each match; blank ones count only where a note was before."""
    w = Window.partitionBy("match_id").orderBy("sequence")
    filled = F.max(F.when(F.trim("text") != "", F.lit(True))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return latest(log.withColumn("__f", filled).where("__f"), ["match_id"], "sequence", ["text"])


def tags_now(log: DataFrame) -> DataFrame:
    """(match_id, tags): the whole set last saved; trimmed, each once, in order; matches without tags are left out."""
    now = latest(log, ["match_id"], "sequence", ["tags"])
    return now.select("match_id", F.array_distinct(F.filter(F.transform("tags", lambda t: F.trim(t)), lambda t: t != "")).alias("tags")).where(F.size("tags") > 0)


def result_page(matches: DataFrame, reviews: DataFrame, documents: DataFrame, *, least: int = 1, status: str = "", search: str = "", fields: tuple[str, ...] = ("title", "url", "note")) -> DataFrame:
    """Matches of a score, a review state (open ones count as unreviewed) and a text in one of the fields, percent and underscore as wild cards."""
    rows = matches.where((F.col("score") >= least) & ~F.col("excluded") & ~F.col("required_missing"))
    rows = rows.join(reviews.select("match_id", "status"), "match_id", "left").withColumn("status", F.coalesce("status", F.lit("unreviewed"))).join(documents, "document_id")
    rows = rows.where(F.col("status") == status) if status else rows
    have = [f for f in fields if f in rows.columns]
    return rows.where(reduce(lambda a, b: a | b, [F.lower(F.coalesce(f, F.lit(""))).like(f"%{search.casefold()}%") for f in have])) if search and have else rows


def result_rows(matches: DataFrame, documents: DataFrame, captures: DataFrame, reviews: DataFrame, notes: DataFrame, tags: DataFrame, *, run: object, least: int = 0, status: str = "", search: str = "", limit: int = 500, offset: int = 0) -> DataFrame:
    """One page of a run's results with review, first note and tags, by score, then time, address and number of the match.

    matches (match_id, run_id, document_id, score), documents (document_id, capture_id, title, body), captures (capture_id, url, timestamp),
    reviews (match_id, status), notes (note_id, match_id, text), tags (match_id, tag). ``search`` is looked for, whatever the case,
    in address, title and body, with percent and underscore as wild cards. The limit is the feature.
    """
    rows = matches.where(F.col("run_id").eqNullSafe(F.lit(run)) & (F.col("score") >= least)).join(reviews.select("match_id", "status"), "match_id", "left")
    rows = rows.withColumn("review_status", F.coalesce("status", F.lit("unreviewed"))).drop("status")
    rows = rows.where(F.col("review_status") == status) if status else rows
    rows = rows.join(documents, "document_id").join(captures, "capture_id")
    if search.strip():
        rows = rows.where(reduce(lambda a, b: a | b, [F.coalesce(F.lower(c).like(f"%{search.casefold()}%"), F.lit(False)) for c in ("url", "title", "body")]))
    page = rows.select("match_id", "score", "review_status", "title", "url", "timestamp").orderBy(F.desc("score"), "timestamp", "url", "match_id").offset(offset).limit(limit)
    first = notes.groupBy("match_id").agg(F.min_by("text", "note_id").alias("note"))
    joined = tags.groupBy("match_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), ", ").alias("tags"))  # a match's own tags
    return page.join(first, "match_id", "left").join(joined, "match_id", "left").na.fill("", ["note", "tags"])


def coverage(documents: DataFrame, matches: DataFrame, errors: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, documents, scanned, open_errors, complete): a run is complete if every document has a match row and no scan error is open."""
    total = documents.select("document_id").distinct().count()
    known = matches.join(documents.select("document_id").distinct(), "document_id", "left_semi").groupBy("run_id").agg(F.count_distinct("document_id").alias("scanned"))
    open_ = errors.where((F.col("operation") == "scan") & ~F.col("resolved") & ~F.col("ignored")).groupBy("run_id").agg(F.count("*").alias("open_errors"))
    rows = runs.select("run_id").distinct().join(known, "run_id", "left").join(open_, "run_id", "left").na.fill(0, ["scanned", "open_errors"])
    return rows.select("run_id", F.lit(total).cast("long").alias("documents"), "scanned", "open_errors", ((F.col("scanned") == total) & (F.col("open_errors") == 0)).alias("complete"))


def resolved(errors: DataFrame, condition: Column, flag: str = "resolved") -> DataFrame:
    """The errors with a flag set where the condition holds."""
    return errors.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)) | F.coalesce(condition, F.lit(False)))


def new_keys(known: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Keys to add to a dimension: those seen that it lacks."""
    return seen.select(key).distinct().join(known.select(key), key, "left_anti")


def without_run(run: object, *tables: DataFrame, key: str = "run_id") -> list[DataFrame]:
    """The tables without a run's rows."""
    return [t.where(~F.col(key).eqNullSafe(F.lit(run))) for t in tables]


def unscanned(documents: DataFrame, matches: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, document_id) that a run lacks: for each run, the documents without a match row, by full comparison of keys per run."""
    counted = matches.select("run_id", "document_id").distinct()
    wanted = documents.select("document_id").withColumn("run_id", F.explode(F.array(*[F.lit(r.run_id) for r in runs.select("run_id").distinct().collect()])))  # a few runs
    return wanted.join(counted, ["run_id", "document_id"], "left_anti").select("run_id", "document_id")


def retry_split(errors: DataFrame, local: tuple[str, ...] = ("scan", "parse")) -> DataFrame:
    """(capture_id, local_only, due): whether all of a capture's open errors need no network, and the earliest time to retry."""
    kept = errors.where("not resolved and retryable")
    return kept.groupBy("capture_id").agg(F.bool_and(F.col("operation").isin(*local)).alias("local_only"), F.min("due").alias("due"))
