"""Capture-index pages: reading, strict validation of whole pages, scope checks, request parameters."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.functions.text import host_of, host_within
from webstrata.storage import once

#: Fields of the compact form, in order.
TEXT_FIELDS = ("timestamp", "mimetype", "statuscode", "digest", "length", "original")
PAGE = "array<array<string>>"


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """(page, value): the files of a folder as whole texts; compressed files are opened by their suffix."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("page"), "value")


def parse_json(pages: DataFrame) -> DataFrame:
    """One row per page: header, records, resume key, and ``problem``, null for a good page.

    A page is rejected as a whole for: no array, a doubled header name, a row of other width, no timestamp or no URL. An empty
    array is a good page without records. ``[], [key]`` at the end is the resume key.
    """
    n = F.size("rows")
    marked = (n >= 2) & (F.size(F.element_at("rows", -2)) == 0) & (F.size(F.element_at("rows", -1)) == 1)
    parsed = once(pages, rows=F.from_json("value", PAGE)).select("page", "rows", (F.trim("value") == "").alias("blank"))
    cut = parsed.select(
        "page", "blank", "rows", F.when(n > 0, F.get("rows", F.lit(0))).otherwise(F.array().cast("array<string>")).alias("header"),
        F.when(n > 2, F.when(marked, F.element_at(F.element_at("rows", -1), 1))).alias("resume"),
        F.when(n > 1, F.slice("rows", 2, n - 1 - F.when(marked, 2).otherwise(0))).otherwise(F.array().cast(PAGE)).alias("records"),
    )
    at = lambda name: F.array_position("header", name).cast("int")
    value = lambda r, name: F.coalesce(F.element_at(r, F.greatest(at(name), F.lit(1))), F.lit(""))
    problem = (
        F.when(F.col("blank"), "empty_body").when(F.col("rows").isNull(), "not_an_array")
        .when(F.size(F.array_distinct("header")) < F.size("header"), "doubled_header")
        .when(F.exists("records", lambda r: F.size(r) != F.size("header")), "ragged_row")
        .when((F.size("records") > 0) & ((at("timestamp") == 0) | (at("original") == 0)), "missing_column")
        .when(F.exists("records", lambda r: (value(r, "timestamp") == "") | (value(r, "original") == "")), "missing_value")
    )
    return cut.select("page", "header", "resume", problem.alias("problem"), "records")


def rows_of(parsed: DataFrame, fields: tuple[str, ...] = TEXT_FIELDS) -> DataFrame:
    """(page, position, fields ...) of the good pages; a field that a page lacks is empty."""
    good = parsed.where("problem is null").select("page", "header", F.posexplode("records").alias("position", "r"))
    at = lambda name: F.array_position("header", name).cast("int")
    return good.select("page", "position", *[F.when(at(f) > 0, F.coalesce(F.element_at("r", F.greatest(at(f), F.lit(1))), F.lit(""))).otherwise("").alias(f) for f in fields])


def parse_text(pages: DataFrame, fields: tuple[str, ...] = TEXT_FIELDS) -> DataFrame:
    """The line form, as ``parse_json`` gives: fields parted by white space, the URL last; a blank line and a token end a page."""
    lines = F.split(F.regexp_replace("value", r"\s+$", ""), r"\r?\n")
    n = F.size("lines")
    resumed = (n >= 2) & (F.trim(F.element_at("lines", -2)) == "") & ~F.contains(F.trim(F.element_at("lines", -1)), F.lit(" "))
    body = F.filter(F.when(resumed, F.slice("lines", 1, n - 2)).otherwise(F.col("lines")), lambda x: F.trim(x) != "")
    cut = pages.select("page", "value", lines.alias("lines")).select("page", "value", body.alias("body"), F.when(resumed, F.trim(F.element_at("lines", -1))).alias("resume"))
    records = F.transform("body", lambda x: F.split(F.trim(x), r"\s+", len(fields)))
    made = cut.select("page", "value", "resume", F.filter(records, lambda r: F.element_at(r, 1) != fields[0]).alias("records"))
    problem = (
        F.when(F.rlike("value", F.lit(r"(?i)^\s*<(!doctype|html)")), "error_page").when(F.exists("records", lambda r: F.size(r) != len(fields)), "ragged_row")
        .when(F.exists("records", lambda r: ~F.rlike(F.element_at(r, fields.index("timestamp") + 1), F.lit(r"^\d{4,14}$"))), "bad_timestamp")
    )
    return made.select("page", F.array(*map(F.lit, fields)).alias("header"), "resume", problem.alias("problem"), "records")


def length_of(value: Column) -> Column:
    """A length as recorded: whole numbers from 0 to the largest long, else 0."""
    return F.greatest(F.coalesce(value.try_cast("long"), F.lit(0)), F.lit(0)).cast("long")


def in_scope(rows: DataFrame, host: str, low: str, high: str, path_prefix: str = "") -> DataFrame:
    """Rows with ``scope``: ok, out_of_range, bad_status, foreign_host or foreign_path; timestamps compare as text."""
    h = host_of(F.col("original"), "")
    where = F.when((F.col("timestamp") < low) | (F.col("timestamp") > high), "out_of_range").when(~F.col("statuscode").isin("200", "-", ""), "bad_status").when(~host_within(h, F.lit(host)), "foreign_host")
    if path_prefix:
        where = where.when(~F.contains("original", F.lit(path_prefix)), "foreign_path")
    return rows.withColumn("scope", where.otherwise("ok"))


def page_verdicts(scoped: DataFrame) -> DataFrame:
    """(page, rows, kept, rejected): a page whose rows are all foreign is an error."""
    return scoped.groupBy("page").agg(F.count("*").alias("rows"), F.count_if(F.col("scope") == "ok").alias("kept"), F.bool_and(F.col("scope") == "foreign_host").alias("rejected"))


def page_count(value: Column) -> Column:
    """A number of pages: bare, in an array, or under pages, numpages or num_pages."""
    bare = F.regexp_extract(value, r"^\s*\[*\s*\"?(\d+)\"?\s*\]*\s*$", 1)
    keyed = F.regexp_extract(value, r"\"(?:pages|numpages|num_pages)\"\s*:\s*\"?(\d+)", 1)
    return F.coalesce(F.nullif(bare, F.lit("")), F.nullif(keyed, F.lit(""))).try_cast("long")


def parameters(pattern: str, low: str = "", high: str = "", limit: int = 1000, resume: str = "", extra: tuple[tuple[str, str], ...] = ()) -> list[tuple[str, str]]:
    """Request parameters for one window of a pattern."""
    out = [("url", pattern), ("output", "json"), ("fl", "urlkey," + ",".join(TEXT_FIELDS)), ("limit", str(limit)), ("showResumeKey", "true")]
    out += [("from", low)] * bool(low) + [("to", high)] * bool(high) + [("resumeKey", resume)] * bool(resume)
    return out + [(k, v) for k, v in extra if k not in dict(out)]


def signature(**settings) -> str:
    """Twenty hex digits that name a set of request settings."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:20]
