"""Scans of saved bodies: files joined to their captures, proved by digest, told from error pages, decoded, parsed and scored."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.functions.text import clean_space, extension_of, mime_of, path_of
from webstrata.operators import extract as X
from webstrata.operators import keyword_scan as K
from webstrata.sources.bodies import decode_body
from webstrata.storage import once

#: What the archive's own error pages say, each with its category.
SHELL_MARKS = {
    "this url has been excluded from the wayback machine": "wayback_excluded",
    "blocked site error": "wayback_excluded",
    "page cannot be displayed due to robots.txt": "robots_blocked",
    "not saved because of robots.txt": "robots_blocked",
    "wayback machine doesn't have that page archived": "missing_capture",
    "wayback machine has not archived that url": "missing_capture",
    "not in archive": "missing_capture",
    "the machine that serves this file is down": "origin_unavailable",
}
#: Titles of the archive's own pages, and path suffixes of markup.
SHELL_TITLES = ("wayback machine", "internet archive wayback machine", "internet archive")
MARKUP_SUFFIXES = ("html", "htm", "shtml", "shtm", "dhtml", "dhtm", "xhtml", "xhtm", "phtml", "phtm", "php", "php3", "php4", "php5", "cgi", "asp", "aspx", "jsp", "cfm")
#: Characters at the start of a text that are looked at for headings, for a service page, for a plain error and for structure.
HEAD, SERVICE, PLAIN, STRUCTURE = 20_000, 2_500, 4_096, 8_192


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def with_shell(rows: DataFrame, text: str, final_url: Column | None = None, out: str = "shell") -> DataFrame:
    """A column with the category of an error page that the archive saved in place of a capture; null for other texts.

    A mark counts in a title or heading, at the start of a short text without markup, or near the start of one of the
    archive's own pages; a quotation within an article does not. null texts are no error pages.
    """
    head = F.substring(F.col(text), 1, HEAD)
    found = F.regexp_extract_all(head, F.lit(r"(?is)<(?:title|h[1-3])\b[^>]*>(.*?)</(?:title|h[1-3])\s*>"), 1)
    bare = F.transform(found, lambda h: F.translate(F.regexp_replace(h, r"(?s)<[^>]+>", " "), "\x01", " "))
    headings = F.transform(F.split(X.unescape(F.array_join(bare, "\x01")), "\x01"), lambda h: F.lower(clean_space(h)))
    start = F.ltrim(F.regexp_replace(head, r"\A\s+", ""))
    plain = ~F.startswith(start, F.lit("<")) & (F.length(start) < PLAIN)
    staged = once(rows, __headings=headings, __line=F.when(plain, F.lower(F.trim(F.regexp_extract(start, r"\A([^\r\n]*)", 1)))), __begin=F.lower(F.substring(head, 1, SERVICE)))
    service = F.get("__headings", F.lit(0)).isin(*SHELL_TITLES)

    def says(mark: str) -> Column:
        titled = F.exists("__headings", lambda h: F.contains(h, F.lit(mark)))
        return F.coalesce(titled, F.lit(False)) | F.coalesce(F.startswith("__line", F.lit(mark)), F.lit(False)) | (service & F.contains("__begin", F.lit(mark)))

    category = F.coalesce(*[F.when(says(mark), F.lit(kind)) for mark, kind in SHELL_MARKS.items()])
    if final_url is not None:
        category = F.coalesce(category, F.when(F.contains(final_url, F.lit("web.archive.org")) & ~F.contains(final_url, F.lit("/web/")), "invalid_wayback_replay"))
    return staged.withColumn(out, category).drop("__headings", "__line", "__begin")


def is_markup(text: Column, url: Column, content_type: Column) -> Column:
    """Whether a text is to be rendered: by media type, by the path's suffix, or by unmistakable structure at its start."""
    start = F.lower(F.regexp_replace(F.substring(text, 1, STRUCTURE), r"\A\s+", ""))
    opened = any_of([F.startswith(start, F.lit(x)) for x in ("<!doctype html", "<html", "<head", "<body")])
    closed = F.rlike(start, F.lit(r"(?s)<(?:(?:html|head|body)\b[^>]*>|title\b[^>]*>).*?</(?:html|head|body|title)\s*>"))
    typed = F.contains(mime_of(content_type), F.lit("html"))
    suffixed = F.rlike(F.lower(path_of(url)), F.lit(r"\.(?:" + "|".join(MARKUP_SUFFIXES) + r")\z"))
    return F.coalesce(typed | suffixed | opened | closed, F.lit(False))


def needs_rendering(text: Column, url: Column, content_type: Column) -> Column:
    """Whether phrases that the source lacks may still stand in the rendered text; no only for formats that are surely plain."""
    mime, suffix = mime_of(content_type), extension_of(url)
    plain_type = mime.isin("text/plain", "text/css", "application/json", "text/json", "application/javascript", "text/javascript", "application/x-javascript")
    vague = mime.isin("", "application/octet-stream", "binary/octet-stream", "application/binary")
    plain = plain_type | (suffix.isin(".txt", ".text", ".css", ".js", ".json") & ~vague)
    return is_markup(text, url, content_type) | ~plain


def opened_bodies(captures: DataFrame, bodies: DataFrame, *, reject_shells: bool) -> DataFrame:
    """Captures (capture_id, url, mimetype, path, sha256) with the text of their bodies (path, content) and a ``problem``.

    problem: missing_local_file without a body, local_integrity_failure where a recorded digest is another than the body's, body_too_large,
    invalid_archive_replay for error pages if those are rejected; else null. A null digest proves nothing and passes.
    """
    joined = captures.join(bodies.select("path", "content"), "path", "left")
    differs = F.col("sha256").isNotNull() & (F.sha2("content", 256) != F.col("sha256"))
    problem = F.when(F.col("content").isNull(), "missing_local_file").when(differs, "local_integrity_failure")
    known = once(joined, problem=problem)
    read = once(known, body=decode_body(F.when(F.col("problem").isNull(), F.col("content")), F.col("mimetype"))).drop("content")
    text = read.withColumns({"text": F.col("body.text"), "problem": F.coalesce("problem", "body.problem")}).drop("body")
    if not reject_shells:
        return text.withColumn("shell", F.lit(None).cast("string"))
    shelled = with_shell(text, "text")
    return shelled.withColumn("problem", F.coalesce("problem", F.when(F.col("shell").isNotNull(), "invalid_archive_replay")))


def scan_saved(captures: DataFrame, bodies: DataFrame, rules: Sequence[K.Rule], *, reject_shells: bool = False, bonuses: bool = True) -> DataFrame:
    """One row for each capture: its new state and routing, or its problem and whether to try again; title, body and scores.

    A rescan scores whatever is saved; a scan of bodies newly fetched (``reject_shells``) also turns error pages away. A
    capture with a problem keeps null scores. Only an error page of an unreachable origin is tried again, other problems always.
    """
    opened = opened_bodies(captures, bodies, reject_shells=reject_shells)
    markup = is_markup(F.col("text"), F.col("url"), F.col("mimetype"))
    good = F.col("problem").isNull()
    marked = once(opened, __m=good & markup)
    own = F.when(F.col("__m"), F.col("text"))
    parsed = once(marked, title=F.coalesce(X.unescape(X.title(own)), F.lit("")), body=F.coalesce(X.visible_text(own), F.when(good, F.col("text")), F.lit("")))
    fields = once(parsed, url_s=F.lower("url"), title_s=F.lower("title"), body_s=F.lower("body"))
    scanned = K.scan(fields, rules, {"url": ("url", "url_s"), "title": ("title", "title_s"), "body": ("body", "body_s")}, bonuses=bonuses)
    only = lambda c: F.when(good, F.col(c)).alias(c)
    again = F.when(~good, (F.col("problem") != "invalid_archive_replay") | (F.col("shell") == "origin_unavailable"))
    return scanned.select(
        "capture_id", "url", F.when(good, "downloaded").otherwise("error").alias("state"), F.when(good, "downloaded_scanned").alias("routing"), "problem", "shell", again.alias("retryable"),
        only("title"), only("body"), only("score"), only("excluded"), only("required_missing"), only("hits"),
    )


def reconciled(captures: DataFrame, documents: DataFrame) -> DataFrame:
    """Captures whose state says downloaded although no document is there are waiting for a scan again."""
    known = documents.select("capture_id").distinct().withColumn("__d", F.lit(True))
    joined = captures.join(known, "capture_id", "left")
    return joined.withColumn("state", F.when((F.col("state") == "downloaded") & F.col("__d").isNull(), "downloaded_unscanned").otherwise(F.col("state"))).drop("__d")
