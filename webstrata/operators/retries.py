"""Failures and retries: kinds of failures told by their messages, times to wait, and which captures to try again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Category, status and whether to retry, by the first word of a message, and by a text within it (first match).
BY_TOKEN = {
    "wayback_excluded": ("wayback_excluded", None, False), "robots_blocked": ("robots_blocked", None, False), "missing_capture": ("missing_capture", 404, False),
    "invalid_wayback_replay": ("invalid_wayback_replay", None, False), "origin_unavailable": ("origin_unavailable", None, True), "soft_404": ("missing_capture", 404, False),
    "incomplete_media_range": ("incomplete_media_representation", None, True), "incomplete_media_length": ("incomplete_media_representation", None, True),
    "invalid_media_range": ("invalid_media_representation", None, False),
}
BEFORE_STATUS = (
    ("excluded from the wayback machine", "wayback_excluded", 403, False), ("blocked site error", "wayback_excluded", 403, False), ("robots.txt", "robots_blocked", 403, False),
    ("429", "rate_limit", 429, True), ("rate limit", "rate_limit", 429, True),
)
AFTER_STATUS = (
    ("timeout", "timeout", None, True), ("timed out", "timeout", None, True), ("ssl", "ssl", None, True), ("certificate", "ssl", None, True),
    (r"exceeds%bytes", "oversized_response", None, False), (r"bytes%exceeds", "oversized_response", None, False),
    ("network failure", "connection", None, True), ("urlopen", "connection", None, True), ("connection", "connection", None, True),
)
#: Client errors that are worth another attempt, and categories of captures that the archive does not have.
TRANSIENT = (408, 425, 429)
UNAVAILABLE = ("missing_capture", "wayback_excluded", "robots_blocked")


def _kind(category, status, retryable) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(as_column(category).alias("category"), as_column(status).cast("int").alias("status"), as_column(retryable).cast("boolean").alias("retryable"))


def failure_kind(message: Column) -> Column:
    """struct(category, status, retryable) of a failure's message; what no rule knows is a local error that stays."""
    text = F.lower(F.coalesce(message, F.lit("")))
    token, code = F.substring_index(text, ":", 1), F.regexp_extract(text, r"http\s+(\d{3})", 1)
    within = lambda rules: [F.when(text.like(f"%{part}%"), _kind(*rest)) for part, *rest in rules]
    status = F.nullif(code, F.lit("")).cast("int")
    by_status = F.when(status == 404, _kind("missing_capture", status, False)).when(status.between(400, 499), _kind("http_client_error", status, status.isin(*TRANSIENT))).when(status.isNotNull(), _kind("http_server_error", status, True))
    exact = [F.when(F.startswith(text, F.lit(t)) if "media" in t else token == t, _kind(*rest)) for t, rest in BY_TOKEN.items()]
    return F.coalesce(*exact, *within(BEFORE_STATUS), by_status, *within(AFTER_STATUS), _kind("local_processing_error", None, False))


def retry_after(value: Column, now: Column) -> Column:
    """Seconds to wait by a header: a number, or an HTTP date from now on (0 if it is past); null for anything else."""
    text = F.trim(value)
    at = F.try_to_timestamp(F.regexp_replace(text, r"^[A-Za-z]{3}, (.*) (?:GMT|UTC)$", "$1 +0000"), F.lit("dd MMM yyyy HH:mm:ss Z"))
    return F.when(F.rlike(text, F.lit(r"^\d+$")), text.cast("double")).when(at.isNotNull(), F.greatest(F.lit(0.0), (F.unix_micros(at) - F.unix_micros(now)) / 1e6))


def may_retry(routing: Column) -> Column:
    """Whether a capture's last routing leaves room for another automatic attempt."""
    ended = routing.isin("failed_nonretryable", "failed_redirect_policy") | F.startswith(routing, F.lit("failed_nonretryable:")) | F.startswith(routing, F.lit("failed_size_limit:"))
    return ~F.coalesce(ended, F.lit(False))


def may_retry_by_hand(routing: Column) -> Column:
    """As ``may_retry``, and captures that were missing or too large, which a user may select again."""
    chosen = routing.isin("failed_nonretryable:missing_capture", "failed_nonretryable:oversized_response") | F.startswith(routing, F.lit("failed_size_limit:"))
    return may_retry(routing) | F.coalesce(chosen, F.lit(False))


def open_errors(errors: DataFrame, operation: str, retryable: bool) -> DataFrame:
    return errors.where((F.col("operation") == operation) & (F.col("retryable") == F.lit(retryable)) & ~F.col("resolved") & ~F.col("ignored"))


def due_captures(captures: DataFrame, routing: DataFrame, errors: DataFrame) -> DataFrame:
    """Captures with an open error worth another attempt, unless their routing has ended: a semi and an anti join."""
    waiting = captures.join(open_errors(errors, "download", True).select("capture_id"), "capture_id", "left_semi")
    return waiting.join(routing.where(~may_retry(F.col("routing"))).select("capture_id"), "capture_id", "left_anti")


def unavailable_captures(captures: DataFrame, routing: DataFrame, errors: DataFrame) -> DataFrame:
    """Failed captures that the archive itself does not have: the routing says so and an open error agrees with it."""
    said = open_errors(errors, "download", False).where(F.col("category").isin(*UNAVAILABLE)).select("capture_id", F.concat(F.lit("failed_nonretryable:"), "category").alias("routing"))
    agreed = routing.select("capture_id", "routing").join(said, ["capture_id", "routing"], "left_semi")
    return captures.where("state = 'error'").join(agreed.select("capture_id"), "capture_id", "left_semi")


def next_attempts(waiting: DataFrame, now: Column, size: int = 128) -> DataFrame:
    """The next batch: due rows by time and id. The limit is the feature."""
    return waiting.where(F.col("due") <= now).orderBy("due", "capture_id").limit(size)
