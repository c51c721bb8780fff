"""Text, URL, date and hash functions as Spark columns; Arrow functions only where no built-in has the meaning."""

from __future__ import annotations

import html
import ipaddress
import unicodedata
import urllib.parse

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from webstrata.functions.slices import sliced

#: Java's \s with Unicode white space.
_SPACE = r"(?U)\s+"
#: A bare URL in running text.
URL_PATTERN = r"""(?i)\b(?:https?://|ftp://|www\.)[^\s<>"'()\[\]{}]+"""


def clean_space(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, _SPACE, " "))


@sliced(StringType())
def normalize_search(text: list) -> list:
    """Percent escapes and entities undone, NFKC, case folded, underscores and white space as single spaces."""

    def one(value):
        if value is None:
            return None
        value = unicodedata.normalize("NFKC", html.unescape(urllib.parse.unquote(value)))
        return " ".join(value.casefold().replace("_", " ").split())

    return [one(t) for t in text]


@F.pandas_udf(StringType())
def absolute_link(raw: pd.Series, base: pd.Series) -> pd.Series:
    """A link as found in a page, without quotes and closing punctuation, resolved against the page's URL."""

    def one(value, page):
        if value is None:
            return ""
        value = html.unescape(value).strip().strip("\"'").rstrip(".,;:!?)]}")
        if value[:4].lower() == "www.":
            value = "http://" + value
        try:
            return urllib.parse.urljoin(page or "", value)
        except ValueError:
            return ""

    return pd.Series([one(v, p) for v, p in zip(raw, base, strict=True)], dtype=object)


def simple_search_form(text: Column) -> Column:
    """The part of ``normalize_search`` that SQL has as well: lower case, underscores and white space as single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\s_]+", " "))


def target_pattern(url: Column) -> Column:
    """A URL pattern without scheme that ends in a star."""
    bare = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    return F.when(F.endswith(bare, F.lit("*")), bare).when(F.endswith(bare, F.lit("/")), F.concat(bare, F.lit("*"))).when(
        F.contains(bare, F.lit("/")), F.concat(bare, F.lit("*"))
    ).otherwise(F.concat(bare, F.lit("/*")))


def archive_date(value: Column, end: bool = False) -> Column:
    """Dates of several spellings as 14 digits; a missing part is the first moment, or the last with ``end``. Others: null."""
    text = F.trim(value)
    iso = F.regexp_extract(text, r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})$", 0)
    us = F.regexp_extract(text, r"^(\d{1,2})[-/](\d{1,2})[-/](\d{4})$", 0)
    part = lambda p, k: F.lpad(F.regexp_extract(text, p, k), 2, "0")
    digits = (
        F.when(iso != "", F.concat(F.substring(text, 1, 4), part(r"^\d{4}[-/](\d{1,2})[-/](\d{1,2})$", 1), part(r"^\d{4}[-/](\d{1,2})[-/](\d{1,2})$", 2)))
        .when(us != "", F.concat(F.regexp_extract(text, r"(\d{4})$", 1), part(r"^(\d{1,2})[-/](\d{1,2})", 1), part(r"^(\d{1,2})[-/](\d{1,2})", 2)))
        .when(F.rlike(text, F.lit(r"^(\d{4}|\d{6}|\d{8}|\d{14})$")), text)
    )
    n = F.length(digits)
    month = F.when(n == 4, F.concat(digits, F.lit("12" if end else "01"))).otherwise(digits)
    last = F.date_format(F.last_day(F.to_date(F.try_to_timestamp(F.concat(F.substring(month, 1, 6), F.lit("01")), F.lit("yyyyMMdd")))), "dd")
    day = F.when(F.length(month) == 6, F.concat(month, last if end else F.lit("01"))).otherwise(month)
    whole = F.when(F.length(day) == 8, F.concat(day, F.lit("235959" if end else "000000"))).otherwise(day)
    return F.when(F.try_to_timestamp(whole, F.lit("yyyyMMddHHmmss")).isNotNull(), whole)


def host_of(url: Column, default: str = "unknown") -> Column:
    """Lower-case host of a URL, with or without scheme, credentials and port."""
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit("")), F.lit(default))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1)


def extension_of(url: Column) -> Column:
    """Extension of the path's last name, cut at ; and &, in lower case with its dot; empty if there is none."""
    name = F.lower(F.regexp_extract(path_of(url), r"([^/]*)$", 1))
    return F.regexp_extract(F.regexp_extract(name, r"^([^;&]*)", 1), r"[^.](\.[^.]+)$", 1)


def mime_of(value: Column) -> Column:
    """Media type without parameters, in lower case."""
    return F.lower(F.trim(F.substring_index(F.coalesce(value, F.lit("")), ";", 1)))


def replay_url(base: str, timestamp: Column, url: Column, modifier: str = "id_") -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/"), timestamp, F.lit(modifier + "/"), url)


def without_replay(url: Column, host: str = "web.archive.org") -> Column:
    """The archived URL within a replay URL; other URLs as they are."""
    pattern = rf"(?i)^https?://{host.replace('.', '[.]')}/web/\d{{1,14}}[a-z_]*/(https?://.+)$"
    return F.coalesce(F.nullif(F.regexp_extract(F.trim(url), pattern, 1), F.lit("")), F.trim(url))


def bare_urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({URL_PATTERN})".replace("((?i)", "(?i)(")), 1)


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def host_within(host: Column, domain: Column) -> Column:
    """The domain itself or a name below it."""
    return (host == domain) | F.endswith(host, F.concat(F.lit("."), domain))


def retry_delay(attempt: Column, ident: Column, base: float, most: float) -> Column:
    """Doubling delay up to a limit, moved by at most ten percent by the id."""
    doubled = F.least(F.lit(float(most)), F.lit(float(base)) * F.pow(F.lit(2.0), F.least(F.lit(12), attempt - 1)))
    return doubled * (F.lit(0.90) + F.pmod(ident, F.lit(17)) / F.lit(85.0))


def hamming_similarity(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if one has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.coalesce(dot / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))


def literal_count(text: Column, needle: str) -> Column:
    """Occurrences that do not overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def canonical(value: str | None) -> str:
    """A host name in ASCII and lower case, out of a name or a URL; empty for addresses, bare names and what is none."""
    name = (value or "").strip().rstrip(".").translate({ord(dot): "." for dot in "。．｡"})
    if "//" in name:
        try:
            name = urllib.parse.urlsplit(name if "://" in name else f"https:{name}").hostname or ""
        except ValueError:
            return ""
    try:
        ipaddress.ip_address(name)
        return ""
    except ValueError:
        pass
    try:
        name = name.encode("idna").decode("ascii").lower() if len(name) <= 253 else ""
    except UnicodeError:
        return ""
    return name if "." in name and len(name) <= 253 and all(c.isalnum() or c in "-." for c in name) else ""


@F.pandas_udf(StringType())
def canonical_host(value: pd.Series) -> pd.Series:
    return value.map(canonical)


def register_functions(spark: SparkSession) -> None:
    """Functions of the library by name, for SQL."""
    spark.udf.register("canonical_host", canonical_host)
