"""Table functions for SQL: entities of texts and media of pages, one row each, joined laterally.

    spark.sql("SELECT p.page_id, m.* FROM pages p, LATERAL media_links(p.html, p.url) m")

``register`` makes them known to a session. Their columns come from ``analyze``: with a constant true as the last argument,
``page_entities`` also gives where each value stands. Null texts give no rows; each row is given once for a text.
"""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser
from urllib.parse import parse_qsl, unquote, urljoin, urlsplit

from pyspark.sql import SparkSession
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from webstrata.operators.classify import AUDIO, IMAGE, VIDEO
from webstrata.operators.extract import ENTITIES

KINDS = ("date", "hash", "email", "username", "filename", "url", "domain")
_PATTERNS = {k: re.compile(p) for k, p in ENTITIES.items()}
_KIND_OF = {s: kind for kind, group in (("image", IMAGE), ("video", VIDEO), ("audio", AUDIO)) for s in group}


def url_parts(url: str) -> list[tuple[str, str]]:
    """The domain and the file name of a URL, as far as it has them."""
    try:
        parts = urlsplit(url if "://" in url else f"http://{url}")
        host = (parts.hostname or "").casefold().strip(".")
    except ValueError:
        return []
    name = parts.path.rpartition("/")[2]
    return [("domain", host)] * bool(host) + [("filename", name)] * ("." in name)


class PageEntities:
    """page_entities(text, url, kinds[, offsets]): distinct (kind, value, normalized[, at]) of a text and its own address."""

    @staticmethod
    def analyze(text: AnalyzeArgument, url: AnalyzeArgument, kinds: AnalyzeArgument, offsets: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not kinds.isConstantExpression or set(filter(None, (kinds.value or "").split(","))) - set(KINDS):
            raise ValueError(f"kinds are a constant list of {', '.join(KINDS)}")
        schema = StructType().add("kind", StringType()).add("value", StringType()).add("normalized", StringType())
        return AnalyzeResult(schema.add("at", IntegerType()) if offsets is not None and offsets.value else schema)

    def eval(self, text, url, kinds, offsets=False):
        wanted = set(filter(None, (kinds or "").split(","))) or set(KINDS)
        found: dict[tuple[str, str], tuple[str, int | None]] = {}

        def add(kind: str, value: str, at: int | None) -> None:
            value = " ".join(value.split())
            if kind in wanted and value:
                found.setdefault((kind, value.casefold()), (value, at))

        for kind, value in url_parts(url) if url else ():
            add(kind, value, None)
        for kind, pattern in _PATTERNS.items():
            for m in pattern.finditer(text or "") if kind in wanted or kind == "url" and wanted & {"domain", "filename"} else ():
                add(kind, m[1], m.start(1))
                for k, v in url_parts(m[1]) if kind == "url" else ():
                    add(k, v, m.start(1))
        for (kind, normalized), (value, at) in found.items():
            yield (kind, value, normalized, at) if offsets else (kind, value, normalized)


#: Attributes that name resources, by tag; properties of meta tags; names of player settings.
RESOURCES = {"img": ("src", "data-src"), "source": ("src",), "video": ("src", "poster"), "audio": ("src",), "embed": ("src",), "iframe": ("src",), "frame": ("src",), "object": ("data",), "input": ("src",), "body": ("background",), "a": ("href",), "link": ("href",)}
META = ("og:image", "og:video", "og:audio", "og:image:url", "og:video:url", "og:image:secure_url", "og:video:secure_url", "twitter:image", "twitter:player:stream", "thumbnail")
SETTINGS = ("file", "url", "movie", "media", "clip", "playlist", "src", "filename", "image", "video")
_CSS = re.compile(r"""url\(\s*['"]?([^'")]+)['"]?\s*\)""", re.I)
_SETTING = re.compile(r"""['"]?\b(?:file|url|movie|media|clip|playlist|image|video)['"]?\s*[:=]\s*['"]([^'"\s]+\.[A-Za-z0-9]{2,4}(?:\?[^'"]*)?)['"]""", re.I)


class _Media(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found: list[tuple[str, str, str]] = []  # (raw, tag, origin)
        self.inside = ""

    def handle_starttag(self, tag, attrs):
        a = {k: v for k, v in attrs if v}
        self.found += [(a[name], tag, name) for name in RESOURCES.get(tag, ()) if name in a]
        for name in ("srcset", "data-srcset"):
            self.found += [(part.split()[0], tag, "srcset") for part in re.split(r",\s+|,(?=https?:)", a.get(name, "")) if part.split()]
        self.found += [(u, tag, "css") for u in _CSS.findall(a.get("style", ""))]
        if tag == "meta" and (a.get("property") or a.get("name") or "").lower() in META and a.get("content"):
            self.found.append((a["content"], tag, "meta"))
        if tag == "param" and a.get("value"):
            name = (a.get("name") or "").lower()
            self.found += [(a["value"], tag, "param")] * (name in SETTINGS) + self._flashvars(a["value"]) * (name == "flashvars")
        self.found += self._flashvars(a["flashvars"]) if a.get("flashvars") else []
        self.inside = tag if tag in ("style", "script") else ""

    @staticmethod
    def _flashvars(value: str) -> list[tuple[str, str, str]]:
        return [(v, "embed", "flashvars") for k, v in parse_qsl(value, keep_blank_values=False) if k.lower() in SETTINGS]

    def handle_endtag(self, tag):
        self.inside = ""

    def handle_data(self, data):
        if self.inside == "style":
            self.found += [(u, "style", "css") for u in _CSS.findall(data)]
        elif self.inside == "script":
            self.found += [(u.replace("\\/", "/"), "script", "setting") for u in _SETTING.findall(data.replace("\\/", "/"))]


def suffix_of(url: str) -> str:
    try:
        name = urlsplit(url).path.rpartition("/")[2].lower()
    except ValueError:
        return ""
    return "." + re.split("[;&]", name)[0].rpartition(".")[2] if "." in name else ""


class MediaLinks:
    """media_links(html, base): distinct (url, kind, origin, tag) of the media of a page; kind by suffix, else by the tag, null for frames."""

    @staticmethod
    def analyze(page: AnalyzeArgument, base: AnalyzeArgument) -> AnalyzeResult:
        return AnalyzeResult(StructType().add("url", StringType()).add("kind", StringType()).add("origin", StringType()).add("tag", StringType()))

    def eval(self, page, base):
        parser = _Media()
        parser.feed(page or "")
        parser.close()
        seen = set()
        for raw, tag, origin in parser.found:
            raw = html.unescape(raw).strip()
            if not raw or re.match(r"(?i)(?:javascript|data|mailto|about):", raw) or raw.startswith("#"):
                continue
            try:
                url = urljoin(base or "", raw)
            except ValueError:
                continue
            kind = _KIND_OF.get(suffix_of(unquote(url))) or {"img": "image", "video": "image" if origin == "poster" else "video", "audio": "audio"}.get(tag)
            if url not in seen and (kind or tag in ("embed", "object", "iframe", "frame")):
                seen.add(url)
                yield url, kind, origin, tag


def register(spark: SparkSession) -> None:
    """Make the table functions known to SQL."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("page_entities", udtf(PageEntities))
    spark.udtf.register("media_links", udtf(MediaLinks))
