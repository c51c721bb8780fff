"""Saved bodies: folders of files, decoding, text detection, domain lists, integrity of files against records."""

from __future__ import annotations

import codecs
import os
import re
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructType

from webstrata.functions.slices import sliced
from webstrata.storage import written

#: Suffixes of importable files, media type of those that are no plain text.
SUFFIXES = ("txt", "html", "htm", "shtm", "dhtm", "xhtm", "phtm", "php", "dat", "cgi")
PLAIN = ("txt", "dat")
#: Byte order marks with their encodings, the longer ones first.
MARKS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
#: First bytes of what is no text, forms of RIFF files, and header sizes of bitmaps.
NOT_TEXT = (
    b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff", b"GIF87a", b"GIF89a", b"%PDF-", b"PK\x03\x04", b"\x1f\x8b\x08", b"OggS\x00", b"fLaC", b"\x1a\x45\xdf\xa3", b"\x7fELF", b"MZ\x90\x00",
)
RIFF = (b"WEBP", b"WAVE", b"AVI ")
BITMAP_HEADERS = (12, 40, 52, 56, 64, 108, 124)
#: Bytes that an unpacked body may have, and those that tell text from other things.
MOST, SAMPLE = 1 << 30, 8192
#: Largest file that Spark reads as one value.
LARGEST = (1 << 31) - 1 - 512


def read_folder(spark: SparkSession, path: str, most: int = LARGEST) -> DataFrame:
    """(path, url, timestamp, size, content, problem) of the importable files below a folder, each one a row.

    problem: ``too_large`` for a file of more than ``most`` bytes, which is not read; else null.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kept = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*SUFFIXES))
    facts = ["path", F.col("path").alias("url"), F.date_format("modificationTime", "yyyyMMddHHmmss").alias("timestamp"), F.col("length").alias("size")]
    read = kept.where(F.col("length") <= most).select(*facts, "content", F.lit(None).cast("string").alias("problem"))
    return read.unionByName(kept.where(F.col("length") > most).select(*facts, F.lit(None).cast("binary").alias("content"), F.lit("too_large").alias("problem")))


def write_files(rows: DataFrame, path: str, id_col: str, suffix_col: str, content_col: str, blanks: Column | None = None) -> DataFrame:
    """Write each row as a file ``id.suffix`` below a folder, from the tasks; (path) of the files. A task that runs again writes the same.

    blanks: zero bytes behind the content. They are no data of the row, and take no room on a local disk, where the file is only made longer.
    """
    from pyarrow import fs

    place = path if "://" in path or path.startswith("file:") else f"file://{path}"

    def run(batches):
        import pyarrow as pa

        store, root = fs.FileSystem.from_uri(place)
        store.create_dir(root, recursive=True)
        local = isinstance(store, fs.LocalFileSystem)
        for batch in batches:
            names = [f"{root}/{k}.{s}" for k, s in zip(*(batch.column(c).to_pylist() for c in ("id", "suffix")), strict=True)]
            for name, content, more in zip(names, *(batch.column(c).to_pylist() for c in ("content", "blanks")), strict=True):
                content = content or b""
                with store.open_output_stream(name) as out:
                    out.write(content)
                    if not local:
                        for at in range(0, more, 1 << 20):
                            out.write(bytes(min(more - at, 1 << 20)))
                if local and more:
                    os.truncate(name, len(content) + more)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["path"])

    made = rows.select(F.col(id_col).cast("string").alias("id"), F.col(suffix_col).alias("suffix"), F.col(content_col).alias("content"), F.coalesce(blanks if blanks is not None else F.lit(0), F.lit(0)).cast("long").alias("blanks"))
    return written(made.mapInArrow(run, "path string"), "files")


def imported(files: DataFrame) -> DataFrame:
    """(path, url, timestamp, size, sha256, text, problem): the files of a folder as documents; those that are no text are left out."""
    mime = F.when(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*PLAIN), "text/plain").otherwise("text/html")
    found = files.withColumn("mimetype", mime).where(F.col("problem").isNotNull() | is_text(F.col("content"), F.col("mimetype")))
    body = found.withColumn("body", decode_body("content", "mimetype"))
    return body.select("path", "url", "timestamp", "size", F.sha2("content", 256).alias("sha256"), F.col("body.text").alias("text"), F.coalesce("problem", "body.problem").alias("problem"))


def decoded(data: bytes | None, content_type: str | None = "") -> str | None:
    """Text of a body: byte order mark, declared charset, UTF-8, then Windows-1252 or Latin-1.

    In HTML, a declared Latin-1 is read as Windows-1252. What a mark announces is read to its end, whatever is broken in it.
    """
    if data is None:
        return None
    for mark, name in MARKS:
        if data.startswith(mark):
            return data.decode(name, "replace")
    head, kind = data[:4096].decode("ascii", "ignore"), content_type or ""
    named = [re.search(r"""charset\s*=\s*['"]?([\w.-]+)""", kind, re.I), re.search(r"""charset\s*=\s*['"]?([\w.-]+)""", head, re.I), re.search(r"""<\?xml[^>]*\bencoding\s*=\s*['"]([^'"]+)""", head, re.I)]
    names = [m[1] for m in named if m] + ["utf-8", "cp1252"]
    if "html" in kind.lower() or re.search("<html|<!doctype html", head[:1024], re.I):
        names = ["cp1252" if n.lower() in ("latin-1", "iso-8859-1", "latin1") else n for n in names]
    for name in names:
        try:
            return data.decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
    return data.decode("latin-1")


def opened(data: bytes | None, most: int = MOST) -> tuple[bytes | None, str | None]:
    """A body without gzip, if it has that, and what is wrong: ``body_too_large`` beyond so many bytes. Broken gzip stays as it is."""
    if not data or data[:2] != b"\x1f\x8b":
        return data, None
    try:
        out = zlib.decompressobj(31).decompress(data, most + 1)
    except zlib.error:
        return data, None
    return (out, None) if len(out) <= most else (None, "body_too_large")


@sliced(StructType().add("text", "string").add("problem", "string"))
def decode_body(content: list, content_type: list) -> list:
    rows = []
    for c, kind in zip(content, content_type, strict=True):
        data, problem = opened(c)
        rows.append((decoded(data, kind), problem))
    return rows


def decode(content: Column | str, content_type: Column | str) -> Column:
    """The text of a body."""
    return decode_body(content, content_type)["text"]


def signed(data: bytes) -> bool:
    """Whether first bytes are surely those of another format. Marks of two or three letters count with a header that fits only."""
    number = lambda k: int.from_bytes(data[k : k + 4], "little")
    bitmap = data[:2] == b"BM" and len(data) >= 26 and number(14) in BITMAP_HEADERS and 14 + number(14) <= number(10) <= number(2)
    tagged = data[:3] == b"ID3" and len(data) >= 10 and data[3] <= 4 and max(data[6:10]) < 128
    return data.startswith(NOT_TEXT) or data[:4] == b"RIFF" and data[8:12] in RIFF or data[4:8] == b"ftyp" and len(data) >= 12 or bitmap or tagged


def textual(data: bytes | None, content_type: str | None = "") -> bool:
    """No signature of another format or media type; what a byte order mark or charset announces can be read; no NUL else, and few
    control characters."""
    if not data:
        return True
    head, kind = data[:SAMPLE], (content_type or "").lower()
    if signed(head) or kind.strip().startswith(("image/", "audio/", "video/", "font/")):
        return False
    wide = re.search(r"""charset\s*=\s*['"]?(utf[-_]?(?:16|32)[\w.-]*)""", kind)
    name = next((n for mark, n in MARKS if head.startswith(mark)), wide and wide[1])
    if name:
        try:  # the sample may end within a character
            text = codecs.getincrementaldecoder(name)("strict").decode(data[: 2 * SAMPLE])[:4096]
        except (LookupError, UnicodeError):
            return False
        codes = [ord(c) for c in text]
    elif 0 in head:
        return False
    else:
        codes = head
    return sum(c < 9 or 13 < c < 32 for c in codes) < 0.04 * max(1, len(codes))


@sliced(BooleanType())
def _is_text(sample: list, content_type: list) -> list:
    return [textual(c, t) for c, t in zip(sample, content_type, strict=True)]


def is_text(content: Column, content_type: Column) -> Column:
    """``textual`` of a body; only its first bytes leave the row."""
    return _is_text(F.substring(content, 1, 2 * SAMPLE), content_type)


def domain_list(lines: DataFrame) -> DataFrame:
    """(domain, lines): valid host names of a list, each once; ``*.`` and paths are cut off, comments skipped."""
    text = F.lower(F.trim(F.regexp_replace("value", r"#.*$", "")))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"^[a-z][a-z0-9+.-]*://", ""), r"^\*\.", ""), r"[/:*].*$", "")
    good = F.rlike(host, F.lit(r"^(?=.{4,253}$)([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z0-9-]{2,63}$"))
    return lines.select(host.alias("domain")).where(good).groupBy("domain").agg(F.count("*").alias("lines"))


def integrity(files: DataFrame, records: DataFrame) -> DataFrame:
    """(path, state): ok, missing, orphan, size_differs or digest_differs, of files and the records (path, size, sha256) on them."""
    own = files.select("path", F.col("size").alias("file_size"), F.sha2("content", 256).alias("file_sha"))
    joined = own.join(records.select("path", "size", "sha256"), "path", "full")
    state = (
        F.when(F.col("file_sha").isNull(), "missing").when(F.col("sha256").isNull(), "orphan").when(F.col("size") != F.col("file_size"), "size_differs")
        .when(F.col("sha256") != F.col("file_sha"), "digest_differs").otherwise("ok")
    )
    return joined.select("path", state.alias("state"))
