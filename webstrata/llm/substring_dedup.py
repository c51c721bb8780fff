"""Substring dedup by relative Lempel-Ziv parsing: text that stood before is told by long factors against reference blocks.

A window is ``WINDOW`` consecutive words. Comparing each document with each block of all others would grow with the square of the
corpus, so the corpus is dealt to reference blocks by content: of the four-word grams inside a window the one with the least hash is
the window's anchor; consecutive windows of one anchor form a piece (20 to 36 words). Equal windows have equal anchors, wherever they
stand, so all that a window could repeat lies in the reference block of its anchor, and each document is factored against
every block that can hold anything of it.

1. One pass emits anchor, digest of the piece and place; Spark keeps for each anchor the first place and whether all its pieces agree
   (least and greatest digest; anchor and digest are 128 bits). Where they agree, the first piece holds the first of each window.
2. Anchors whose pieces differ are set in a table of 2^27 bits. A second pass emits these pieces with their words (and strangers that
   share a bit, which does no harm); Spark keeps the first place of each distinct piece and sorts them by anchor and place.
3. Each block's pieces are parsed greedily, in order, against the index of what the block has read: a window that the index
   holds begins a factor, which is extended to the right word by word; the first window over the factor's end is looked up
   next, so none over a boundary is missed. A window that is not found is a first one and is indexed.
   An anchor with more than ``HOT_PIECES`` distinct pieces is not parsed in one task: its windows are grouped by their words.
4. The first windows are gathered by document and joined with the texts; all other windows are repeats, their words go.

Documents come in the order of their ids, rows of one id in the order of a hash of their text (equal rows in any order), null
ids first. Null and empty texts have no words; documents of fewer words than a window lose nothing. Further columns are not read.
"""

from __future__ import annotations

from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from webstrata.llm._common import SLOT_BITS, Held, bit_table, give_back, in_table, map_slices, read, slices, stretches, texts_of, whole_groups, written

WINDOW = 20
GRAM = 4
#: Distinct pieces of one anchor that one task parses.
HOT_PIECES = 20_000

_U = np.uint64
_WORD_HASH = Held(1 << 20)
_SPACE = bytes(32 if b in b"\t\n\x0b\x0c\r" else b for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64."""
    x = x + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    held = _WORD_HASH
    held.room()
    new = set(words) - held.keys()
    held.update((w, int.from_bytes(blake2b(w, digest_size=8).digest(), "little")) for w in new)
    held.bytes += sum(map(len, new))
    return np.fromiter(map(held.__getitem__, words), np.uint64, len(words))


def _word_runs(texts: list[str], window: int):
    """(texts' numbers, first words, word lists) of bounded size together; a long text comes in parts that overlap by a window less one word."""
    numbers, firsts, lists, size = [], [], [], 0
    for k, text in enumerate(texts):
        first, carry = 0, []
        for raw in stretches(text.encode("utf-8", "replace").translate(_SPACE)):
            own = raw.split()
            words = carry + own
            if len(words) >= window:
                numbers.append(k)
                firsts.append(first)
                lists.append(words)
                size += len(raw)
                first, carry = first + len(words) - window + 1, words[len(words) - window + 1 :]
                if size > 1 << 20:
                    yield numbers, firsts, lists
                    numbers, firsts, lists, size = [], [], [], 0
            else:
                carry = words
    if lists:
        yield numbers, firsts, lists


def pieces(texts: list[str], window: int = WINDOW, with_words=None) -> dict[str, np.ndarray | list]:
    """The distinct pieces of each text: text, start (word), count (windows), anchor, digest; with_words: function of the anchors
    that tells which pieces are wanted, then with their ``words`` (joined by spaces)."""
    out = {"text": [], "start": [], "count": [], "anchor": [], "digest": []}
    wanted_words: list[bytes] = []
    gram = min(GRAM, window)
    span = window - gram + 1
    for numbers, firsts, lists in _word_runs(texts, window):
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = list(chain.from_iterable(lists))
        h = word_hashes(flat)
        n = len(flat) - gram + 1
        g = np.zeros(n, np.uint64)
        for k in range(gram):
            g = mix(g ^ h[k : k + n])
        best, size = np.arange(n), 1
        while size * 2 <= span:
            a, b = best[:-size], best[size:]
            best = np.where(g[b] < g[a], b, a)
            size *= 2
        if span > size:
            a, b = best[: len(best) - (span - size)], best[span - size :]
            best = np.where(g[b] < g[a], b, a)
        owner = np.repeat(np.arange(len(lists)), lengths)
        s = np.flatnonzero(owner[: len(best)] == owner[window - 1 :][: len(best)])
        new = np.flatnonzero(np.r_[True, (best[s[1:]] != best[s[:-1]]) | (owner[s[1:]] != owner[s[:-1]])])
        start, count, anchor = s[new], np.diff(np.r_[new, len(s)]), g[best[s[new]]]
        powers = np.multiply.accumulate(np.full(len(flat) + 1, 0x9E3779B97F4A7C15, np.uint64))
        sums = np.r_[_U(0), np.cumsum(mix(h) * powers[:-1], dtype=np.uint64)]
        back = pow(0x9E3779B97F4A7C15, -1, 1 << 64)
        inverse = np.multiply.accumulate(np.full(len(flat) + 1, back, np.uint64))
        digest = mix((sums[start + count + window - 1] - sums[start]) * inverse[start] ^ count.astype(np.uint64))
        begins = np.cumsum(lengths) - lengths
        if with_words is not None:
            keep = with_words(anchor)
            start, count, anchor, digest = start[keep], count[keep], anchor[keep], digest[keep]
            wanted_words += [b" ".join(flat[b:e]) for b, e in zip(start.tolist(), (start + count + window - 1).tolist(), strict=True)]
        at = owner[start]
        out["text"].append(np.asarray(numbers, np.int64)[at])
        out["start"].append(start - begins[at] + np.asarray(firsts, np.int64)[at])
        out["count"].append(count)
        out["anchor"].append(anchor)
        out["digest"].append(digest)
    found = {k: np.concatenate(v) if v else np.zeros(0, np.uint64 if k in ("anchor", "digest") else np.int64) for k, v in out.items()}
    order = np.lexsort((found["start"], found["digest"], found["anchor"], found["text"]))
    same = np.zeros(len(order), bool)
    for k in ("digest", "anchor", "text"):
        v = found[k][order]
        same[1:] = (v[1:] == v[:-1]) & (same[1:] if k != "digest" else True)
    keep = np.sort(order[~same])
    result = {k: v[keep] for k, v in found.items()}
    if with_words is not None:
        result["words"] = [wanted_words[k] for k in keep.tolist()]
    return result


def _ordered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(at, id, text): ``at`` is a whole number for each row, in the order of documents."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    unique = isinstance(own.schema["id"].dataType, LongType) and own.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 or id is null").isEmpty()
    if unique:
        return own.select(F.col("id").alias("at"), "id", "text")
    by = [F.asc_nulls_first("id"), F.xxhash64("text").asc()]
    return written(own.repartitionByRange(*by).sortWithinPartitions(*by).select(F.monotonically_increasing_id().alias("at"), "id", "text"), name="ordered")


def _parsed(distinct: DataFrame, window: int) -> DataFrame:
    """(at, start, count): runs of first windows, by greedy parsing of each anchor's pieces in order."""

    def parse(index: dict[bytes, tuple[list[bytes], int]], words: list[bytes]) -> list[tuple[int, int]]:
        firsts: list[tuple[int, int]] = []
        i, last = 0, len(words) - window
        while i <= last:
            key = b" ".join(words[i : i + window])
            found = index.get(key)
            if found is None:
                index[key] = words, i
                if firsts and firsts[-1][0] + firsts[-1][1] == i:
                    firsts[-1] = firsts[-1][0], firsts[-1][1] + 1
                else:
                    firsts.append((i, 1))
                i += 1
            else:
                source, j = found
                length = window
                while i + length < len(words) and j + length < len(source) and words[i + length] == source[j + length]:
                    length += 1
                i += length - window + 1  # the first window over the factor's end
        return firsts

    def run(batches):
        for table in whole_groups(batches, ["anchor"]):
            at_now, index, out = None, {}, []
            for anchor, raw, at, start in zip(*(table.column(c).to_pylist() for c in ("anchor", "words", "at", "start")), strict=True):
                if anchor != at_now:
                    at_now, index = anchor, {}
                out += [(at, start + b, n) for b, n in parse(index, raw.split(b" "))]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(3)], names=["at", "start", "count"])
        give_back()

    return distinct.repartition("anchor").sortWithinPartitions("anchor", "at", "start").mapInArrow(run, "at long, start long, count long")


def _hot_windows(distinct: DataFrame, window: int) -> DataFrame:
    """(at, start, count) of first windows among the pieces of anchors with very many: grouped by the windows' words."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for raw, at, start in zip(*(part.column(c).to_pylist() for c in ("words", "at", "start")), strict=True):
            words = raw.split(b" ")
            out += [(b" ".join(words[k : k + window]), at, start + k) for k in range(len(words) - window + 1)]
        return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.int64()))], names=["words", "at", "start"])

    each = map_slices(distinct, "words", "words binary, at long, start long", run, 1 << 18)
    each = each.groupBy("words", "at").agg(F.min("start").alias("start"))
    return each.groupBy("words").agg(F.min("at").alias("at"), F.min_by("start", "at").alias("start")).select("at", "start", F.lit(1).cast("long").alias("count"))


def first_windows(ordered: DataFrame, window: int = WINDOW, hot_pieces: int = HOT_PIECES) -> DataFrame:
    """(at, start, count): runs of windows that stand nowhere earlier. ordered: (at, text)."""
    own = ordered.select("at", "text")

    def places(part: pa.RecordBatch) -> pa.RecordBatch:
        p = pieces(texts_of(part, "text"), window)
        at = part.column("at").take(pa.array(p["text"]))
        return pa.RecordBatch.from_arrays([*(pa.array(p[c].astype(np.int64)) for c in ("anchor", "digest")), at, *(pa.array(p[c].astype(np.int32)) for c in ("start", "count"))], names=["anchor", "digest", "at", "start", "count"])

    anchors = map_slices(own, "text", "anchor long, digest long, at long, start int, count int", places).groupBy("anchor").agg(
        (F.min("digest") == F.max("digest")).alias("same"), F.min("at").alias("at"), F.min_by("start", "at").alias("start"), F.min_by("count", "at").alias("count"),
    )
    slot = F.expr(f"anchor & {(1 << SLOT_BITS) - 1}")
    anchors = written(anchors.select(F.when(~F.col("same"), slot).alias("slot"), *[F.when(F.col("same"), F.col(c)).alias(c) for c in ("at", "start", "count")]), name="anchors")
    table = own.sparkSession.sparkContext.broadcast(bit_table(anchors, "slot"))

    def differing(part: pa.RecordBatch) -> pa.RecordBatch:
        p = pieces(texts_of(part, "text"), window, lambda a: in_table(table.value, a & _U((1 << SLOT_BITS) - 1)))
        at = part.column("at").take(pa.array(p["text"]))
        return pa.RecordBatch.from_arrays([pa.array(p["anchor"].astype(np.int64)), pa.array(p["words"], pa.binary()), at, pa.array(p["start"].astype(np.int32))], names=["anchor", "words", "at", "start"])

    distinct = map_slices(own, "text", "anchor long, words binary, at long, start int", differing)
    distinct = written(distinct.groupBy("anchor", "words").agg(F.min("at").alias("at"), F.min_by("start", "at").cast("long").alias("start")), name="pieces")
    hot = written(distinct.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > hot_pieces).select("anchor"), name="hot")
    few = distinct.join(hot, "anchor", "left_anti")
    many = distinct.join(hot, "anchor", "left_semi")
    alone = anchors.where("at is not null").select("at", F.col("start").cast("long").alias("start"), F.col("count").cast("long").alias("count"))
    return alone.unionByName(_parsed(few, window)).unionByName(_hot_windows(many, window))


def repeats_removed(docs: DataFrame, *, id_col="doc_id", text_col="text", window: int = WINDOW, hot_pieces: int = HOT_PIECES) -> DataFrame:
    """(id, n_words, n_removed, spans, kept): the spans of words (first, end) that repeat earlier text, and the words without them, joined by spaces."""
    ordered = _ordered(docs, id_col, text_col)
    runs = first_windows(ordered, window, hot_pieces).groupBy("at").agg(F.collect_list(F.struct("start", "count")).alias("runs"))
    joined = ordered.join(runs, "at", "left").select("id", "text", "runs")

    def one(text: str, runs: pa.Scalar) -> tuple[int, int, list[dict[str, int]], bytes]:
        parts = list(stretches(text.encode("utf-8", "replace").translate(_SPACE)))
        counts = [len(p.split()) for p in parts]
        n = sum(counts)
        gone = np.zeros(n, bool)
        if n >= window:
            own = runs.values if runs.is_valid else None
            steps = np.zeros(n + 1, np.int64)
            if own is not None:
                begin, count = (own.field(k).to_numpy() for k in (0, 1))
                np.add.at(steps, begin, 1)
                np.add.at(steps, begin + count, -1)
            repeated = np.flatnonzero(np.cumsum(steps[: n - window + 1]) <= 0)
            steps = np.zeros(n + 1, np.int64)
            np.add.at(steps, repeated, 1)
            np.add.at(steps, repeated + window, -1)
            gone = np.cumsum(steps[:n]) > 0
        edge = np.diff(np.r_[False, gone, False].astype(np.int8))
        spans = [{"first": int(b), "end": int(e)} for b, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]
        if not spans and len(parts) == 1:
            return n, 0, spans, b" ".join(parts[0].split())
        kept, at = [], 0
        for part, m in zip(parts, counts, strict=True):
            words = part.split()
            kept += [b" ".join(words[k] for k in np.flatnonzero(~gone[at : at + m]).tolist())]
            at += m
        return n, int(gone.sum()), spans, b" ".join(k for k in kept if k)

    span_type = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [one(t, r) for t, r in zip(texts_of(part, "text"), part.column("runs"), strict=True)]
                columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), span_type))]
                kept = pa.array([r[3].decode("utf-8", "replace") for r in rows], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("id"), *columns, kept], names=["id", "n_words", "n_removed", "spans", "kept"])
        give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    out = joined.mapInArrow(run, f"id {kind}, n_words long, n_removed long, spans array<struct<first:long,end:long>>, kept string")
    return out.withColumnRenamed("id", id_col)


#: The same rows in DuckDB.
OP12_SQL = rf"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, k, array_to_string(list_slice(w, k, k + {WINDOW - 1}), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS k FROM d)),
r AS (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY g ORDER BY doc_id, k) AS n FROM g) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(k, k + {WINDOW})) AS k FROM r),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS kept, count(*)::BIGINT AS n FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM d) ANTI JOIN c USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""


def op12_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return repeats_removed(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
