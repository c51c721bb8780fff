"""SentencePiece encoding and decoding with a table of distinct chunks.

A vocabulary in which no piece continues after a white-space marker ("▁" only at a piece's start) lets merges never
cross the place before a marker. So a text is cut into marked words (markers, then other characters), each distinct
marked word is segmented once by the library, and a text's ids are the table's entries joined by position.

The table is built in each Python worker from the words it meets, and emptied beyond ``TABLE_BYTES``; words of more than
``LONG`` characters are segmented once in a slice and not kept. So no row is shuffled and nothing grows with the corpus. A
vocabulary with pieces across markers is refused with an error.

Null text is empty; an empty text has the begin and end ids only. Repeated rows give repeated rows. Kept columns that are
called ``ids`` or ``decoded`` give way to those made here.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.llm._common import free_name, map_slices, model_path, read, schema_of, texts_of

MARK = "▁"
#: Bytes of marked words and their ids that a table holds before it is emptied (about five times as much with all objects).
TABLE_BYTES = 6 << 20
#: Characters of the longest marked word that is kept.
LONG = 48
#: A marked word without its first marker, which the library itself puts in front.
_CHUNKS = re.compile(r" ( *[^ ]+| *$)")


class ChunkTable:
    """Ids and text of each distinct marked word of one vocabulary file."""

    def __init__(self, path: str, limit: int = TABLE_BYTES):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("this vocabulary has pieces across white-space markers")
        self.bos, self.eos = (np.array([i], "<u4").tobytes() for i in (self.sp.bos_id(), self.sp.eos_id()))
        self.alone = np.array([self.sp.piece_to_id(MARK)], "<u4").tobytes()
        #: odd: decoded text of the marked words that do not decode to themselves.
        self.limit, self.ids, self.odd = limit, {}, {}
        self.clear()

    def clear(self) -> None:
        self.ids.clear()
        self.odd.clear()
        self.ids[""], self.bytes, self.long = self.alone, 0, []

    def learn(self, chunks: set[str]) -> None:
        """Segment those marked words that the table lacks."""
        if self.bytes > self.limit:
            self.clear()
        if new := list(chunks - self.ids.keys()):
            self.long = [c for c in new if len(c) > LONG]
            self.bytes += sum(map(len, new))
            found = self.sp.encode(new, num_threads=1)
            lengths = np.fromiter(map(len, found), np.int64, len(found)) * 4
            packed, at = np.fromiter(chain.from_iterable(found), "<u4").tobytes(), 0
            self.bytes += len(packed)
            for chunk, n, back in zip(new, lengths.tolist(), self.sp.decode(found, num_threads=1), strict=True):
                self.ids[chunk] = packed[at : at + n]
                at += n
                if back != chunk:
                    self.odd[chunk] = back

    @staticmethod
    def chunks(text: str) -> list[str]:
        """The marked words of a text that isn't empty, each without its first marker."""
        parts = text.replace(MARK, " ").split(" ")
        return _CHUNKS.findall(" " + text.replace(MARK, " ")) if "" in parts else parts

    def encode(self, texts: list[str], begin_end: bool = True) -> tuple[list[bytes], list[str]]:
        """Ids as little-endian unsigned 32-bit integers, and what they decode to."""
        cut = [self.chunks(t) if t else [] for t in texts]
        self.learn(set(chain.from_iterable(cut)))
        head, tail = (self.bos, self.eos) if begin_end else (b"", b"")
        ids = [b"".join((head, *map(self.ids.__getitem__, c), tail)) for c in cut]
        decoded = [" ".join([self.odd.get(x, x) for x in c] if self.odd else c) for c in cut]
        for chunk in self.long:
            self.bytes -= len(chunk) + len(self.ids.pop(chunk))
            self.odd.pop(chunk, None)
        self.long = []
        return ids, decoded


_TABLES: dict[str, ChunkTable] = {}


def table(path: str) -> ChunkTable:
    """One table for a Python worker and vocabulary, kept between tasks."""
    if path not in _TABLES:
        _TABLES[path] = ChunkTable(path)
    return _TABLES[path]


def encode_decode(
    docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", begin_end: bool = True, keep: list[str] | None = None
) -> DataFrame:
    """Per row: the kept columns (the id column if none are given), ``ids`` (binary: little-endian unsigned 32-bit
    integers) and ``decoded`` (the text that decode(ids) gives)."""
    keep = [k for k in keep or [id_col] if k.lower() not in ("ids", "decoded")]
    own_text = free_name(keep, "text")
    own = docs.select(*keep, F.col(text_col).alias(own_text))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        ids, decoded = table(path).encode(texts_of(part, own_text), begin_end)
        columns = [part.column(c) for c in range(len(keep))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], names=[*keep, "ids", "decoded"])

    return map_slices(own, own_text, ", ".join([schema_of(docs, *keep)] * bool(keep) + ["ids binary, decoded string"]), run)


def ids_as_array(ids: str = "ids"):
    """The packed ids as array<int>, with column functions."""
    hexed = F.hex(ids)
    n = (F.length(F.col(ids)) / 4).cast("int")
    flipped = lambda i: F.concat(*[F.substring(hexed, i * 8 + k, F.lit(2)) for k in (7, 5, 3, 1)])
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(flipped(i), 16, 10).cast("int"))).otherwise(F.array().cast("array<int>"))


def op6_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    coded = encode_decode(read(spark, sf_dir, "documents"), model_path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
