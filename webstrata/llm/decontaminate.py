"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' words build one suffix automaton. Each document's words are streamed through it, which gives at every word
the length of the longest run, ending there, that some item contains. A run of ``window`` words or more marks its words;
an item of fewer words marks where it occurs in full.

The automaton is broadcast in blocks of about ``BLOCK_BYTES`` of item text: a larger benchmark is cut into blocks by a
hash, and items of more than ``PART_WORDS`` words into parts that overlap by a window less one word. Blocks are worked off
one after the other, so one automaton is held at a time; each reads the documents (numbered once, in a written table), and the
spans of all blocks are joined per row. Results do not depend on the number of blocks. For a single block nothing is shuffled.

Null or empty texts have no words and no hits; null or wordless items match nothing; an item with a null id matches but is not
listed; repeated items count once for each id; repeated documents give repeated rows. ``find_matches`` reads only id and text
columns; ``remove_spans`` keeps all columns, whatever their names.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.llm._common import WORD_BYTES, ascii_words, free_name, map_slices, read, schema_of, texts_of, written

WINDOW = 10
#: Text of the items in one automaton; about 60 times as many bytes of Python objects at worst.
BLOCK_BYTES = 4 << 20
PART_WORDS = 20_000

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


class SuffixAutomaton:
    """Generalised suffix automaton over word sequences, with the items of each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        ended: dict[int, list[tuple[int, str]]] = {}
        for name, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
            if 0 < len(words) < window:
                ended.setdefault(last, []).append((len(words), name))
        #: By state: short items that end in it or in one of its suffixes, as (words, item).
        self.short: dict[int, tuple[tuple[int, str], ...]] = {}
        if ended:
            for s in sorted(range(len(self.next)), key=self.length.__getitem__):
                found = tuple(ended.get(s, ())) + (self.short.get(self.link[s], ()) if s else ())
                if found:
                    self.short[s] = found
        #: By state that holds a suffix of ``window`` words: the items it occurs in.
        self.items: dict[int, set[str]] = {}
        for name, words in items:
            s = 0
            for word in words:
                s = self.next[s][word]
                if self.length[s] >= window:
                    self.items.setdefault(self.window_state(s), set()).add(name)

    def _extend(self, last: int, word: bytes) -> int:
        at = self.next[last].get(word)
        if at is not None:
            return at if self.length[at] == self.length[last] + 1 else self._clone(last, at, word)
        new = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p != -1 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p != -1:
            at = self.next[p][word]
            self.link[new] = at if self.length[at] == self.length[p] + 1 else self._clone(p, at, word)
        return new

    def _clone(self, p: int, at: int, word: bytes) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[at]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[at])
        self.link[at] = copy
        while p != -1 and self.next[p].get(word) == at:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def window_state(self, state: int) -> int:
        """The state of the last ``window`` words of a longer run."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int, int]], set[str]]:
        """Hit spans (first word, end, longest matching length), joined where they touch or overlap, and the items that occur."""
        nxt, link, length, window, short = self.next, self.link, self.length, self.window, self.short
        root = nxt[0]
        state = run = 0
        found: list[tuple[int, int, int]] = []
        items: set[str] = set()
        for i, word in enumerate(words):
            if not state:
                if word not in root:
                    continue
                state, run = root[word], 1
            else:
                to = nxt[state].get(word)
                while to is None and state:
                    state = link[state]
                    to = nxt[state].get(word)
                    run = length[state]
                if to is None:
                    state = run = 0
                    continue
                state, run = to, run + 1
            reach = 0
            if run >= window:
                reach = window
                items |= self.items[self.window_state(state)]
            if short and state in short:
                for n, name in short[state]:
                    if n <= run:
                        reach = max(reach, n)
                        items.add(name)
            if reach:
                begin = i + 1 - reach
                longest = run
                while found and found[-1][1] >= begin:
                    b, _, far = found.pop()
                    begin, longest = min(b, begin), max(far, longest)
                found.append((begin, i + 1, longest))
        return found, items


def word_bytes(text: str) -> list[tuple[int, int]]:
    """Where the words of a text begin and end, in UTF-8 bytes."""
    return [m.span() for m in _WORD.finditer(text.encode("utf-8", "replace").translate(WORD_BYTES))]


def _item_blocks(items: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int) -> list[DataFrame]:
    """(item, words) in blocks by a hash; as many blocks as their measured size asks for."""
    own = items.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("text is not null")

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for item, text in zip(part.column("item").to_pylist(), texts_of(part, "text"), strict=True):
            words = ascii_words(text)
            rows += [(item, k, b" ".join(words[k : k + PART_WORDS + window - 1])) for k in range(0, max(1, len(words) - window + 1), PART_WORDS)]
        types = pa.string(), pa.int64(), pa.binary()
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["item", "part", "words"])

    parts = map_slices(own, "text", "item string, part long, words binary", run)
    size = parts.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    blocks = -(-int(size * 1.3) // block_bytes) if size > block_bytes else 1
    return [parts.where(F.pmod(F.xxhash64("item", "part"), F.lit(blocks)) == b) for b in range(blocks)]


def _automaton(block: DataFrame, window: int) -> SuffixAutomaton:
    """Of one block, whose size ``_item_blocks`` has bounded."""
    return SuffixAutomaton(sorted(((r.item, bytes(r.words).split()) for r in block.collect()), key=lambda r: (r[0] or "", r[1])), window)


_MATCHES = "n_words long, n_hit long, items array<string>, spans array<struct<first_word:int,end_word:int,longest:int>>"
_SPANS = pa.list_(pa.struct([("first_word", pa.int32()), ("end_word", pa.int32()), ("longest", pa.int32())]))


def _matches(own: DataFrame, block: DataFrame, window: int):
    """The columns of ``own`` but ``text``, with the matches of one block, and the broadcast that they need."""
    shared = own.sparkSession.sparkContext.broadcast(_automaton(block, window))
    names = [f for f in own.columns if f != "text"]

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text in texts_of(part, "text"):
            words = ascii_words(text)
            spans, found = shared.value.scan(words)
            out.append((len(words), sum(e - b for b, e, _ in spans), sorted(found - {None}), [{"first_word": b, "end_word": e, "longest": n} for b, e, n in spans]))
        columns = [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.string()), _SPANS))]
        return pa.RecordBatch.from_arrays([*(part.column(f) for f in names), *columns], names=[*names, "n_words", "n_hit", "items", "spans"])

    return map_slices(own, "text", f"{schema_of(own, *names)}, {_MATCHES}", run), shared


def _all_matches(numbered: DataFrame, blocks: list[DataFrame], window: int) -> DataFrame:
    """(row, n_words, n_hit, items, spans) over all blocks, one after the other; numbered: a written table (row, text)."""
    found = None
    for block in blocks:
        one, shared = _matches(numbered, block, window)
        one = written(one, name="matches")
        shared.destroy()
        found = one if found is None else found.unionByName(one)
    merged = found.groupBy("row").agg(
        F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("parts"),
    )

    def join(spans, s):  # of sorted spans: the last one grows, or a new one begins
        last = F.try_element_at(spans, F.lit(-1))
        grown = F.struct(last.first_word.alias("first_word"), F.greatest(last.end_word, s.end_word).alias("end_word"), F.greatest(last.longest, s.longest).alias("longest"))
        return F.when(last.end_word >= s.first_word, F.concat(F.slice(spans, 1, F.size(spans) - 1), F.array(grown))).otherwise(F.concat(spans, F.array(s)))

    merged = merged.withColumn("spans", F.aggregate("parts", F.array().cast("array<struct<first_word:int,end_word:int,longest:int>>"), join))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s.end_word - s.first_word)
    return merged.select("row", "n_words", hit.alias("n_hit"), "items", "spans")


def find_matches(
    docs: DataFrame, items: DataFrame, *, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Per document row: the id, ``n_words``, ``n_hit``, ``items`` (sorted ids as strings) and ``spans`` of hit words."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    blocks = _item_blocks(items, item_col, item_text_col, window, block_bytes)
    if len(blocks) == 1:
        found, _ = _matches(own, blocks[0], window)
    else:
        numbered = written(own.withColumn("row", F.monotonically_increasing_id()), name="numbered")
        found = numbered.select("row", "id").join(_all_matches(numbered.select("row", "text"), blocks, window), "row")
    return found.select(F.col("id").alias(id_col), "n_words", "n_hit", "items", "spans")


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without these spans of words."""
    raw, places = text.encode("utf-8", "replace"), word_bytes(text)
    kept, at = [], 0
    for b, e in spans:
        kept.append(raw[at : places[b][0]])
        at = places[e - 1][1]
    return b"".join([*kept, raw[at:]]).decode("utf-8", "replace")


def remove_spans(
    docs: DataFrame, items: DataFrame, *, text_col="text", item_col="item_id", item_text_col="text", window: int = WINDOW, max_coverage: float = 0.5, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The documents with every hit span cut out of the text; those whose hit words exceed ``max_coverage`` of all go.

    Coverage is judged once, over the whole text and all items. A text is cut again until no window is left, as the words
    around a cut meet. All columns of ``docs`` are kept.
    """
    names, schema = docs.columns, docs.schema
    at = names.index(text_col)
    blocks = _item_blocks(items, item_col, item_text_col, window, block_bytes)
    if len(blocks) > 1:
        return _remove_by_blocks(docs, text_col, blocks, window, max_coverage)
    shared = docs.sparkSession.sparkContext.broadcast(_automaton(blocks[0], window))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        texts, keep = part.column(at).to_pylist(), []
        for k, text in enumerate(texts):
            words = ascii_words(text or "")
            spans, _ = shared.value.scan(words)
            if sum(e - b for b, e, _ in spans) > max_coverage * len(words):
                continue
            keep.append(k)
            while spans:
                texts[k] = text = cut(text, [(b, e) for b, e, _ in spans])
                spans, _ = shared.value.scan(ascii_words(text))
        columns = [part.column(c) if c != at else pa.array(texts, part.schema.field(at).type) for c in range(part.num_columns)]
        return pa.RecordBatch.from_arrays(columns, schema=part.schema).take(pa.array(keep, pa.int64()))

    return map_slices(docs, text_col, schema, run)


def _remove_by_blocks(docs: DataFrame, text_col: str, blocks: list[DataFrame], window: int, max_coverage: float) -> DataFrame:
    """As ``remove_spans``, in rounds: the spans of all blocks by row, cuts, and again the rows that were cut."""
    names = docs.columns
    row, spans = free_name(names, "row"), free_name(names, "spans")
    schema = f"{schema_of(docs, *names)}, `{row}` long"
    rows, clean, judged = written(docs.withColumn(row, F.monotonically_increasing_id()), name="numbered"), [], False

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        at, by = part.schema.names.index(text_col), part.schema.names.index(spans)
        texts = [cut(t, [(s["first_word"], s["end_word"]) for s in own]) for t, own in zip(part.column(at).to_pylist(), part.column(by).to_pylist(), strict=True)]
        columns = [part.column(c) if c != at else pa.array(texts, part.schema.field(at).type) for c in range(len(names) + 1)]
        return pa.RecordBatch.from_arrays(columns, names=[*names, row])

    while True:
        found = written(_all_matches(rows.select(F.col(row).alias("row"), F.col(text_col).alias("text")), blocks, window), name="found")
        if not judged:
            found, judged = found.where(F.col("n_hit") <= max_coverage * F.col("n_words")), True
        joined = rows.join(found.select(F.col("row").alias(row), F.col("spans").alias(spans)), row).select(*names, row, spans)
        clean.append(joined.where(F.size(spans) == 0).select(*names))
        rows = written(map_slices(joined.where(F.size(spans) > 0), text_col, schema, run), name="cut")
        if rows.isEmpty():
            break
    out = clean[0]
    for more in clean[1:]:
        out = out.unionByName(more)
    return out


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The same rows in DuckDB, by a join of windows.
OP1_SQL = rf"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item, list_slice(w, k, k + n - 1) AS g, n FROM (SELECT item, w, least(len(w), {WINDOW}) AS n, unnest(range(1, greatest(len(w) - {WINDOW}, 0) + 2)) AS k FROM i WHERE len(w) > 0)),
p AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS k, w FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n),
h AS (SELECT doc_id, k, p.n, item FROM (SELECT doc_id, k, n, list_slice(w, k, k + n - 1) AS g FROM p) p JOIN g USING (g)),
c AS (SELECT doc_id, count(DISTINCT pos)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS pos FROM (SELECT DISTINCT doc_id, k, n FROM h)) GROUP BY doc_id),
f AS (SELECT doc_id, count(DISTINCT item)::BIGINT AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN f USING (doc_id)"""


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = find_matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
