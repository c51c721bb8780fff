"""Ranked lexical search by presence masks: each item's documents are grouped by which of its terms they hold.

The items' terms form a table (in blocks of items, so that the table is bounded). One pass over the texts keeps of each
document its length and its terms of the table with their counts; the numbers of documents and terms, and the documents of
each term, are counted from these rows by Spark. The second pass works on blocks of documents: each term has a bitmap over
the block; the bitmaps of an item's terms are turned over into one mask for each document, and equal masks form a group.
A mask's greatest possible score is the sum, over its terms, of the most that the term brings to any document of the block.
Masks are evaluated exactly, in order of that sum, until none can reach the item's last place so far; a task carries its places
from block to block. Places of all tasks are merged by item.

Scores are integers, so results do not depend on the order of work. Documents without terms (null, empty) get no place; an item
without terms has no places; items with repeated ids are items of their own, side by side; repeated documents get places of their
own; of equal scores the smaller id comes first, null ids last. Further columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.llm._common import WORD_BYTES, ascii_words, give_back, map_slices, read, stretches, texts_of, top_rows, written

PLACES = 20
#: Of one block of items: bytes of text, so at most half as many terms. Of one block of documents: rows, bits of bitmaps, counted terms.
ITEM_BYTES = 1 << 20
BLOCK_ROWS, BLOCK_BITS, BLOCK_TERMS = 8192, 1 << 28, 2 << 20


def item_blocks(items: DataFrame, item_col: str, text_col: str, block_bytes: int) -> list[DataFrame]:
    """(number, item, text) in blocks by a hash of the row's number; as many as their measured size asks for."""
    numbered = written(items.select(F.monotonically_increasing_id().alias("number"), F.col(item_col).alias("item"), F.col(text_col).alias("text")).where("text is not null"), name="items")
    size = numbered.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-int(size * 1.3) // block_bytes) if size > block_bytes else 1
    return [numbered.where(F.pmod(F.xxhash64("number"), F.lit(blocks)) == b) for b in range(blocks)]


def counted_terms(docs: DataFrame, id_col: str, text_col: str, table: dict[bytes, int]) -> DataFrame:
    """(id, n, terms, counts): each document's number of terms, and those of the table with their counts, by ascending number."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        get, lengths, terms, counts = shared.value.get, [], [], []
        for text in texts_of(part, "text"):
            n, held = 0, Counter()
            for raw in stretches(text.encode("utf-8", "replace").translate(WORD_BYTES)):
                words = raw.split()
                n += len(words)
                held.update(map(get, words))
            held.pop(None, None)
            found = sorted(held)
            lengths.append(n)
            terms.append(found)
            counts.append([held[t] for t in found])
        return pa.RecordBatch.from_arrays([part.column("id"), pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], names=["id", "n", "terms", "counts"])

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return written(map_slices(own, "text", "id long, n long, terms array<int>, counts array<long>", run), name="terms")


class Places:
    """The best documents of each item so far: at most ``most`` of each."""

    def __init__(self, items: list[tuple[int, np.ndarray, np.ndarray]], most: int):
        """items: (number, distinct terms, what one unit of each is worth)."""
        self.items, self.most = items, most
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in items]

    def add(self, ids: np.ndarray, none: np.ndarray, owner: np.ndarray, term: np.ndarray, unit: np.ndarray) -> None:
        """A block: ids (and which are null) of its documents; document, term and unit of each counted term."""
        rows = len(ids)
        order = np.lexsort((owner, term))
        owner, term, unit = owner[order], term[order], unit[order]
        begins = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
        held, most = term[begins], np.maximum.reduceat(unit, begins) if len(term) else unit
        bitmaps = np.zeros((len(held), -(-rows // 8)), np.uint8)
        line = np.repeat(np.arange(len(held)), np.diff(np.r_[begins, len(term)]))
        np.bitwise_or.at(bitmaps, (line, owner >> 3), (128 >> (owner & 7)).astype(np.uint8))
        for k, (_, terms, worth) in enumerate(self.items):
            at = np.searchsorted(held, terms)
            inside = at < len(held)
            inside[inside] = held[at[inside]] == terms[inside]
            if inside.any():
                at, worth = at[inside], worth[inside]
                self.best[k] = self._search(self.best[k], bitmaps[at], begins[at], worth, worth * most[at], unit, ids, none)

    def _search(self, best, bitmaps, begins, worth, tops, unit, ids, none):
        some = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(bitmaps, axis=0), count=len(ids)))  # documents with a term
        bits = np.unpackbits(bitmaps, axis=1, count=len(ids))
        masks = np.packbits(bits[:, some], axis=0)  # turned over: one mask for each document
        wide = np.zeros((len(some), -(-len(masks) // 8) * 8), np.uint8)
        wide[:, : len(masks)] = masks.T
        keys = wide.view(np.uint64)
        order = np.argsort(keys[:, 0], kind="stable") if keys.shape[1] == 1 else np.lexsort(keys.T)
        sorted_keys = keys[order]
        first = np.flatnonzero(np.r_[True, (sorted_keys[1:] != sorted_keys[:-1]).any(axis=1)])
        sizes = np.diff(np.r_[first, len(order)])
        reach = tops @ bits[:, some[order[first]]].astype(np.int64)  # the greatest possible score of each mask
        by = np.argsort(-reach, kind="stable")
        place = None  # of a document's unit among the term's: the rank of its bit
        at, step = 0, 64
        while at < len(by):
            least = best[0][-1] if len(best[0]) == self.most else 1
            take = by[at : at + step]
            take = take[reach[take] >= least]
            if not len(take):
                break
            at, step = at + step, step * 2
            members = some[order[np.repeat(first[take], sizes[take]) + np.arange(sizes[take].sum()) - np.repeat(np.cumsum(sizes[take]) - sizes[take], sizes[take])]]
            if place is None:
                place = np.cumsum(bits, axis=1, dtype=np.int32) - 1
            there = bits[:, members].astype(bool)
            units = np.where(there, unit[np.where(there, begins[:, None] + place[:, members], 0)], 0)
            scores = worth @ units
            keep = scores >= max(least, 1)
            best = self._merged(best, (scores[keep], ids[members[keep]], none[members[keep]]))
        return best

    def _merged(self, a, b):
        scores, ids, none = (np.concatenate(x) for x in zip(a, b, strict=True))
        order = np.lexsort((ids, none, -scores))[: self.most]
        return scores[order], ids[order], none[order]

    def rows(self) -> pa.RecordBatch:
        number = np.repeat([i[0] for i in self.items], [len(b[0]) for b in self.best]).astype(np.int64)
        scores, ids, none = (np.concatenate([b[k] for b in self.best]) if self.best else np.zeros(0, t) for k, t in enumerate((np.int64, np.int64, bool)))
        return pa.RecordBatch.from_arrays([pa.array(number), pa.array(ids, pa.int64(), mask=none), pa.array(scores, pa.int64())], names=["number", "id", "score"])


def _ranked(counted: DataFrame, items: list[tuple[int, np.ndarray, np.ndarray]], terms: int, total: int, length: int, most: int) -> DataFrame:
    shared = counted.sparkSession.sparkContext.broadcast(items)
    rows_in_block = max(64, min(BLOCK_ROWS, BLOCK_BITS // max(terms, 1)))

    def run(batches):
        places, held, rows, n_terms = Places(shared.value, most), [], 0, 0

        def flush():
            table = pa.Table.from_batches(held).combine_chunks()
            lengths = table.column("n").to_numpy()
            lists = table.column("terms").combine_chunks()
            lists, counts = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (lists, table.column("counts").combine_chunks()))
            owner = np.repeat(np.arange(table.num_rows), np.diff(lists.offsets.to_numpy()))
            term, tf = lists.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy()
            m = 75 + (25 * lengths * total) // length
            ids = table.column("id")
            places.add(ids.fill_null(np.iinfo(np.int64).max).to_numpy(), ids.is_null().to_numpy(), owner, term, (1_000_000_000 * tf) // (1000 * tf + 12 * m[owner]))

        for batch in batches:
            ends = batch.column("terms").offsets.to_numpy()
            at = 0
            while at < batch.num_rows:
                room = max(1, BLOCK_TERMS - n_terms)
                to = min(at + rows_in_block - rows, max(at + 1, int(np.searchsorted(ends, ends[at] + room, side="right")) - 1), batch.num_rows)
                held.append(batch.slice(at, to - at))
                rows, n_terms, at = rows + to - at, n_terms + int(ends[to] - ends[at]), to
                if rows >= rows_in_block or n_terms >= BLOCK_TERMS:
                    flush()
                    held, rows, n_terms = [], 0, 0
        if held:
            flush()
        yield places.rows()
        give_back()

    return counted.where(F.size("terms") > 0).mapInArrow(run, "number long, id long, score long")


def search(
    docs: DataFrame, items: DataFrame, *, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text", most: int = PLACES, block_bytes: int = ITEM_BYTES
) -> DataFrame:
    """(item, rank, id, score): the ``most`` best documents of each item. Ids of documents are whole numbers."""
    out = None
    for block in item_blocks(items, item_col, item_text_col, block_bytes):
        own = [(r.number, Counter(ascii_words(r.text))) for r in block.select("number", "text").toLocalIterator()]  # a block: at most block_bytes
        table = {t: k for k, t in enumerate(sorted({t for _, c in own for t in c}))}
        counted = counted_terms(docs, id_col, text_col, table)
        facts = counted.agg(F.count_if(F.col("n") > 0).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
        df = {r.term: r.df for r in counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toLocalIterator()}
        weight = np.array([math.floor(1000 * math.log((2 * facts.n + 2) / (2 * df.get(k, 0) + 1))) for k in range(len(table))], np.int64)
        asked = []
        for number, terms in own:
            known = sorted((table[t], c) for t, c in terms.items() if table[t] in df)
            if known:
                numbers = np.array([t for t, _ in known], np.int64)
                asked.append((number, numbers, weight[numbers] * np.array([c for _, c in known], np.int64)))
        one = _ranked(counted, asked, len(table), facts.n, max(facts.length, 1), most)
        one = top_rows(one, "number", [F.desc("score"), F.asc_nulls_last("id")], most).join(block.select("number", "item"), "number")
        one = one.select(F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
        out = one if out is None else out.unionByName(one)
    return out


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"
#: The same rows in DuckDB.
OP11_SQL = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
i AS (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS w FROM benchmark),
s AS (SELECT count(*) FILTER (len(w) > 0)::BIGINT AS n, sum(len(w))::BIGINT AS l FROM d),
it AS (SELECT q, term, count(*)::BIGINT AS c FROM (SELECT q, unnest(w) AS term FROM i) GROUP BY ALL),
t AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM it) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * s.n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM t, s GROUP BY term, s.n),
m AS (SELECT r, doc_id, 75 + (25 * len(w)::BIGINT * s.n) // s.l AS m FROM d, s),
c AS (SELECT q, r, doc_id, sum(c * weight * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM it JOIN t USING (term) JOIN f USING (term) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id)::INTEGER AS rank FROM c WHERE score > 0) JOIN i USING (q) WHERE rank <= {PLACES}"""


def op11_ranked_search(spark, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
