"""Phrase collocation mining with counting quotient filters, exact for all phrases of up to four words.

A phrase that occurs ``LEAST`` times consists of words that do. The words that occur so often get ids in each language, of 16
bits or as many more as the language needs. A phrase is the packed ids of its words. An invertible permutation of these 32 to 84
bits spreads the phrases evenly; the top bits of the result are the quotient, all others the remainder, so nothing is lost and
a filter's slots give back the phrases. A filter holds its entries in ascending order: run lengths of the quotients in unary bits,
remainders in as few bytes as they need, counters of one byte (larger ones aside).

1. Words are counted by task and summed by Spark.
2. Each task counts its pairs of words in a filter for each language, cut by quotient into shards; filters of one shard are
   merged in sorted order. Pairs that occur ``LEAST`` times are set in a table of 2^27 bits.
3. The same is done for phrases of three and four words all of whose pairs are in that table (which only spares work).
4. Cuts, scores, containment and ranks are joins and aggregations over the phrases that occur ``LEAST`` times.

All languages together have ``TABLE_WORDS`` words with ids at most, each its most frequent ones. Phrases with other words
that occur often enough are counted by their text, so no phrase is missed.

Null texts are empty, a null language is ``und``; texts without words give nothing; repeated rows count again; ties are ranked by the
phrase. Further columns are not read.
"""

from __future__ import annotations

from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.llm._common import SLOT_BITS, bit_table, give_back, in_table, read, slices, stretches, texts_of, top_rows, written

LEAST, LONGEST, COVER = 30, 4, 80
FIRST = 2000
#: Words with ids, of all languages together; each language has as many of them at most, and fewer than ``MOST_IDS``.
TABLE_WORDS, MOST_IDS = 500_000, 1 << 21
#: Distinct phrases that a task holds before it hands on its filters; phrases of one shard, about.
HELD, SHARD = 2 << 20, 2 << 20

_U = np.uint64
_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
#: A-Z in lower case, all separators as one, tabs as spaces.
_PIECES = bytes(b + 32 if 65 <= b <= 90 else 46 if b in _SEPARATORS else 32 if b == 9 else b for b in range(256))


def tokens(text: str):
    """Lists of words of a text in parts of bounded size; b"." stands for separators. A part ends between words."""
    for raw in stretches(text.encode("utf-8", "replace").translate(_PIECES)):
        yield raw.replace(b".", b" . ").split()


# the filter


def permuted(x: np.ndarray, bits: int) -> np.ndarray:
    """A permutation of the whole numbers of ``bits`` bits, at most 64."""
    mask = _U((1 << bits) - 1)
    for odd in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
        x = x * _U(odd) & mask
        x = x ^ (x >> _U(-(-bits // 2)))
    return x


def restored(x: np.ndarray, bits: int) -> np.ndarray:
    """What ``permuted`` was given."""
    mask = _U((1 << bits) - 1)
    for odd in (0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15):
        x = x ^ (x >> _U(-(-bits // 2)))
        x = x * _U(pow(odd, -1, 1 << 64)) & mask
    return x


class Keys:
    """Whole numbers of ``bits`` bits, 128 at most: ``low`` has the last 64 bits, ``high`` those before, if there are any."""

    def __init__(self, high: np.ndarray | None, low: np.ndarray, bits: int):
        self.high, self.low, self.bits = high, low, bits

    def __len__(self) -> int:
        return len(self.low)

    def __getitem__(self, at) -> Keys:
        return Keys(None if self.high is None else self.high[at], self.low[at], self.bits)

    @classmethod
    def of_words(cls, ids: list[np.ndarray], width: int) -> Keys:
        """Packed ids of ``width`` bits each, permuted: as one number, or in three rounds over two halves where that is too wide."""
        bits = width * len(ids)
        if bits <= 64:
            key = ids[0]
            for i in ids[1:]:
                key = key << _U(width) | i
            return cls(None, permuted(key, bits), bits)
        half, mask = bits // 2, _U((1 << bits // 2) - 1)
        a, b = (x << _U(width) | y for x, y in (ids[:2], ids[2:]))
        a = a ^ (permuted(b, 64) & mask)
        b = b ^ (permuted(a, 64) & mask)
        a = a ^ (permuted(b, 64) & mask)
        return cls(a >> _U(64 - half), a << _U(half) | b, bits)

    def words(self, n: int) -> list[np.ndarray]:
        """The ids of ``n`` words that ``of_words`` was given."""
        width = self.bits // n
        mask = _U((1 << width) - 1)
        if self.high is None:
            key = restored(self.low, self.bits)
            return [key >> _U(width * (n - 1 - k)) & mask for k in range(n)]
        half, part = self.bits // 2, _U((1 << self.bits // 2) - 1)
        a, b = self.high << _U(64 - half) | self.low >> _U(half), self.low & part
        a = a ^ (permuted(b, 64) & part)
        b = b ^ (permuted(a, 64) & part)
        a = a ^ (permuted(b, 64) & part)
        return [a >> _U(width), a & mask, b >> _U(width), b & mask]

    def top(self, n: int) -> np.ndarray:
        """The first ``n`` bits."""
        if n == 0:
            return np.zeros(len(self), np.uint64)
        if self.high is None:
            return self.low >> _U(self.bits - n)
        more = n - (self.bits - 64)
        return self.high >> _U(-more) if more <= 0 else self.high << _U(more) | self.low >> _U(64 - more)

    def rest(self, n: int) -> Keys:
        """All bits but the first ``n``."""
        left = self.bits - n
        if left > 64:
            return Keys(self.high & _U((1 << (left - 64)) - 1), self.low, left)
        return Keys(None, self.low & _U((1 << left) - 1), left)

    @classmethod
    def joined(cls, top: np.ndarray, n: int, rest: Keys) -> Keys:
        """The numbers of which ``top`` holds the first ``n`` bits and ``rest`` the others."""
        bits = n + rest.bits
        if bits <= 64:
            return cls(None, top << _U(rest.bits) | rest.low if n else rest.low, bits)
        if rest.bits >= 64:
            high = top << _U(rest.bits - 64) if n else top
            return cls(high if rest.high is None else high | rest.high, rest.low, bits)
        return cls(top >> _U(64 - rest.bits), top << _U(rest.bits) | rest.low, bits)

    @classmethod
    def stacked(cls, parts: list[Keys]) -> Keys:
        high = None if parts[0].high is None else np.concatenate([p.high for p in parts])
        return cls(high, np.concatenate([p.low for p in parts]), parts[0].bits)

    def order(self) -> np.ndarray:
        return np.argsort(self.low, kind="stable") if self.high is None else np.lexsort((self.low, self.high))

    def new(self) -> np.ndarray:
        """Where a number differs from the one before."""
        differs = self.low[1:] != self.low[:-1]
        return np.flatnonzero(np.r_[True, differs if self.high is None else differs | (self.high[1:] != self.high[:-1])][: len(self)])


def packed(keys: Keys, counts: np.ndarray) -> bytes:
    """A counting quotient filter of ascending keys."""
    n, bits = len(keys), keys.bits
    q = min(bits, max(1, n.bit_length() - 1))
    quotient, rest = keys.top(q).astype(np.int64), keys.rest(q)
    unary = np.zeros(n + (1 << q), np.uint8)  # of each quotient: as many ones as it has slots, then a zero
    unary[np.arange(n) + quotient] = 1
    wide = np.zeros((n, 2), "<u8")
    wide[:, 0] = rest.low
    if rest.high is not None:
        wide[:, 1] = rest.high
    body = wide.view(np.uint8)[:, : -(-rest.bits // 8)].tobytes()
    small = np.minimum(counts, 255).astype(np.uint8)
    return np.array([n, q], "<u8").tobytes() + np.packbits(unary).tobytes() + body + small.tobytes() + counts[counts >= 255].astype("<u8").tobytes()


def unpacked(raw: bytes, bits: int) -> tuple[Keys, np.ndarray]:
    """Keys and counts of a filter."""
    n, q = (int(x) for x in np.frombuffer(raw, "<u8", 2))
    slots = n + (1 << q)
    at = 16
    unary = np.unpackbits(np.frombuffer(raw, np.uint8, -(-slots // 8), at), count=slots)
    at += -(-slots // 8)
    quotient = (np.flatnonzero(unary) - np.arange(n)).astype(np.uint64)
    size = -(-(bits - q) // 8)
    wide = np.zeros((n, 16), np.uint8)
    wide[:, :size] = np.frombuffer(raw, np.uint8, n * size, at).reshape(n, size)
    wide = wide.view("<u8")
    at += n * size
    counts = np.frombuffer(raw, np.uint8, n, at).astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw, "<u8", -1, at + n).astype(np.int64)
    rest = Keys(wide[:, 1].copy() if bits - q > 64 else None, wide[:, 0].copy(), bits - q)
    return Keys.joined(quotient, q, rest), counts


def merged(parts: list[tuple[Keys, np.ndarray]]) -> tuple[Keys, np.ndarray]:
    """Ascending keys with their counts summed, from several such lists."""
    keys, counts = Keys.stacked([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = keys.order()
    keys, counts = keys[order], counts[order]
    first = keys.new()
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Filters:
    """The counts of a task by language and length: recent keys loose, the rest as ascending lists."""

    def __init__(self):
        self.held: dict[tuple[str, int], list[tuple[Keys, np.ndarray]]] = {}
        self.size: Counter = Counter()

    def add(self, of: tuple[str, int], keys: Keys, counts: np.ndarray | None = None) -> None:
        self.held.setdefault(of, []).append((keys, np.ones(len(keys), np.int64) if counts is None else counts))
        self.size[of] += len(keys)

    def settle(self) -> int:
        """Merge what was added; the number of distinct keys."""
        for of, parts in self.held.items():
            if len(parts) > 1 or len(parts[0][0]) and self.size[of]:
                self.held[of] = [merged(parts)]
            self.size[of] = 0
        return sum(len(p[0][0]) for p in self.held.values())


# counting


def word_counts(own: DataFrame) -> DataFrame:
    """(lang, word, n): of all words; a null word stands for all words of the language. own: (lang, text)."""

    def rows(held: dict[str, Counter], totals: Counter) -> pa.RecordBatch:
        flat = [(lang, word, n) for lang, c in held.items() for word, n in c.items()] + [(lang, None, n) for lang, n in totals.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in flat], t) for k, t in enumerate((pa.string(), pa.binary(), pa.int64()))], names=["lang", "word", "n"])

    def run(batches):
        held, totals, since = {}, Counter(), 0
        for batch in batches:
            for part in slices(batch, "text"):
                for lang, text in zip(part.column("lang").to_pylist(), texts_of(part, "text"), strict=True):
                    own = held.setdefault(lang, Counter())
                    for words in tokens(text):
                        own.update(words)
                since += part.num_rows + part.nbytes
                if since > 8 << 20:
                    since = 0
                    if sum(map(len, held.values())) > 100_000:
                        yield rows(*_without_marks(held, totals))
                        held, totals = {}, Counter()
        if held:
            yield rows(*_without_marks(held, totals))
        give_back()

    return own.mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _without_marks(held: dict[str, Counter], totals: Counter) -> tuple[dict[str, Counter], Counter]:
    for lang, c in held.items():
        c.pop(b".", None)
        totals[lang] += sum(c.values())
    return held, totals


class Table:
    """Ids of words by language, and what is known of other words; sent to all tasks."""

    def __init__(self, rows, others: np.ndarray | None):
        self.words: dict[str, list[bytes]] = {}
        for lang, word in rows:
            self.words.setdefault(lang, [b""]).append(bytes(word))
        self.langs = {lang: k for k, lang in enumerate(sorted(self.words))}
        self.width = {lang: max(16, len(words).bit_length()) for lang, words in self.words.items()}
        self.others = others
        self._ids: dict[str, dict[bytes, int]] | None = None

    def ids(self, lang: str) -> dict[bytes, int]:
        if self._ids is None:
            self._ids = {lang: {w: k for k, w in enumerate(words)} for lang, words in self.words.items()}
        return self._ids.setdefault(lang, {b"": 0})

    def __getstate__(self):
        return self.__dict__ | {"_ids": None}

    def pair_slots(self, lang: str, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        x = permuted(_U(self.langs.get(lang, 0)) << _U(44) | first << _U(22) | second, 64)
        return x >> _U(64 - SLOT_BITS)


def _numbers(table: Table, lang: str, words: list[bytes], strange: dict[bytes, int]) -> np.ndarray:
    """Ids of words: 0 where no phrase can go on, from ``MOST_IDS`` (by ``strange``) for frequent words without an id."""
    ids = table.ids(lang)
    out = np.fromiter((ids.get(w, -1) for w in words), np.int64, len(words))
    unknown = np.flatnonzero(out < 0)
    if table.others is None:
        out[unknown] = 0
        return out
    for k in unknown.tolist():
        w = words[k]
        slot = crc32(w) & ((1 << SLOT_BITS) - 1)
        frequent = w != b"." and (table.others[slot >> 3] >> (slot & 7)) & 1
        out[k] = strange.setdefault(w, MOST_IDS + len(strange)) if frequent else 0
    return out


def phrase_counts(own: DataFrame, table: Table, lengths: tuple[int, ...], shards: int, pairs: np.ndarray | None = None, least: int = LEAST) -> DataFrame:
    """(lang, length, phrase, n, slot): the phrases of these lengths that occur ``least`` times. pairs: table of bits of pairs."""
    shared = own.sparkSession.sparkContext.broadcast((table, pairs))
    shard_bits = shards.bit_length() - 1

    def emit(filters: Filters, texts: Counter):
        for (lang, length), ((keys, counts),) in filters.held.items():
            shard = keys.top(shard_bits)
            edges = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True]) if len(keys) else np.zeros(1, np.int64)
            at = shard[edges[:-1]].astype(np.int64)
            blobs = [packed(keys[b:e].rest(shard_bits), counts[b:e]) for b, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            k = len(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * k, pa.string()), pa.array([length] * k, pa.int32()), pa.array(at, pa.int64()), pa.array(blobs, pa.binary()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64())], names=_PARTS
            )
        if texts:
            k = len(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in texts], pa.string()), pa.array([x[1] for x in texts], pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array([x[2] for x in texts], pa.binary()), pa.array(texts.values(), pa.int64())],
                names=_PARTS,
            )

    def count(filters: Filters, texts: Counter, lang: str, flat: list[bytes]):
        table, pairs = shared.value
        strange: dict[bytes, int] = {}
        x = _numbers(table, lang, flat, strange)
        odd = bool(strange)
        u = x.astype(np.uint64)
        linked = (x[:-1] > 0) & (x[1:] > 0)
        if pairs is not None:
            plain = np.flatnonzero(linked & (x[:-1] < MOST_IDS) & (x[1:] < MOST_IDS)) if odd else np.flatnonzero(linked)
            linked[plain] = in_table(pairs, table.pair_slots(lang, u[plain], u[plain + 1]))
        valid = linked
        for length in range(2, max(lengths) + 1):
            if length > 2:
                valid = valid[:-1] & linked[length - 2 :]
            if length not in lengths:
                continue
            at = np.flatnonzero(valid)
            if odd and len(at):
                high = (np.stack([x[at + k] for k in range(length)]) >= MOST_IDS).any(axis=0)
                texts.update((lang, length, b" ".join(flat[k : k + length])) for k in at[high].tolist())
                at = at[~high]
            if len(at):
                filters.add((lang, length), Keys.of_words([u[at + k] for k in range(length)], table.width[lang]))

    def run(batches):
        filters, texts, since = Filters(), Counter(), 0
        for batch in batches:
            for part in slices(batch, "text"):
                flats: dict[str, list[bytes]] = {}
                for lang, text in zip(part.column("lang").to_pylist(), texts_of(part, "text"), strict=True):
                    flat, carry = flats.setdefault(lang, []), []
                    for k, words in enumerate(tokens(text)):
                        if k:  # of a long text: the last words before go along, and what lies within them is counted once
                            count(filters, texts, lang, flat)
                            carry = flat[1 - LONGEST :]
                            flat.clear()
                            back, again = Filters(), Counter()
                            if len(carry) > 1:
                                count(back, again, lang, carry)
                            for of, lists in back.held.items():
                                for keys, counts in lists:
                                    filters.add(of, keys, -counts)
                            texts.subtract(again)
                            flat += carry
                        flat += words
                    flat.append(b".")
                    since += len(flat)
                for lang, flat in flats.items():
                    if len(flat) > 1:
                        count(filters, texts, lang, flat)
                if sum(filters.size.values()) > HELD and filters.settle() > HELD or len(texts) > HELD // 16:
                    filters.settle()
                    yield from emit(filters, texts)
                    filters, texts = Filters(), Counter()
        filters.settle()
        yield from emit(filters, texts)
        give_back()

    parts = own.mapInArrow(run, "lang string, length int, shard long, filter binary, phrase binary, n long")

    def merge(batches):
        of, held, size = None, [], 0

        def frequent():
            keys, counts = merged(held)
            lang, length, shard = of
            keep = counts >= least
            keys, counts = keys[keep], counts[keep]
            ids = Keys.joined(np.full(len(keys), shard, np.uint64), shard_bits, keys).words(length)
            table = shared.value[0]
            words = table.words[lang]
            phrases = [b" ".join(map(words.__getitem__, p)) for p in zip(*(i.tolist() for i in ids), strict=True)]
            slots = table.pair_slots(lang, ids[0], ids[1]).astype(np.int64) if length == 2 else np.zeros(len(keys), np.int64)
            k = len(keys)
            return pa.RecordBatch.from_arrays([pa.array([lang] * k, pa.string()), pa.array([length] * k, pa.int32()), pa.array(phrases, pa.binary()), pa.array(counts), pa.array(slots)], names=["lang", "length", "phrase", "n", "slot"])

        for batch in batches:
            for lang, length, shard, raw in zip(*(batch.column(c).to_pylist() for c in ("lang", "length", "shard", "filter")), strict=True):
                if (lang, length, shard) != of:
                    if held:
                        yield frequent()
                    of, held, size = (lang, length, shard), [], 0
                held.append(unpacked(raw, shared.value[0].width[lang] * length - shard_bits))
                size += len(held[-1][0])
                if size > 2 * len(held[0][0]) + (1 << 20):  # keys that agree are merged before more come
                    held = [merged(held)]
                    size = len(held[0][0])
        if held:
            yield frequent()
        give_back()

    filters = parts.where("filter is not null").select("lang", "length", "shard", "filter")
    if table.others is not None:
        parts = written(parts, name="filters")
        filters = parts.where("filter is not null").select("lang", "length", "shard", "filter")
    found = filters.repartition("lang", "length", "shard").sortWithinPartitions("lang", "length", "shard")
    found = found.mapInArrow(merge, "lang string, length int, phrase binary, n long, slot long")
    if table.others is not None:
        strange = parts.where("phrase is not null").groupBy("lang", "length", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        found = found.unionByName(strange.withColumn("slot", F.lit(None).cast("long")))
    return found


_PARTS = ["lang", "length", "shard", "filter", "phrase", "n"]


def frequent_phrases(docs: DataFrame, *, lang_col="lang", text_col="text", least: int = LEAST, table_words: int = TABLE_WORDS) -> tuple[DataFrame, DataFrame]:
    """(lang, length, phrase, n) of all phrases of one to four words that occur ``least`` times, and (lang, n) of all words."""
    own = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    words = written(word_counts(own).where((F.col("n") >= least) | F.col("word").isNull()), name="words")
    totals, words = words.where("word is null").select("lang", "n"), words.where("word is not null")
    facts = totals.agg(F.count("*").alias("langs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    each = min(MOST_IDS - 1, table_words // max(facts.langs, 1))
    ranked = written(top_rows(words, "lang", [F.desc("n"), F.asc("word")], each), name="ids") if each else words.limit(0).withColumn("rank", F.lit(0))
    others = words.join(ranked.select("lang", "word"), ["lang", "word"], "left_anti").select(F.expr(f"crc32(word) & {(1 << SLOT_BITS) - 1}").alias("slot"))
    table = Table(((r.lang, r.word) for r in ranked.orderBy("lang", "rank").select("lang", "word").toLocalIterator()), None if others.isEmpty() else bit_table(others, "slot"))
    shards = 1
    while shards * SHARD < facts.n and shards < 1 << 30:
        shards *= 2
    pairs = written(phrase_counts(own, table, (2,), shards, None, least), name="pairs")
    longer = phrase_counts(own, table, tuple(range(3, LONGEST + 1)), shards, bit_table(pairs, "slot"), least)
    longer = written(longer, name="longer")
    single = words.select("lang", F.lit(1).alias("length"), F.col("word").alias("phrase"), "n")
    found = single.unionByName(pairs.drop("slot")).unionByName(longer.drop("slot"))
    return found.withColumn("phrase", F.col("phrase").cast("string")), totals


def collocations(docs: DataFrame, *, lang_col="lang", text_col="text", least: int = LEAST, cover: int = COVER, most: int = FIRST, table_words: int = TABLE_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two to four words."""
    found, totals = frequent_phrases(docs, lang_col=lang_col, text_col=text_col, least=least, table_words=table_words)
    candidates = found.where("length > 1").withColumn("words", F.split("phrase", " "))

    def part(begin, size) -> F.Column:
        return F.array_join(F.slice("words", begin, size), " ")

    # parts of at least two words that stand inside longer phrases, with the most frequent of these
    places = F.expr("flatten(transform(sequence(2, length - 1), s -> transform(sequence(1, length - s + 1), b -> struct(b as b, s as s))))")
    inside = candidates.where("length > 2").select("lang", "words", "n", F.explode(places).alias("p")).select("lang", part(F.col("p.b"), F.col("p.s")).alias("phrase"), "n")
    inside = inside.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = candidates.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | ~F.expr(f"cast(100 as decimal(20)) * longer >= cast({cover} as decimal(20)) * n"))
    cuts = kept.select("lang", "phrase", F.col("n").alias("a"), "words", "length", F.explode(F.expr("sequence(1, length - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("length") - F.col("k")).alias("right"))
    f = found.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    cuts = cuts.join(f.withColumnsRenamed({"part": "left", "f": "l"}), ["lang", "left"]).join(f.withColumnsRenamed({"part": "right", "f": "r"}), ["lang", "right"])
    score = F.expr("cast((cast(a as decimal(20, 0)) * 2000000) div (cast(l as decimal(20, 0)) + r) as long)")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    best = top_rows(best, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], most)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The same rows in DuckDB.
OP13_SQL = rf"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
g AS (SELECT lang, m, list_slice(w, k, k + m - 1) AS g FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS k FROM w), (VALUES (1), (2), (3), (4)) AS v(m) WHERE k + m - 1 <= len(w)),
f AS (SELECT lang, m, g, count(*)::BIGINT AS c FROM g GROUP BY ALL HAVING count(*) >= {LEAST}),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
x AS (SELECT f.lang, list_slice(f.g, b, b + s - 1) AS g, max(f.c) AS longer FROM f, (VALUES (2), (3)) AS v(s), (VALUES (1), (2), (3)) AS u(b) WHERE s < f.m AND b + s - 1 <= f.m GROUP BY ALL),
c AS (SELECT f.* FROM f LEFT JOIN x USING (lang, g) WHERE f.m > 1 AND (longer IS NULL OR 100 * longer < {COVER} * f.c)),
k AS (SELECT c.lang, c.g, c.c AS a, k, p.c AS l, q.c AS r, ((2000000 * c.c::HUGEINT) // (p.c + q.c))::BIGINT AS score FROM c, (VALUES (1), (2), (3)) AS v(k), f p, f q
 WHERE k < c.m AND p.lang = c.lang AND p.g = list_slice(c.g, 1, k) AND q.lang = c.lang AND q.g = list_slice(c.g, k + 1, c.m)),
b AS (SELECT lang, g, a, l, r, score FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS z FROM k) WHERE z = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM b) JOIN n USING (lang) WHERE rank <= {FIRST}"""


def op13_phrases(spark, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))
