"""Language identification: scripts narrow the candidates, then Viterbi over per-word scores with a switching penalty.

Model: for each learned language, log-probabilities of hashed letter trigrams within words (with word ends), and the
share of its letters in each script (code-point ranges). A word's candidates are the languages in which its script has
at least ``SCRIPT_SHARE`` of the letters (all, if there are none). Viterbi runs over a text's words with a penalty for
each change of language, so a mixed text falls into spans; the text's language is that with the most letters, and its
score is the share of letters in it.

Trigrams are counted over at most about ``FIT_ROWS`` rows for the fit, as many of each language (all, where it has fewer),
chosen by a hash of the id, so a rare language is learned too; the counts are summed in Spark, and the model has ``BUCKETS``
rows by language. Null texts and texts without a letter are ``und`` with score 0; combining marks belong to words but are no
letters.
Ties go to the language first in order. With nothing to learn from, every text is ``und``.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.llm._common import fold, map_slices, read, texts_of

BUCKETS = 1 << 15
FIT_ROWS = 20_000
SMOOTH = 0.5
SWITCH_PENALTY = 6.0
SCRIPT_SHARE = 0.01
HELD_OUT_FOLDS = 5

#: First and last code point of letter ranges, by script.
SCRIPTS = (
    ("latin", ((0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A))),
    ("greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F))),
    ("armenian", ((0x530, 0x58F),)),
    ("hebrew", ((0x590, 0x5FF),)),
    ("arabic", ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))),
    ("devanagari", ((0x900, 0x97F),)),
    ("thai", ((0xE00, 0xE7F),)),
    ("hangul", ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF))),
    ("kana", ((0x3040, 0x30FF), (0x31F0, 0x31FF))),
    ("han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))),
)
OTHER = len(SCRIPTS)

_TABLES: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    """By code point: the lower-case code point of a letter or combining mark (0 for others), its script, and whether it is a letter."""
    if not _TABLES:
        lower, alpha = np.zeros(0x110000, np.uint32), np.zeros(0x110000, bool)
        for point in range(0x110000):
            char = chr(point)
            if char.isalpha() or unicodedata.category(char) == "Mn":
                low = char.lower()
                lower[point] = ord(low) if len(low) == 1 else point
                alpha[point] = char.isalpha()
        script = np.full(0x110000, OTHER, np.uint8)
        for k, (_, ranges) in enumerate(SCRIPTS):
            for a, b in ranges:
                script[a : b + 1] = k
        _TABLES[:] = [lower, script, alpha]
    return _TABLES


class Words:
    """The letter words of several texts in arrays: trigram buckets of all words, and where words and texts begin."""

    def __init__(self, texts: list[str]):
        lower, scripts, alpha = _tables()
        joined = "\n".join(texts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
        low = lower[points]
        letter = low > 0
        before = np.zeros_like(letter)
        before[1:] = letter[:-1]
        self.begin = np.flatnonzero(letter & ~before)  # of each word, in characters
        self.letters = np.flatnonzero(~letter & before) - self.begin
        sums = np.concatenate([[0], np.cumsum(alpha[points])])
        self.alpha = sums[self.begin + self.letters] - sums[self.begin]  # letters without combining marks
        text_ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        cuts = np.searchsorted(self.begin, text_ends)
        self.text_words = np.diff(cuts, prepend=0)
        self.text_begin = np.concatenate([[0], text_ends[:-1]])
        self.script = scripts[points[self.begin]]
        # trigrams at the places of each word and at the place behind it; a place outside the word counts as a word end
        a = np.zeros(len(low) + 2, np.uint32)
        a[1:-1] = low
        hashed = (a[:-2] * np.uint32(0x9E3779B1)) ^ (a[1:-1] * np.uint32(0x85EBCA77)) ^ (a[2:] * np.uint32(0xC2B2AE3D))
        hashed *= np.uint32(0x27D4EB2F)
        hashed >>= np.uint32(17)
        near = letter.copy()
        near[1:] |= letter[:-1]
        self.gram = hashed[near].astype(np.int32)
        grams = self.letters + 1
        self.gram_at = np.cumsum(grams) - grams


def count_grams(part: list[str], langs: list[str]) -> list[tuple[str, int, int]]:
    """(language, bucket, count) of a slice; buckets from BUCKETS on count letters by script."""
    found = []
    for lang in sorted(set(langs)):
        own = Words([t for t, x in zip(part, langs, strict=True) if x == lang])
        if not len(own.begin):
            continue
        for base, counts in ((0, np.bincount(own.gram)), (BUCKETS, np.bincount(own.script, weights=own.alpha).astype(np.int64))):
            at = np.flatnonzero(counts)
            found.append((lang, at + base, counts[at]))
    return found


def fit(docs: DataFrame, *, id_col="doc_id", text_col="text", lang_col="lang", rows: int = FIT_ROWS) -> DataFrame:
    """Counts (lang, bucket, n) over a bounded sample of the rows with a language."""
    own = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sizes = own.groupBy("lang").agg(F.count("*").alias("size"))
    share = rows / F.lit(max(1, sizes.count())) / F.col("size")
    chosen = own.join(F.broadcast(sizes), "lang").where(F.pmod(F.xxhash64(F.lit(17), "id"), F.lit(1 << 30)) < share * (1 << 30))  # a row for each language

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        found = count_grams(texts_of(part, "text"), part.column("lang").to_pylist())
        langs = [x for x, at, _ in found for _ in range(len(at))]
        join = lambda k: np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(join(1).astype(np.int32)), pa.array(join(2))], names=["lang", "bucket", "n"])

    counted = map_slices(chosen.select("text", "lang"), "text", "lang string, bucket int, n long", run, limit=1 << 23)
    return counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Log-probabilities by bucket and language, and the languages that each script allows."""

    def __init__(self, langs: list[str], lang: np.ndarray, bucket: np.ndarray, n: np.ndarray):
        if len(langs) > 30_000:
            raise ValueError(f"{len(langs)} languages do not fit the model")
        self.langs = langs
        counts = np.zeros((BUCKETS, len(langs)))
        letters = np.zeros((OTHER + 1, len(langs)))
        gram = bucket < BUCKETS
        counts[bucket[gram], lang[gram]] = n[gram]
        letters[bucket[~gram] - BUCKETS, lang[~gram]] = n[~gram]
        self.log = np.log((counts + SMOOTH) / (counts.sum(0) + SMOOTH * BUCKETS)).astype(np.float32)
        allowed = letters >= SCRIPT_SHARE * np.maximum(letters.sum(0), 1)
        allowed[~allowed.any(1)] = True
        self.barred = np.where(allowed, 0, -1e4).astype(np.float32)

    def label(self, texts: list[str], penalty: float = SWITCH_PENALTY) -> tuple[Words, np.ndarray]:
        """The words of the texts and the language of each word on the best path."""
        words = Words(texts)
        if not len(words.begin):
            return words, np.zeros(0, np.int64)
        scores = np.add.reduceat(self.log[words.gram], words.gram_at, axis=0) + self.barred[words.script]
        # all texts side by side, the longest first
        order = np.argsort(-words.text_words, kind="stable")
        n = words.text_words[order]
        first = (np.cumsum(words.text_words) - words.text_words)[order]
        live = int(np.count_nonzero(n))
        best = scores[first[:live]]
        back = np.zeros(scores.shape, np.int16)  # by word and language: the language of the word before
        stay = np.arange(len(self.langs), dtype=np.int16)
        at_end = np.zeros(len(order), np.int64)
        for k in range(1, int(n[0])):
            while n[live - 1] <= k:
                live -= 1
                at_end[live] = best[live].argmax()
            own = best[:live]
            top = own.argmax(1)
            switched = own[np.arange(live), top] - penalty
            change = switched[:, None] > own
            at = first[:live] + k
            back[at] = np.where(change, top[:, None], stay)
            best = np.where(change, switched[:, None], own) + scores[at]
        for k in range(live):
            at_end[k] = best[k].argmax()
        path = np.zeros(len(words.begin), np.int64)
        live = int(np.count_nonzero(n))
        now = at_end[:live]
        # walk back: each text from its own last word
        for k in range(int(n[0]) - 1, -1, -1):
            on = int(np.searchsorted(-n[:live], -k, side="left"))  # texts with more than k words
            at = first[:on] + k
            path[at] = now[:on]
            now[:on] = back[at, now[:on]]
        return words, path


def model_of(counts: DataFrame) -> Model:
    """The counts have BUCKETS rows for each language at most; languages are as many as ``lang`` has values."""
    found = counts.toPandas()
    langs = sorted(found.lang.unique())
    return Model(langs, np.searchsorted(langs, found.lang.to_numpy(dtype=object).astype(str)) if langs else np.zeros(0, int), found.bucket.to_numpy(int), found.n.to_numpy(float))


def identify(docs: DataFrame, counts: DataFrame, *, id_col="doc_id", text_col="text", penalty: float = SWITCH_PENALTY, spans: bool = False) -> DataFrame:
    """Per row: the id, ``lang_pred``, ``score`` and, if asked for, ``spans`` (first character, end, language)."""
    model = model_of(counts)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    span_type = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        texts, model = texts_of(part, "text"), shared.value
        m = len(model.langs)
        pred, score, found = ["und"] * len(texts), np.zeros(len(texts)), [[] for _ in texts]
        if m:
            words, path = model.label(texts, penalty)
            text = np.repeat(np.arange(len(texts)), words.text_words)
            votes = np.bincount(text * m + path, weights=words.alpha, minlength=len(texts) * m).reshape(-1, m)
            top, total = votes.argmax(1), votes.sum(1)
            score = np.where(total > 0, votes.max(1) / np.maximum(total, 1), 0)
            pred = [model.langs[k] if n else "und" for k, n in zip(top.tolist(), total.tolist(), strict=True)]
            if spans and len(path):
                cut = np.flatnonzero(np.concatenate([[True], (path[1:] != path[:-1]) | (text[1:] != text[:-1])]))
                last = np.append(cut[1:], len(path)) - 1
                shift = words.text_begin[text[cut]]
                for t, b, e, k in zip(text[cut], words.begin[cut] - shift, words.begin[last] + words.letters[last] - shift, path[cut], strict=True):
                    found[t].append({"begin": int(b), "end": int(e), "lang": model.langs[k]})
        columns = [part.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), *([pa.array(found, span_type)] if spans else [])]
        return pa.RecordBatch.from_arrays(columns, names=[id_col, "lang_pred", "score", *(["spans"] if spans else [])])

    return map_slices(own, "text", f"`{id_col}` {kind}, lang_pred string, score double" + ", spans array<struct<begin:int,end:int,lang:string>>" * spans, run)


def op4_language(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    counts = fit(docs.where(fold("doc_id", HELD_OUT_FOLDS) != 0))
    return identify(docs, counts).select("doc_id", (fold("doc_id", HELD_OUT_FOLDS) == 0).alias("held_out"), "lang_pred", "score")
