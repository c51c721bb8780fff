"""Language-model scoring: a log-bilinear neural model, trained with noise-contrastive estimation in numpy.

Counts cover all training texts: words are counted in tasks and summed in Spark. The model has ``CLASSES`` classes: the most
frequent words, the end of a text, and ``OTHERS`` classes for all other words by a hash of how they begin. A context of two classes gives a predicted vector (each
embedding times its position's matrix), whose products with the output vectors plus biases are the scores of all classes.

Training: a start from at most about ``WARM_ROWS`` texts in one task, so that all tasks begin from the same vectors; then
every task goes once over all its own training texts, and the tasks' parameters are averaged by their numbers of tokens.

Scoring: matrix products of all classes give score tables for each position, and the logarithm of each context's
normaliser (``CLASSES`` squared contexts, in blocks, in tasks). A token's log-probability is then read from tables. A word
without a class of its own has its hash class's probability times its share of that class, (c + 0.1) / (n + 0.1 (v + 1))
with the class's tokens n and words v, so the probabilities of all words sum to one.

Word counts that tasks hold as a table are the most frequent ones, as many as have a count of at least a threshold that
keeps them within ``TABLE_WORDS``; occurrences of all other words are joined with their counts by word, in a shuffle. Words that are
rare in training may be frequent in the texts that are scored: those are told by their numbers first and sent to all tasks.

The model depends on how rows are dealt to tasks, as each task learns in the order of its rows and the tasks are averaged; the
base columns do not. Rows with a null id are scored and not learned from; their ``held_out`` is null.

Null and empty texts have one token, the end. With nothing to learn from, every count is 0.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain, repeat
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.llm._common import fold, give_back, hashed_share, join_counts, map_slices, read, sample_share, slices, texts_of, written

CLASSES = 1024
OTHERS = 256
END = OTHERS
TABLE_WORDS = 250_000
WARM_ROWS = 2500
COUNTED_WORDS = 400_000
HELD_OUT_FOLDS = 10


def tokens(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "replace").lower().split()


def other_class(words: list[bytes]) -> np.ndarray:
    """The class of words without one of their own."""
    return np.fromiter((crc32(w[:3]) for w in words), np.uint32, len(words)).astype(np.int64) % OTHERS


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all rows; each task sums up what fits its bounded table first."""

    def run(batches):
        seen: Counter = Counter()

        def out():
            rows = pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            for k in range(0, rows.num_rows, 50_000):
                yield rows.slice(k, 50_000)

        for batch in batches:
            for part in slices(batch, "text"):
                seen.update(chain.from_iterable(map(tokens, texts_of(part, "text"))))
                if len(seen) > COUNTED_WORDS:
                    yield from out()
        yield from out()

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class LogBilinear:
    """Parameters and training of the model."""

    def __init__(self, counts: np.ndarray, dim: int = 16, noise: int = 32, rate: float = 0.2, seed: int = 1):
        rng = np.random.default_rng(seed)
        m = len(counts)
        self.unigram = (counts + 0.1) / (counts + 0.1).sum()
        self.dim, self.noise, self.rate, self.m = dim, noise, rate, m
        self.shapes = [(m, dim), (m, dim), (dim, dim), (dim, dim), (m,)]
        embed, out = (rng.normal(0, 0.1, (m, dim)).astype(np.float32) for _ in range(2))
        self.params = [embed, out, np.eye(dim, dtype=np.float32), 0.5 * np.eye(dim, dtype=np.float32), np.log(self.unigram).astype(np.float32)]
        self.squares = [np.full(s, 0.1, np.float32) for s in self.shapes]
        self.rng = rng

    def packed(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.params])

    def unpack(self, flat: np.ndarray) -> None:
        at = 0
        for k, s in enumerate(self.shapes):
            n = int(np.prod(s))
            self.params[k] = flat[at : at + n].reshape(s).astype(np.float32)
            at += n

    def _sum_rows(self, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(at, weights=rows[:, k], minlength=self.m) for k in range(rows.shape[1])], 1).astype(np.float32)

    def step(self, near: np.ndarray, far: np.ndarray, word: np.ndarray) -> None:
        """One step of noise-contrastive estimation; the batch shares its noise words."""
        embed, out, c1, c2, bias = self.params
        n = len(word)
        drawn = np.searchsorted(self.cumulative, self.rng.random(self.noise))
        x1, x2 = embed[near], embed[far]
        hat = x1 @ c1 + x2 @ c2
        logk = np.log(self.noise * self.unigram).astype(np.float32)
        own = (hat * out[word]).sum(1) + bias[word] - logk[word]
        other = hat @ out[drawn].T + (bias - logk)[drawn]
        up = 1 / (1 + np.exp(np.clip(own, -30, 30)))  # 1 - sigmoid
        down = -1 / (1 + np.exp(-np.clip(other, -30, 30)))
        d_hat = up[:, None] * out[word] + down @ out[drawn]
        d_out = self._sum_rows(word, up[:, None] * hat)
        np.add.at(d_out, drawn, down.T @ hat)
        d_bias = np.bincount(word, weights=up, minlength=self.m) + np.bincount(drawn, weights=down.sum(0), minlength=self.m)
        d_embed = self._sum_rows(near, d_hat @ c1.T) + self._sum_rows(far, d_hat @ c2.T)
        for p, q, g in zip(self.params, self.squares, (d_embed, d_out, x1.T @ d_hat, x2.T @ d_hat, d_bias.astype(np.float32)), strict=True):
            g /= n
            q += g * g * 100
            p += self.rate * g * 10 / np.sqrt(q)

    def train(self, word: np.ndarray, near: np.ndarray, far: np.ndarray, batch: int = 8192) -> None:
        self.cumulative = np.cumsum(self.unigram)
        self.cumulative[-1] = 1
        for k in range(0, len(word), batch):
            self.step(near[k : k + batch], far[k : k + batch], word[k : k + batch])


def contexts(classes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class before each token and the one before that; texts end in END, and begin as if after two ENDs."""
    near, far = np.roll(classes, 1), np.roll(classes, 2)
    near[begins] = END
    far[begins] = END
    inner = begins[begins + 1 < len(classes)] + 1
    far[inner] = END
    return near, far


def _classes_of(texts: list[str], index: dict[bytes, int], by_index: np.ndarray):
    """Words of all texts, their places in the table (-1: none), classes with ends put in, each text's begin and length.

    by_index: the class of each place, negative where the hash gives it; its last entry is that of place -1.
    """
    words = [tokens(t) for t in texts]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    flat = list(chain.from_iterable(words))
    place = np.fromiter(map(index.get, flat, repeat(-1)), np.int64, len(flat))
    ends = np.cumsum(lengths + 1) - 1
    own = by_index[place]
    loose = np.flatnonzero(own < 0)
    own[loose] = other_class([flat[k] for k in loose.tolist()])
    classes = np.full(len(flat) + len(words), END, np.int64)
    inner = np.ones(len(classes), bool)
    inner[ends] = False
    classes[inner] = own
    return flat, place, classes, ends - lengths, lengths


_HELD: dict[int, dict] = {}


def _held(key: int, make):
    """One table at a time for a Python worker."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def fit(train: DataFrame, top: list[bytes], counts: np.ndarray, text_col: str = "text") -> LogBilinear:
    """Start in one task on a bounded sample, then one pass of all tasks over all rows, averaged."""
    model = LogBilinear(counts)
    index = {w: k for k, w in enumerate(top)}
    own = train.select(F.col("doc_id"), F.col(text_col).alias("text"))
    sc = train.sparkSession.sparkContext
    classes = np.append(END + 1 + np.arange(len(top)), -1)
    start = sc.broadcast((index, counts, classes))

    def learn(model, texts, times=1):
        index, _, classes = start.value
        _, _, made, begins, _ = _classes_of(texts, index, classes)
        near, far = contexts(made, begins)
        for _ in range(times):
            model.train(made, near, far)
        return len(made)

    def warm(rows: pd.DataFrame) -> pd.DataFrame:
        model = LogBilinear(start.value[1])
        learn(model, rows.sort_values("doc_id")["text"].fillna("").tolist(), 5)
        return pd.DataFrame({"params": [model.packed().astype("<f4").tobytes()]})

    sample = own.where(hashed_share("doc_id", sample_share(own.count(), WARM_ROWS)))
    first = sample.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(warm, "params binary").collect()
    if not first:
        return model
    begun = sc.broadcast(first[0].params)
    blocks = 16

    def go(batches):
        model, seen = LogBilinear(start.value[1]), 0
        model.unpack(np.frombuffer(begun.value, "<f4"))
        model.squares = [q + 5 for q in model.squares]
        for batch in batches:
            for part in slices(batch, "text"):
                seen += learn(model, texts_of(part, "text"))
        give_back()
        if seen:
            cut = np.array_split(model.packed().astype("<f4"), blocks)
            yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array([seen] * blocks, pa.int64()), pa.array([c.tobytes() for c in cut], pa.binary())], names=["block", "seen", "params"])

    def mean(rows: pd.DataFrame) -> pd.DataFrame:
        all_ = np.stack([np.frombuffer(p, "<f4") for p in rows.params]).astype(np.float64)
        w = rows.seen.to_numpy(float)
        return pd.DataFrame({"block": [rows.block.iloc[0]], "seen": [int(w.sum())], "params": [((all_ * w[:, None]).sum(0) / w.sum()).astype("<f4").tobytes()]})

    schema = "block int, seen long, params binary"
    # by partition ranges first, then all: no task averages more than its range
    parts = own.select("text").mapInArrow(go, schema).withColumn("part", (F.spark_partition_id() / 256).cast("int"))
    partial = parts.groupBy("block", "part").applyInPandas(lambda rows: mean(rows[["block", "seen", "params"]]), schema)
    done = partial.groupBy("block").applyInPandas(mean, schema).collect()
    model.unpack(np.concatenate([np.frombuffer(r.params, "<f4") for r in sorted(done, key=lambda r: r.block)]))
    return model


def normalisers(spark, model: LogBilinear) -> np.ndarray:
    """Logarithm of the normaliser of each context (class before, class before that), by matrix products in blocks."""
    embed, out, c1, c2, bias = model.params
    shared = spark.sparkContext.broadcast((embed @ c1, embed @ c2, out, bias))

    def run(batches):
        one, two, out, bias = shared.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = []
            for k in ids:
                logits = (one[k] + two) @ out.T + bias
                top = logits.max(1)
                rows.append((top + np.log(np.exp(logits - top[:, None]).sum(1))).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.binary())], names=["id", "row"])

    rows = spark.range(0, model.m, 1, 12).mapInArrow(run, "id long, row binary").collect()
    return np.stack([np.frombuffer(r.row, "<f4") for r in sorted(rows, key=lambda r: r.id)])


def score_documents(docs: DataFrame, *, id_col="doc_id", text_col="text", held_out_folds: int = HELD_OUT_FOLDS, table_words: int = TABLE_WORDS, classes: int = CLASSES) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score (unigram) and score (model), both log10."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    train = own.where(fold("doc_id", held_out_folds) != 0)
    counts = written(count_words(train), name="word-counts")
    n_docs = train.count()
    sizes = counts.groupBy(F.floor(F.log2("n")).alias("k")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect()  # at most 64 rows
    total, distinct = sum(r.n for r in sizes) + n_docs, sum(r.words for r in sizes) + (n_docs > 0)
    least, held = 1 << 62, 0
    for r in sorted(sizes, key=lambda r: -r.k):
        held += r.words
        if held > table_words:
            break
        least = 1 << int(r.k)
    frequent = counts.where(F.col("n") >= least).toPandas() if sizes else pd.DataFrame({"word": [], "n": []})  # at most table_words rows
    frequent = frequent.assign(word=[bytes(w) for w in frequent.word]).sort_values(["n", "word"], ascending=[False, True], ignore_index=True)
    size = classes - OTHERS - 1
    top = frequent[:size]
    if len(frequent) < size:  # a small table: the classes come from the counts themselves
        top = counts.orderBy(F.desc("n"), "word").limit(size).toPandas()
        top = top.assign(word=[bytes(w) for w in top.word])
    hashed = counts.groupBy((F.crc32(F.substring("word", 1, 3)) % OTHERS).cast("int").alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    others = np.zeros((OTHERS, 2))
    for r in hashed:
        others[r.k] = r.n, r.v
    for k, n in zip(other_class(list(top.word)), top.n, strict=True):
        others[k] -= n, 1
    class_counts = np.array([*others[:, 0], n_docs, *top.n], float)
    model = fit(train, list(top.word), class_counts)
    embed, out, c1, c2, bias = model.params
    log10e = np.log10(np.e)
    one = ((embed @ c1 @ out.T + bias) * log10e).astype(np.float32)
    two = ((embed @ c2 @ out.T) * log10e).astype(np.float32)
    norm = (normalisers(spark, model) * log10e).astype(np.float32)
    place_class = np.full(len(frequent) + 1, -1, np.int64)
    own_class = {w: END + 1 + k for k, w in enumerate(top.word)}
    place_class[:-1] = [own_class.get(w, -1) for w in frequent.word[: len(top)]] + [-1] * max(0, len(frequent) - len(top))
    other_logs = np.append(np.log10(others[:, 0] + 0.1 * (others[:, 1] + 1)), np.zeros(1 + len(top))).astype(np.float64)
    logs = np.append(np.log10(frequent.n.to_numpy(float) + 0.1), 0)
    shared = spark.sparkContext.broadcast((list(frequent.word), place_class, logs, one, two, norm, other_logs))
    key = hash((id(shared), shared.id if hasattr(shared, "id") else 0, np.random.default_rng().integers(1 << 60)))
    base_log, end_log = np.log10(total + 0.1 * (distinct + 1)), np.log10(n_docs + 0.1)
    kind = own.schema["doc_id"].dataType.simpleString()
    fields = [("n_tokens", pa.int64()), ("n_known", pa.int64()), ("all_logs", pa.float64()), ("other_logs", pa.float64()), ("model_logs", pa.float64())]

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        words, place_class, logs, one, two, norm, other_logs = shared.value
        index = _held(key, lambda: {w: k for k, w in enumerate(words)})
        flat, place, made, begins, lengths = _classes_of(texts_of(part, "text"), index, place_class)
        near, far = contexts(made, begins)
        token = one[near, made] + two[far, made] - norm[near, far] - other_logs[made]
        text = np.repeat(np.arange(len(lengths)), lengths)
        n = len(lengths)
        known, other = place >= 0, place_class[place] < 0
        sums = lambda w: np.bincount(text, weights=w, minlength=n)
        model_logs = np.add.reduceat(token.astype(np.float64), begins) if n else np.zeros(0)
        values = [lengths + 1, sums(known) + (n_docs > 0), sums(logs[place] * known) + end_log, sums(logs[place] * (known & other)), model_logs]
        rare = np.flatnonzero(~known)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(text[rare], minlength=n))]).astype(np.int32)
        rest = pa.ListArray.from_arrays(pa.array(offsets), pa.array([flat[k] for k in rare.tolist()], pa.binary()))
        columns = [pa.array(np.asarray(v).astype(t.to_pandas_dtype()), t) for v, (_, t) in zip(values, fields, strict=True)]
        return pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), *columns, rest], names=["doc_id", "row", *(f for f, _ in fields), "rest"])

    numbered = own.withColumn("row", F.monotonically_increasing_id())
    schema = f"doc_id {kind}, row long, n_tokens long, n_known long, all_logs double, other_logs double, model_logs double, rest array<binary>"
    scored = written(map_slices(numbered, "text", schema, run), name="scored")
    rare = scored.select("row", F.explode("rest").alias("word"))
    met = written(rare.groupBy("word").agg(F.count("*").alias("met")).join(counts.where(F.col("n") < least), "word", "left"), name="rare-words")
    rare = join_counts(rare, met, "word", "met", met.agg(F.sum("met")).first()[0] or 0)
    sums = rare.groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("logs"), F.count("n").alias("known"))
    logs = F.coalesce("logs", F.lit(0.0))
    return scored.drop("rest").join(sums, "row", "left").select(
        F.col("doc_id").alias(id_col), (fold("doc_id", held_out_folds) == 0).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("all_logs") + logs - F.col("n_tokens") * float(base_log)).alias("base_score"),
        (F.col("model_logs") + F.col("other_logs") + logs).alias("score"),
    )


def op10_log_bilinear(spark, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"))
