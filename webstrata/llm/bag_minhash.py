"""MinHash near-dedup by BagMinHash: weighted-Jaccard signatures of word-shingle multisets, bands, exact check, components.

Signature. The weight axis of each shingle is cut into levels [0,1), [1,2), [2,4), [4,8), ... An independent Poisson process
with rate (level width x components) lives on each level; its points come in order of time, each with a component and a
weight coordinate found by halving the level again and again. A point counts if its coordinate lies below the shingle's
count. A component's value is the point with the least time: for two multisets these agree with the probability of
their weighted Jaccard similarity. Only points up to a time limit are made; where a component stays empty, the limit is
raised and the rest made, so the result does not depend on the limit. Work is linear in distinct shingles, not in counts.

Links. Documents with equal shingle multisets are one text. Texts that agree in a band of the signature are candidates.
Candidates are never all paired: in each bucket every text is first compared with one central text (that with the
largest buckets) of those it meets, the one with the most similar signature; then texts outside a bucket's largest
component are compared with all its texts in other components, until every pair in every bucket that may still join two
components (signatures agree in 3.5 standard deviations less than the threshold) has been compared. A comparison is exact:
the overlap of the two multisets, at least ``THRESHOLD``. Components get the smallest document id as class id.

Words are runs of letters, digits and non-ASCII characters, in lower case; a shingle has five words, a shorter text one
shingle of all its words. Texts without words (null, empty) are each a class of their own. Repeated ids count as one document
with several texts, whose classes are joined; each row with a null id is a class of its own, with a null class id, and kept. Ids may be of any type that has an order. Of
texts that could be central equally well, that with the smallest id is.
"""

from __future__ import annotations

from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.llm._common import Held, ascii_words, join_counts, map_slices, read, texts_of, whole_groups, written

SHINGLE = 5
THRESHOLD = 0.8
COMPONENTS = 128
ROWS = 4
BANDS = COMPONENTS // ROWS
#: Rows of a bucket that one task compares at a time; larger buckets are dealt to several tasks.
BLOCK = 4096
#: Ids that are sent to all tasks to pick out rows; more are joined by shuffle.
FEW_IDS = 300_000

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64."""
    x = (x + _U(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1]."""
    return ((x >> _U(11)).astype(np.float64) + 1) * 2.0**-53


def shingles(texts: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles of all texts, and the text of each."""
    words = [ascii_words(t.lower()) for t in texts]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    flat = list(chain.from_iterable(words))
    held = _WORD_HASH
    held.room()
    new = set(flat) - held.keys()
    held.update((w, int.from_bytes(blake2b(w, digest_size=8).digest(), "little")) for w in new)
    held.bytes += sum(map(len, new))
    h = np.fromiter(map(held.__getitem__, flat), np.uint64, len(flat))
    owner = np.repeat(np.arange(len(texts)), lengths)
    ends = np.cumsum(lengths)
    made, owners = [], []
    if (n := len(flat) - size + 1) > 0:
        acc = np.zeros(n, np.uint64)
        for k in range(size):
            acc = mix(acc ^ h[k : k + n])
        inside = owner[:n] == owner[size - 1 :]
        made.append(acc[inside])
        owners.append(owner[:n][inside])
    for t in np.flatnonzero((lengths > 0) & (lengths < size)):
        acc = np.zeros(1, np.uint64)
        for x in h[ends[t] - lengths[t] : ends[t]]:
            acc = mix(acc ^ x)
        made.append(acc + _U(lengths[t]))
        owners.append(np.array([t]))
    if not made:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    made, owners = np.concatenate(made), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return made[order], owners[order]


#: Hashes of words; about fifteen times as much memory as bytes of words.
_WORD_HASH = Held(1 << 20)


def weigh(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) with counts: shingle hashes, texts, counts; ordered by text, then hash."""
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    return h[at], o[at], np.diff(np.append(at, len(h)))


def signatures(h: np.ndarray, owner: np.ndarray, count: np.ndarray, texts: int, m: int = COMPONENTS) -> np.ndarray:
    """BagMinHash of each text: an array (texts, m) of the winning points' hashes."""
    best = np.full(texts * m, np.inf)
    value = np.zeros(texts * m, np.uint64)
    weight = np.maximum(np.bincount(owner, weights=count, minlength=texts), 1)
    # processes: every level of the weight axis that begins below the count
    levels = np.zeros(len(count), np.int64)
    levels[count > 1] = np.ceil(np.log2(count[count > 1])).astype(np.int64)
    elem = np.repeat(np.arange(len(h)), levels + 1)
    level = np.arange(len(elem)) - np.repeat(np.cumsum(levels + 1) - (levels + 1), levels + 1)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    width = np.maximum(low, 1)
    seed = mix(h[elem] ^ (level.astype(np.uint64) * _U(0xD1342543DE82EF95)))
    time = np.zeros(len(elem))
    limit = (np.log(m) + 1.0) / weight  # in units of a component's rate
    live = np.arange(len(elem))
    k = 0
    while True:
        waiting = []
        while live.size:  # the next point of every process that may still have one within its text's limit
            k += 1
            r = mix(seed[live] + _U(k * 3 & 0xFFFFFFFFFFFFFFFF)) if k > 1 else mix(seed[live])
            u = unit(r)
            t = time[live] - np.log(u) / (width[live] * m)
            text = owner[elem[live]]
            late = t > limit[text]
            if late.any():
                waiting.append((live[late], k))
            on = live[~late]
            time[on] = t[~late]
            r2 = mix(r[~late])
            # weight coordinate by halving: the bits of a hash say which half, down to unit width
            inside = low[on] + np.floor(unit(mix(r2 + _U(1))) * width[on] - 1e-12).astype(np.int64) < count[elem[on]]
            at = owner[elem[on]] * m + (r2 >> _U(32)).astype(np.int64) % m
            at, tt, rr = at[inside], time[on][inside], r2[inside]
            order = np.lexsort((rr, tt, at))
            at, tt, rr = at[order], tt[order], rr[order]
            lead = np.ones(len(at), bool)
            lead[1:] = at[1:] != at[:-1]
            at, tt, rr = at[lead], tt[lead], rr[lead]
            better = tt < best[at]
            best[at[better]], value[at[better]] = tt[better], rr[better]
            live = on
        grid = best.reshape(texts, m)
        short = np.flatnonzero((weight > 0) & np.isinf(grid).any(1) & (np.bincount(owner, minlength=texts) > 0))
        if not short.size:
            break
        # raise the limit of texts with an empty component and go through their processes again from the start
        limit[short] *= 2
        again = np.zeros(texts, bool)
        again[short] = True
        live = np.flatnonzero(again[owner[elem]])
        time[live] = 0
        k = 0
    return value.reshape(texts, m)


def multiset(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sorted hashes of (shingle, how often so far): the multiset as a plain set, so that overlaps are its intersections."""
    n = np.repeat(h, count)
    nth = np.arange(len(n)) - np.repeat(np.cumsum(count) - count, count)
    return np.sort(mix(n ^ (nth.astype(np.uint64) * _U(0xA0761D6478BD642F))))


def overlap(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Weighted Jaccard similarity of two multisets given as above; 0 where their sizes alone rule out ``least``."""
    if not len(a) or not len(b) or min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = np.concatenate([a, b])
    both.sort()
    same = int(np.count_nonzero(both[1:] == both[:-1]))
    return same / (len(a) + len(b) - same)


def sign(docs: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """Per row: id, ``fp`` (digest of the multiset; null without words), ``sig`` (a byte of each component), ``keys`` (of bands)."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = own.schema["id"].dataType.simpleString()

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        n = part.num_rows
        h, owner, count = weigh(*shingles(texts_of(part, "text")))
        values = signatures(h, owner, count, n)
        cuts = np.searchsorted(owner, np.arange(n + 1))
        packed = np.stack([h, count.astype(np.uint64)], 1).astype("<u8")
        fps = [blake2b(packed[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        keys = np.zeros((n, BANDS), np.uint64)
        for r in range(ROWS):
            keys = mix(keys ^ values.reshape(n, BANDS, ROWS)[:, :, r])
        keys = mix(keys ^ np.arange(BANDS, dtype=np.uint64))
        sig = (values & _U(255)).astype(np.uint8)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(keys.astype(np.int64).ravel()))
        return pa.RecordBatch.from_arrays([part.column("id"), pa.array(fps, pa.binary()), pa.array([s.tobytes() for s in sig], pa.binary()), lists], names=["id", "fp", "sig", "keys"])

    return map_slices(own, "text", f"id {kind}, fp binary, sig binary, keys array<long>", run)


def multisets(docs: DataFrame, ids: DataFrame, *, id_col="doc_id", text_col="text", few: int = FEW_IDS) -> DataFrame:
    """(id, set) of the texts of the given ids only: they are sent to all tasks if measured to be few, and joined by shuffle otherwise."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    own = own.join(F.broadcast(ids) if ids.count() <= few else ids, "id", "left_semi")
    kind = own.schema["id"].dataType.simpleString()

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        h, owner, count = weigh(*shingles(texts_of(part, "text")))
        cuts = np.searchsorted(owner, np.arange(part.num_rows + 1))
        sets = [multiset(h[a:b], count[a:b]).astype("<u8").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.RecordBatch.from_arrays([part.column("id"), pa.array(sets, pa.binary())], names=["id", "set"])

    return map_slices(own, "text", f"id {kind}, set binary", run)


def verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose multisets overlap by at least the threshold."""
    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    kind = joined.schema["a"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            left, right = (batch.column(c).to_pylist() for c in ("set_a", "set_b"))
            good = [overlap(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), threshold) >= threshold for x, y in zip(left, right, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return joined.select("a", "b", "set_a", "set_b").mapInArrow(run, f"a {kind}, b {kind}")


def components(links: DataFrame) -> DataFrame:
    """(id, label) of every id in a link (a, b): the smallest id of its component.

    In each round every node points to the smallest node next to it (or itself), takes one step further along these
    pointers, and links are carried over to where their ends point. Links never grow in number, and each round merges
    every node that is not the smallest around it, so rounds grow with the logarithm of the longest chain.
    """
    edges = written(links.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).where("x <> y").distinct(), name="edges")
    trail = edges.select(F.col("x").alias("id"), F.col("x").alias("label")).limit(0)
    first = True
    while not edges.isEmpty():
        both = edges.select(F.col("y").alias("id"), F.col("x").alias("to")).unionByName(edges.select(F.col("x").alias("id"), F.col("y").alias("to")))
        star = both.groupBy("id").agg(F.min("to").alias("to")).withColumn("to", F.least("id", "to"))
        further = star.select(F.col("id").alias("to"), F.col("to").alias("further"))
        step = written(star.join(further, "to").select("id", F.col("further").alias("label")), name="step")
        ahead = step.select(F.col("id").alias("label"), F.col("label").alias("next"))
        trail = step if first else written(trail.join(ahead, "label", "left").select("id", F.coalesce("next", "label").alias("label")), name="trail")
        first = False
        moved = edges.join(step.select(F.col("id").alias("x"), F.col("label").alias("p")), "x").join(step.select(F.col("id").alias("y"), F.col("label").alias("q")), "y")
        edges = written(moved.select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")).where("x <> y").distinct(), name="edges")
    return trail


def joined_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after further links: the links are carried over to labels, of which the few new components are found."""
    at = lambda side: labels.select(F.col("id").alias(side), F.col("label").alias(f"label_{side}"))
    known = links.join(at("a"), "a", "left").join(at("b"), "b", "left")
    between = known.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
    merged = components(between)
    nodes = labels.unionByName(merged.join(labels, "id", "left_anti").select("id", F.col("id").alias("label")))
    return written(nodes.join(merged.select(F.col("id").alias("label"), F.col("label").alias("to")), "label", "left").select("id", F.coalesce("to", "label").alias("label")), name="labels")


def _live_pairs(rows: pa.Table, estimate: float):
    """Blocks of pairs (asking row, other row, agreement) of one bucket part, with different labels, enough agreement of
    their signatures, and this bucket as the first that they share, so that each pair comes up once. Shared buckets are
    told by the bands' whole keys: bytes of signatures may agree where the texts are in no common bucket."""
    sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint8).reshape(-1, COMPONENTS)
    keys = pc.list_flatten(rows.column("keys")).to_numpy().reshape(-1, BANDS)
    number = lambda c: rows.column(c).to_numpy()
    key, block, ids, label, asks, band = (number(c) for c in ("key", "block", "id", "label", "asks", "band"))
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (block[1:] != block[:-1])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(key)))
    group = np.repeat(np.arange(len(begin)), size)
    ask = np.flatnonzero(asks)
    width = size[group[ask]]
    at = 0
    while at < len(ask):
        to = max(at + 1, int(np.searchsorted(np.cumsum(width[at:]), 100_000, side="right")) + at)
        q = np.repeat(ask[at:to], width[at:to])
        offset = np.arange(len(q)) - np.repeat(np.cumsum(width[at:to]) - width[at:to], width[at:to])
        r = begin[group[q]] + offset
        # two texts that both ask meet twice; their own rows (not asking) are in one block each
        on = ~asks[r] & (label[q] != label[r]) & (ids[q] != ids[r])
        q, r = q[on], r[on]
        if len(q):
            agree = np.count_nonzero(sig[q] == sig[r], axis=1) / COMPONENTS
            on = agree >= estimate
            q, r, agree = q[on], r[on], agree[on]
            on = np.ones(len(q), bool)
            for k in range(BANDS):  # band by band, as the keys of all pairs would take much memory
                on &= (keys[q, k] != keys[r, k]) | (band[q] <= k)
            if on.any():
                yield q[on], r[on], agree[on]
        at = to


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "block").sortWithinPartitions("key", "block")


def residual_links(members: DataFrame, sets: DataFrame, threshold: float, estimate: float) -> DataFrame:
    """Links (a, b) between components that share a bucket. members: (key, band, id, sig, keys, label, major, size).

    In each bucket the texts outside its largest component ask all its texts. Rows without a pair that may still link are
    dropped first, by signatures; the others get their multisets, and pairs are compared from the most similar on. A pair whose
    components are joined already within the task is left out. A bucket with more than BLOCK texts is dealt to several
    tasks; those that ask go to each. Tasks hand on links, at most one for each of their rows.
    """
    sized = members.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    cols = ["key", "block", "band", "id", "sig", "keys", "label", "asks"]
    own = sized.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("asks", F.lit(False))
    ask = sized.where("label <> major").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("asks", F.lit(True))
    kind = members.schema["id"].dataType.simpleString()
    fields = f"key long, block int, band int, id {kind}, sig binary, keys array<long>, label {kind}, asks boolean"

    def live(batches):
        for rows in whole_groups(batches, ["key", "block"]):
            keep = np.zeros(rows.num_rows, bool)
            for q, r, _ in _live_pairs(rows, estimate):
                keep[q] = keep[r] = True
            if keep.any():
                yield from rows.filter(pa.array(keep)).to_batches()

    def compare(batches):
        for rows in whole_groups(batches, ["key", "block"], 4_000):
            ids, label, packed = rows.column("id").to_pylist(), rows.column("label").to_pylist(), rows.column("set")
            parent: dict = {}

            def root(x, parent=parent):
                while parent.get(x, x) != x:
                    x = parent[x]
                return x

            a, b = [], []
            for q, r, agree in _live_pairs(rows, estimate):
                for k in np.argsort(-agree, kind="stable").tolist():
                    x, y = root(label[q[k]]), root(label[r[k]])
                    if x != y and overlap(np.frombuffer(packed[int(q[k])].as_py(), "<u8"), np.frombuffer(packed[int(r[k])].as_py(), "<u8"), threshold) >= threshold:
                        parent[max(x, y)] = min(x, y)
                        a.append(ids[q[k]])
                        b.append(ids[r[k]])
            yield pa.RecordBatch.from_arrays([pa.array(a, rows.schema.field("id").type), pa.array(b, rows.schema.field("id").type)], names=["a", "b"])

    kept = written(_dealt(own.select(cols).unionByName(ask.select(cols))).mapInArrow(live, fields), name="live")
    return _dealt(kept.join(sets, "id").select(*cols, "set")).mapInArrow(compare, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, *, id_col="doc_id", text_col="text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document id: the id, ``class_id`` (smallest id of its class), ``class_size`` and ``kept`` (the class's own id)."""
    estimate = threshold - 3.5 * (threshold * (1 - threshold) / COMPONENTS) ** 0.5
    unnamed = docs.where(F.col(id_col).isNull()).select(F.col(id_col))
    docs = docs.where(F.col(id_col).isNotNull())
    signed = written(sign(docs, id_col=id_col, text_col=text_col), name="signed")
    # one text for each multiset
    texts = signed.where("fp is not null").groupBy("fp").agg(F.min("id").alias("text"), F.first("sig").alias("sig"), F.first("keys").alias("keys"))
    texts = written(texts, name="texts")
    bands = texts.select(F.posexplode("keys").alias("band", "key"), F.col("text").alias("id"))
    sizes = bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = written(bands.join(sizes, "key"), name="members")
    weight = members.groupBy("id").agg(F.sum(F.log2("size")).alias("weight"))
    central = members.join(weight, "id").groupBy("key").agg(F.min_by("id", F.struct(-F.col("weight"), "id")).alias("b"))
    sig = texts.select(F.col("text").alias("id"), "sig", "keys").join(weight.select("id"), "id", "left_semi")
    sig = written(sig, name="sig")
    # every text with the one central text, among those of its buckets, whose signature agrees most
    first = members.join(central, "key").where("id <> b").select(F.col("id").alias("a"), "b").distinct()
    first = first.join(sig.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
    kind = docs.schema[id_col].dataType.simpleString()

    def agree(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, COMPONENTS) for c in ("sa", "sb"))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array((a == b).mean(1))], names=["a", "b", "agree"])

    rated = first.select("a", "b", "sa", "sb").mapInArrow(agree, f"a {kind}, b {kind}, agree double").where(F.col("agree") >= estimate)
    pairs = rated.groupBy("a").agg(F.min_by("b", F.struct(-F.col("agree"), "b")).alias("b"))
    sets = multisets(docs, weight.select("id"), id_col=id_col, text_col=text_col)
    if not signed.groupBy("id", "fp").count().where("count > 1").isEmpty():
        sets = sets.dropDuplicates(["id", "set"])  # repeated rows; without them this changes nothing and is saved
    sets = written(sets, name="sets")
    labels = components(verify(pairs, sets, threshold))
    held = members.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    # the largest component of each bucket with two components or more
    parts = held.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("major"), F.count("*").alias("parts"))
    split = held.join(parts.where("parts > 1"), "key").join(sig, "id")
    links = written(residual_links(split, sets, threshold, estimate), name="links")
    if not links.isEmpty():
        labels = joined_labels(labels, links)
    classes = texts.select("fp", "text").join(labels.select(F.col("id").alias("text"), "label"), "text", "left").select("fp", F.coalesce("label", "text").alias("label"))
    joined = signed.select("id", "fp").join(classes, "fp", "left").select("id", F.coalesce("label", "id").alias("label")).groupBy("id").agg(F.min("label").alias("label"))
    joined = written(joined, name="joined")
    size = written(joined.groupBy("label").agg(F.count("*").alias("class_size")), name="sizes")
    total = size.agg(F.sum("class_size")).first()[0] or 0
    out = join_counts(joined, size, "label", "class_size", total)
    out = out.select(F.col("id").alias(id_col), F.col("label").alias("class_id"), "class_size", (F.col("id") == F.col("label")).alias("kept"))
    return out.unionByName(unnamed.select(id_col, F.col(id_col).alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept")))


def op9_bag_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
