"""Ranked search, substring dedup and phrase mining against brute force, with odd rows, small blocks and frequent keys."""

import collections
import math
import random
import re

import numpy as np
import pytest

from webstrata.llm import _common
from webstrata.llm import phrase_mining as pm
from webstrata.llm import ranked_search as rs
from webstrata.llm import substring_dedup as sd

ODD = [None, "", " ", "a b c a b c", "A,b;C d", "x" * 3000, "日本 é\tü a", "a\x00b c", "the a of b " * 900, "a b c d e f g h i j k l m n o p q r s t u v w"]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def odd_rows(spark):
    rows = [(k, t, None if k % 2 else "en", "s", 1.0, 7) for k, t in enumerate(ODD)] + [(3, ODD[3], "en", None, None, None), (None, ODD[9], None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, id string, score double, at long")


# 11


def brute_search(docs, items, most=20):
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    terms = [(k, collections.Counter(word.findall(lower(t)))) for k, t in docs]
    n, length = sum(1 for _, c in terms if c), sum(sum(c.values()) for _, c in terms)
    df = collections.Counter(w for _, c in terms for w in c)
    out = []
    for name, text in items:
        scored = []
        for k, c in terms:
            size = sum(c.values())
            m = 75 + (25 * size * n) // length if length else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 12 * m)) for w in word.findall(lower(text)) if c[w])
            if s > 0:
                scored.append((-s, k is None, k or 0, k))
        out += [(name, r, k, -s) for r, (s, _, _, k) in enumerate(sorted(scored)[:most], 1)]
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r))


@pytest.mark.parametrize(("block", "most", "rows"), [(1 << 20, 20, 8192), (60, 3, 64)])
def test_search_random(spark, monkeypatch, block, most, rows):
    monkeypatch.setattr(rs, "BLOCK_ROWS", rows)
    rng = random.Random(5)
    words = [f"w{k}" for k in range(40)]
    text = lambda n: " ".join(words[int(rng.random() ** 3 * 40)] for _ in range(n))
    docs = [(k, text(rng.randint(0, 60))) for k in range(400)] + [(7, "w1 w2 W2"), (None, "w1 w30 w31"), (500, None)]
    items = [("a", text(9)), ("b", text(90) + " none"), ("a", "w39 w39 w1"), ("c", None), ("d", "?"), (None, "w30")]
    got = rs.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id string, text string"), most=most, block_bytes=block)
    assert order(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect())) == order(brute_search(docs, items, most))


def test_search_odd_rows_and_wide_masks(spark):
    items = [(1, " ".join(f"t{k}" for k in range(200)) + " a b")]
    docs = odd_rows(spark)
    got = rs.search(docs, spark.createDataFrame(items, "item_id long, text string"))
    want = brute_search([(r.doc_id, r.text) for r in docs.collect()], items)
    assert order(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect())) == order(want)
    assert rs.search(docs.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert rs.search(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_search_evaluates_few_masks():
    rng = np.random.default_rng(1)
    places, seen = rs.Places([(0, np.arange(12), np.arange(1, 13) * 1000)], 20), []
    merged = places._merged
    places._merged = lambda a, b: seen.append(len(b[0])) or merged(a, b)
    there = rng.random((12, 4000)) < 0.3
    term, owner = np.nonzero(there)
    unit = rng.integers(400_000, 500_000, len(term))
    places.add(np.arange(4000), np.zeros(4000, bool), owner, term, unit)
    scores = np.zeros(4000, np.int64)
    np.add.at(scores, owner, unit * (term + 1) * 1000)
    want = sorted(zip(-scores, range(4000), strict=True))[:20]
    assert [(-s, i) for s, i in zip(*places.best[0][:2], strict=True)] == want
    assert sum(seen) < 1000  # of 4000 documents


# 12


def brute_repeats(docs, window=20):
    """docs: in order. (id, n_words, n_removed, kept)"""
    seen, out = set(), []
    for k, t in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = set()
        for s in range(len(words) - window + 1):
            w = tuple(words[s : s + window])
            if w in seen:
                gone |= set(range(s, s + window))
            seen.add(w)
        out.append((k, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return out


def repeating_docs(seed, n=120):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 300)}"
    passages = [[word() for _ in range(rng.randint(15, 60))] for _ in range(8)]
    docs = []
    for k in range(n):
        words = []
        for _ in range(rng.randint(0, 6)):
            words += rng.choice(passages) if rng.random() < 0.5 else [word() for _ in range(rng.randint(1, 30))]
        if rng.random() < 0.2 and docs:
            words = docs[-1][1].split()[:-3] + [word()]
        if rng.random() < 0.1:
            words += ["a", "b"] * 40
        docs.append((k, " ".join(words).replace("w1 ", "w1\n\t ")))
    return docs


@pytest.mark.parametrize(("window", "hot", "stretch"), [(20, 20_000, 1 << 20), (5, 2, 200), (20, 1, 150)])
def test_repeats_random(spark, monkeypatch, window, hot, stretch):
    monkeypatch.setattr(sd, "stretches", lambda raw, limit=0: _common.stretches(raw, stretch))
    docs = repeating_docs(window + hot)
    own = sd.pieces([t for _, t in docs], window)
    texts, at, anchor, digest = own["text"], own["start"], own["anchor"], own["digest"]
    assert len(set(zip(texts.tolist(), at.tolist(), strict=True))) == len(texts) == len(set(zip(texts.tolist(), anchor.tolist(), digest.tolist(), strict=True)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = sd.repeats_removed(frame, window=window, hot_pieces=hot).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in got] == brute_repeats(docs, window)
    assert all(sum(s.end - s.first for s in r.spans) == r.n_removed for r in got)


def test_repeats_odd_rows(spark):
    docs = odd_rows(spark)
    got = sd.repeats_removed(docs, window=5).collect()
    assert len(got) == len(ODD) + 2
    by = {(r.doc_id, r.n_words): [] for r in got}
    for r in got:
        by[r.doc_id, r.n_words].append(r.n_removed)
    assert sorted(by[3, 6]) == [0, 6]  # of two equal rows one keeps its words
    assert by[None, 23] == [0] and by[9, 23] == [23]  # null ids come first
    assert by[0, 0] == by[1, 0] == by[2, 0] == [0]
    names = docs.select("text", docs.id.alias("kept"), docs.at.alias("spans"), "doc_id")
    assert sd.repeats_removed(names, window=5).count() == len(got)
    assert sd.repeats_removed(docs.limit(0)).count() == 0
    strings = sd.repeats_removed(docs.where("doc_id is not null").selectExpr("concat('k', doc_id) doc_id", "text"), window=5)
    assert dict(strings.dtypes)["doc_id"] == "string" and strings.count() == len(ODD) + 1


def test_repeats_sees_windows_over_factor_ends():
    first = [b"%d" % k for k in range(60)]
    second = first[:30] + first[25:55]
    seen = brute_repeats([(0, b" ".join(first).decode()), (1, b" ".join(second).decode())])
    assert seen[1][2] == 60 and brute_repeats([(0, " ".join(map(str, range(60)))), (1, " ".join(map(str, [*range(30), 99, *range(30, 60)])))])[1][2] == 60


# 13


def test_filter_round_trip():
    rng = np.random.default_rng(3)
    for words, width in ((1, 8), (2, 16), (3, 16), (3, 21), (4, 16), (4, 17), (4, 21)):
        for n in (1, 2, 100, 5000):
            ids = np.unique(rng.integers(0, 1 << width, (n, words), dtype=np.uint64), axis=0)
            keys = pm.Keys.of_words(list(ids.T), width)
            assert keys.bits == words * width and (np.stack(keys.words(words), axis=1) == ids).all()
            keys = keys[keys.order()]
            assert len(keys.new()) == len(ids)
            counts = rng.integers(1, 1000, len(keys)) ** 2
            for cut in (0, 1, 5, 8):
                shard, rest = keys.top(cut), keys.rest(cut)
                again = pm.Keys.joined(shard, cut, rest)
                assert (np.stack(again.words(words)) == np.stack(keys.words(words))).all()
            back, c = pm.unpacked(pm.packed(keys, counts), keys.bits)
            assert (np.stack(back.words(words)) == np.stack(keys.words(words))).all() and (c == counts).all()
            both, c = pm.merged([(keys, counts), (keys, counts)])
            assert (both.low == keys.low).all() and (c == 2 * counts).all()
    keys = pm.Keys.of_words([np.arange(100_000, dtype=np.uint64) % np.uint64(317), np.arange(100_000, dtype=np.uint64), np.arange(100_000, dtype=np.uint64) >> np.uint64(3)], 17)
    keys = keys[keys.order()]
    assert len(pm.packed(keys, np.ones(len(keys), np.int64))) < 100_000 * 6.5  # 16 bytes a phrase as plain numbers


def brute_phrases(docs, least, cover=80, most=2000):
    f, n = collections.Counter(), collections.Counter()
    for lang, t in docs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(t)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                f.update((lang, tuple(w[k : k + m])) for k in range(len(w) - m + 1))
    often = {k: c for k, c in f.items() if c >= least and len(k[1]) > 1}
    covered = {(lang, p[b : b + s]) for (lang, p), c in often.items() for s in range(2, len(p)) for b in range(len(p) - s + 1) if 100 * c >= cover * f[lang, p[b : b + s]]}
    out = collections.defaultdict(list)
    for (lang, p), a in often.items():
        if (lang, p) not in covered:
            score, _, left, right = min(((2000000 * a) // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, r, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items() for r, (s, a, p, left, right) in enumerate(sorted(rows)[:most], 1))


PHRASE_COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize(("table", "stretch", "shard", "most"), [(500_000, 1 << 20, 2 << 20, 2000), (12, 100, 500, 25), (2, 1 << 20, 1 << 20, 40)])
def test_phrases_random(spark, monkeypatch, table, stretch, shard, most):
    monkeypatch.setattr(pm, "stretches", lambda raw, limit=0: _common.stretches(raw, stretch))
    monkeypatch.setattr(pm, "SHARD", shard)
    rng = random.Random(7)
    words = ["New", "york", "city", "the", "of", "é", "日本", "b", "c", "d", "e", "f"]
    docs = []
    for k in range(300):
        lang = rng.choice(["en", "de", None])
        docs.append((lang, " ".join(rng.choice(["New York city hall", "of the"]) if rng.random() < 0.2 else words[int(rng.random() ** 2 * 12)] + rng.choice(["", "", "", ".", ",", "\t", "\n\n"]) for _ in range(rng.randint(0, 80)))))
    docs += [("en", None), ("en", ""), ("fr", " .. ")]
    frame = spark.createDataFrame(docs, "lang string, text string").repartition(4)
    got = pm.collocations(frame, least=30, most=most, table_words=table)
    assert sorted(tuple(r[c] for c in PHRASE_COLUMNS) for r in got.collect()) == brute_phrases(docs, 30, most=most)


def test_phrases_of_wide_ids(spark, monkeypatch):
    """As many words as need wider ids: every phrase is still counted by its filter."""
    width = pm.Table.__init__

    def wide(self, *args):
        width(self, *args)
        self.width = dict.fromkeys(self.width, 19)

    monkeypatch.setattr(pm.Table, "__init__", wide)
    monkeypatch.setattr(pm, "SHARD", 1000)
    rng = random.Random(8)
    docs = [("en", " ".join(rng.choice("a b c d".split()) for _ in range(60))) for _ in range(200)]
    got = pm.collocations(spark.createDataFrame(docs, "lang string, text string").repartition(3))
    assert sorted(tuple(r[c] for c in PHRASE_COLUMNS) for r in got.collect()) == brute_phrases(docs, 30)


def test_phrases_odd_rows(spark):
    docs = odd_rows(spark).withColumnRenamed("id", "phrase").withColumnRenamed("at", "n")
    got = pm.collocations(docs, least=2)
    assert sorted(tuple(r[c] for c in PHRASE_COLUMNS) for r in got.collect()) == brute_phrases([(r.lang, r.text) for r in docs.collect()], 2)
    assert pm.collocations(docs.limit(0)).count() == 0
    assert pm.collocations(docs, least=10**6).count() == 0


def test_filters_flush_and_merge(spark, monkeypatch):
    monkeypatch.setattr(pm, "HELD", 50)
    docs = [("en", f"a b c d{k % 9} e f. a b") for k in range(300)]
    got = pm.collocations(spark.createDataFrame(docs, "lang string, text string").repartition(2))
    assert sorted(tuple(r[c] for c in PHRASE_COLUMNS) for r in got.collect()) == brute_phrases(docs, 30)


def test_bit_table(spark):
    slots = [0, 1, 32767, 32768, (1 << 27) - 1, None, 1]
    table = _common.bit_table(spark.createDataFrame([(s,) for s in slots], "slot long"), "slot")
    asked = np.array([0, 1, 2, 32767, 32768, 32769, (1 << 27) - 1], np.uint64)
    assert _common.in_table(table, asked).tolist() == [True, True, False, True, True, False, True]


def test_stretches_keep_words():
    raw = b"aa  bbb " * 50 + b"c" * 90 + b" d"
    for limit in (1, 7, 30, 1000):
        parts = list(_common.stretches(raw, limit))
        assert b"".join(parts) == raw and [w for p in parts for w in p.split()] == raw.split()
