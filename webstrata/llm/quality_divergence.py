"""Quality rules: distribution divergence, in column functions only.

Each text has two histograms: of character classes within words (lower case a-z, upper case A-Z, digits, punctuation,
symbols, other characters) and, for each language, of that language's common words and all others. The common words of a
language are learned: of all its words, in lower case, that stand in at least ``COMMON_SHARE`` of its texts, the ``COMMON_WORDS``
that stand in most of them. The reference of a language is the sum of the histograms of all its texts that
pass the base rules, and then, once more, of those that also are within the limits of the first references.

A text is compared with the references by Jensen-Shannon distance (base 2, the square root, 0 to 1). One language is taken
for both histograms: that with the least sum of the two distances. The text is rejected if either is over its limit. Chance
moves a small histogram by about one over the root of its size, so limits have such a term; below ``MIN_CHARS`` or
``MIN_WORDS`` a histogram says too little, counts 0 in the sum, and isn't held against the text. If no text passes the
base rules there is no reference and nothing more is rejected.

Base rules: at least 20 words, and at most 30 % of them in 8-word windows that the text holds twice or more. Windows are
compared by 64-bit hashes within a text, which a text of a million words would confuse once in 10 million texts.

All languages have references; they are compared in blocks of ``BLOCK_LANGS``, which only bounds the size of one plan. Null
texts have no words and fail the base rules; so do empty ones. Texts with a null language are no reference. Ties between
words go by the word, between languages by distance alone. Repeated rows give repeated rows. Only the named columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webstrata.llm._common import read, written

WINDOW = 8
MIN_BASE_WORDS = 20
MAX_REPEAT_PERCENT = 30
MIN_CHARS, MIN_WORDS = 200, 50
#: Limits: the first number plus the second over the root of the histogram's size.
CLASS_LIMIT, WORD_LIMIT = (0.12, 1.0), (0.12, 2.0)
COMMON_SHARE, COMMON_WORDS = 0.2, 16
BLOCK_LANGS = 32
CLASSES = 6


def _symbols_out(text: Column) -> Column:
    for c in "#*$%&|<>":
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _words(text: Column) -> Column:
    """Words between white space; one plain separator splits faster than a pattern."""
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " ", -1), "")


def common_words(docs: DataFrame, *, text_col="text", lang_col="lang") -> dict[str, list[str]]:
    """Common words by language, those in most texts first; at most COMMON_WORDS for each language."""
    words = _words(F.lower(F.coalesce(F.col(text_col), F.lit(""))))
    own = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.array_distinct(words).alias("words"))
    seen = own.select("lang", F.explode("words").alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    # no more than their mean length over COMMON_SHARE words are frequent; languages are few, each has a reference in the plan later
    texts = docs.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count("*").alias("texts"))
    often = seen.join(F.broadcast(texts), "lang").where(F.col("n") >= F.col("texts") * COMMON_SHARE)
    rows = often.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("k") <= COMMON_WORDS).select("lang", "k", "word").collect()
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.k)):
        out.setdefault(r.lang, []).append(r.word)
    return out


def measures(docs: DataFrame, common: list[str], *, id_col="doc_id", text_col="text", lang_col: str | None = "lang") -> DataFrame:
    """Per row: id, language, the base measures, the histogram of character classes, and how often the common words of any language stand in it."""
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    own = docs.select(F.col(id_col).alias("id"), lang.alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cut = own.select("id", "lang", "text", _words(F.col("text")).alias("words"), F.split("text", "\n", -1).alias("lines"))
    some = F.filter("lines", lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    n = F.size("words")
    hashes = F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))
    one = cut.select(
        "id", "lang", "text", n.cast("long").alias("n_words"), some.alias("some"), F.array_join("words", "").alias("joined"),
        (F.filter(F.transform("words", lambda w: F.lower(w)), lambda x: x.isin(*common)) if common else F.array().cast("array<string>")).alias("common"),
        F.when(n > WINDOW, hashes).otherwise(F.array().cast("array<long>")).alias("windows"),
    )
    placed = F.transform("windows", lambda x, i: F.struct(x.alias("h"), i.alias("p")))
    two = one.select(
        "id", "lang", "n_words", "common", "joined", F.length("joined").cast("long").alias("word_chars"),
        (F.octet_length("text") - F.octet_length(_symbols_out(F.col("text")))).cast("long").alias("n_symbols"),
        (F.size("some") - F.size(F.array_distinct("some"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(placed)).alias("pairs"),
        F.regexp_replace("joined", "[a-z]+", "").alias("rest"),
    )
    twice = F.filter("pairs", lambda x, k: (x.h == F.get("pairs", k + 1).h) | F.coalesce(x.h == F.get("pairs", k - 1).h, F.lit(False)))
    gone = lambda pattern: F.length("rest") - F.length(F.regexp_replace("rest", pattern, ""))
    upper, digit, mark, symbol = gone("[A-Z]+"), gone("[0-9]+"), gone(r"[!-/:-@\[-`{-~&&[^#*$%&|<>]]+"), gone("[#*$%&|<>]+")
    begin = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(F.sort_array(F.transform("twice", lambda x: x.p)), begin, lambda a, p: F.struct(p.alias("last"), (a.n + F.least(F.lit(WINDOW), p - a.last)).alias("n"))).n
    classes = [F.length("joined") - F.length("rest"), F.col("upper"), F.col("digit"), F.col("mark"), F.col("symbol")]
    kinds = F.array_distinct("common")
    numbers = F.transform(kinds, lambda w: F.size("common") - F.size(F.array_remove("common", w)))
    three = two.select("*", F.when(F.col("pairs").isNotNull(), twice).alias("twice"), upper.alias("upper"), digit.alias("digit"), mark.alias("mark"), symbol.alias("symbol"))
    return three.select(
        "id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.when(F.col("twice").isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"),
        F.array(*classes, F.col("word_chars") - sum(classes[1:], classes[0])).cast("array<double>").alias("classes"),
        F.map_from_arrays(kinds, numbers).alias("common"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_BASE_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def word_counts(words: list[str]) -> Column:
    """Counts of the given words and of all others."""
    found = F.transform(F.array(*map(F.lit, words)), lambda w: F.coalesce(F.try_element_at("common", w), F.lit(0))) if words else F.array().cast("array<int>")
    return F.concat(found, F.array((F.col("n_words") - F.aggregate(found, F.lit(0), lambda a, x: a + x)).cast("int"))).cast("array<double>")


def references(measured: DataFrame, common: dict[str, list[str]]) -> list[tuple[str, list[float], list[float]]]:
    """(language, histogram of classes, histogram of its common words), each summing to 1, by language."""
    good = measured.where(F.col("lang").isNotNull())
    of_words = F.array().cast("array<double>")
    for lang, words in common.items():
        of_words = F.when(F.col("lang") == lang, word_counts(words)).otherwise(of_words)
    sums = [F.sum(F.get("classes", F.lit(k))).alias(f"c{k}") for k in range(CLASSES)] + [F.sum(F.get("w", F.lit(k))).alias(f"w{k}") for k in range(COMMON_WORDS + 1)]
    rows = good.select("lang", "classes", of_words.alias("w")).groupBy("lang").agg(*sums).collect()  # a row for each language
    share = lambda values: [v / (sum(values) or 1.0) for v in values]
    return [(r.lang, share([r[f"c{k}"] for k in range(CLASSES)]), share([r[f"w{k}"] or 0.0 for k in range(len(common.get(r.lang, [])) + 1)])) for r in sorted(rows, key=lambda r: r.lang)]


def distance(counts: Column, total: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance of a histogram of counts and a reference."""

    def part(p: Column, q: Column) -> Column:
        m = (p + q) / 2
        return F.when(p > 0, p * F.ln(p / m)).otherwise(0.0) + F.when(q > 0, q * F.ln(q / m)).otherwise(0.0)

    parts = F.zip_with(counts, F.array(*map(F.lit, reference)), lambda n, q: part(n / total, q))
    sum_ = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(sum_ / (2 * math.log(2)), F.lit(0.0)))


def rate(measured: DataFrame, known: list[tuple[str, list[float], list[float]]], common: dict[str, list[str]]) -> DataFrame:
    """Put to the measures: both distances to the nearest reference (null: too short, or no reference), and whether one is ``off``."""
    none = F.lit(None).cast("struct<both:double,class_distance:double,word_distance:double>")
    rated = measured.withColumn("best", none)
    for at in range(0, len(known), BLOCK_LANGS):
        found = []
        for lang, classes, words in known[at : at + BLOCK_LANGS]:
            by_class = F.when(F.col("word_chars") >= MIN_CHARS, distance(F.col("classes"), F.col("word_chars"), classes))
            by_word = F.when(F.col("n_words") >= MIN_WORDS, distance(word_counts(common.get(lang, [])), F.col("n_words"), words))
            pair = F.struct(by_class.alias("c"), by_word.alias("w"))
            found.append(F.transform(F.array(pair), lambda p: F.struct((F.coalesce(p.c, F.lit(0.0)) + F.coalesce(p.w, F.lit(0.0))).alias("both"), p.c.alias("class_distance"), p.w.alias("word_distance"))))
        every = F.concat(F.when(F.col("best").isNotNull(), F.array("best")).otherwise(F.array().cast("array<struct<both:double,class_distance:double,word_distance:double>>")), *found)
        rated = rated.withColumn("best", F.array_min(every))
        if at + BLOCK_LANGS < len(known):
            rated = written(rated, name="rated")
    rated = rated.select(*[c for c in rated.columns if c != "best"], "best.class_distance", "best.word_distance")
    over = lambda d, n, limit: F.coalesce(F.col(d) > limit[0] + limit[1] / F.sqrt(F.col(n)), F.lit(False))
    return rated.withColumn("off", over("class_distance", "word_chars", CLASS_LIMIT) | over("word_distance", "n_words", WORD_LIMIT))


def judge(docs: DataFrame, *, id_col="doc_id", text_col="text", lang_col: str | None = "lang") -> DataFrame:
    """Per row: id, measures, ``base_failed``, ``class_distance``, ``word_distance`` (null: too short, or no reference) and ``kept``."""
    common = common_words(docs, text_col=text_col, lang_col=lang_col) if lang_col else {}
    words = sorted({w for own in common.values() for w in own})
    measured = written(measures(docs, words, id_col=id_col, text_col=text_col, lang_col=lang_col), name="measures")
    rated = rate(measured, references(measured.where(~base_failed()), common), common)
    rated = rate(measured, references(rated.where(~base_failed() & ~F.col("off")), common), common)
    return rated.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), "class_distance", "word_distance", (~base_failed() & ~F.col("off")).alias("kept"),
    )


def op3_quality_divergence(spark, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"))
