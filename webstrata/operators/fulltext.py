"""Full text: an inverted index with positions, BM25 ranking, phrases and prefixes, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.storage import once, written

K1, B = 1.2, 0.75


def terms(text: Column) -> Column:
    """Words of letters and digits (a-z and 0-9), in lower case and order."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)


def index(docs: DataFrame, id_col: str, text_col: str, only: list[str] | None = None) -> DataFrame:
    """(term, id, tf, positions, length): one row for each term of a document; ``only``: of these terms alone."""
    words = once(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), words=terms(F.col("text")))
    placed = words.select("id", F.size("words").alias("length"), F.posexplode("words").alias("position", "term"))
    placed = placed.where(F.col("term").isin(only)) if only else placed
    return placed.groupBy("term", "id").agg(F.count("*").cast("int").alias("tf"), F.sort_array(F.collect_list("position")).alias("positions"), F.first("length").alias("length"))


def bm25(docs: DataFrame, id_col: str, text_col: str, query: list[str], *, k1: float = K1, b: float = B, prefix: bool = False) -> DataFrame:
    """(id, score) of the documents with a term of the query; larger is better.

    Only the query's terms are counted, in the documents' own rows, so nothing but scores is shuffled. The counts are written, as
    the facts about all documents and the scores both read them: words are found once.
    """
    words = once(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), words=terms(F.col("text")))

    def times(q: str) -> Column:
        return F.size(F.filter("words", lambda w: F.startswith(w, F.lit(q)) if prefix else w == F.lit(q)))

    counted = once(words.select("id", "words"), length=F.size("words"), **{f"tf{k}": times(q) for k, q in enumerate(query)}).drop("words")
    counted = written(counted, "term-counts")
    facts = counted.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(query))]).first()

    def part(k: int) -> Column:
        idf = F.ln((F.lit(float(facts.n)) - facts[f"df{k}"] + 0.5) / (facts[f"df{k}"] + 0.5) + 1)
        t = F.col(f"tf{k}").cast("double")
        return idf * t * (k1 + 1) / (t + k1 * (1 - b + b * F.col("length") / F.lit(float(facts["mean"] or 1))))

    some = sum((F.col(f"tf{k}") for k in range(len(query))), F.lit(0)) > 0
    return counted.where(some).select(F.col("id").alias(id_col), sum((part(k) for k in range(len(query))), F.lit(0.0)).alias("score"))


def phrase(indexed: DataFrame, words: list[str]) -> DataFrame:
    """(id, n) of documents that hold the words one behind the other: joins of positions."""
    found = indexed.where(F.col("term") == words[0]).select("id", F.explode("positions").alias("at"))
    for k, word in enumerate(words[1:], 1):
        other = indexed.where(F.col("term") == word).select("id", F.explode("positions").alias("p")).select("id", (F.col("p") - k).alias("at"))
        found = found.join(other, ["id", "at"])
    return found.groupBy("id").agg(F.count("*").alias("n"))


def matching(docs: DataFrame, fields: dict[str, str], *, every: list[str] = (), some: list[str] = (), none: list[str] = (), field: str | None = None) -> DataFrame:
    """The rows that hold all terms of ``every``, one of ``some`` if any is given, and none of ``none``, in a field or in all.

    fields: by field name its column. A term that ends in ``*`` is a prefix; one of several words is a phrase.
    """
    use = [field] if field else list(fields)
    staged = once(docs, **{f"__w_{f}": terms(F.col(fields[f])) for f in use})

    def within(words: Column, term: str) -> Column:
        parts = term.lower().rstrip("*").split()
        if len(parts) == 1:
            return F.exists(words, lambda w: F.startswith(w, F.lit(parts[0]))) if term.endswith("*") else F.array_contains(words, parts[0])
        return F.exists(F.transform(words, lambda _, k: F.slice(words, k + 1, len(parts))), lambda run: run == F.array(*map(F.lit, parts)))

    def found(term: str) -> Column:
        out = F.lit(False)
        for f in use:
            out = out | F.coalesce(within(F.col(f"__w_{f}"), term), F.lit(False))
        return out

    keep = F.lit(True)
    for term in every:
        keep = keep & found(term)
    if some:
        one = F.lit(False)
        for term in some:
            one = one | found(term)
        keep = keep & one
    for term in none:
        keep = keep & ~found(term)
    return staged.where(keep).drop(*[f"__w_{f}" for f in use])
