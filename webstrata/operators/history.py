"""Snapshots of a URL through time: differences, first appearances, provenance, timelines; duplicates by digests."""

from __future__ import annotations

from collections import Counter
from hashlib import blake2b

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from webstrata.functions.slices import sliced
from webstrata.functions.text import clean_space, hamming_similarity, normalize_search
from webstrata.operators.similarity import ratios
from webstrata.storage import new_path, sorted_in, written

#: Line ends as text editors know them.
LINES = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"
LISTED = 200


def clean_lines(text: Column) -> Column:
    """Distinct lines with content, white space collapsed, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(text, LINES), clean_space), lambda x: x != "")))


@F.pandas_udf(DoubleType())
def character_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of characters in matching blocks, rounded half to even at six places."""
    return pd.Series([round(r, 6) for r in ratios(list(zip(a.fillna(""), b.fillna(""), strict=True)))], dtype="float64")


def _neighbours(keys: DataFrame, url: str, order: str) -> DataFrame:
    """(url, order, key, earlier, earlier_key): each key with the one before it of the same URL.

    Keys are dealt by range, so a URL with many snapshots lies in several parts; the last key of each part is carried
    over to the next. The parts are written, as a second reading could cut them elsewhere.
    """
    spark = keys.sparkSession
    path = new_path(spark, "snapshots")
    by = [url, order, "key"]
    keys.select(*by).repartitionByRange(*by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    w = Window.partitionBy("part").orderBy(*by)
    before = F.struct(*by)
    ends = dealt.groupBy("part").agg(F.max(before).alias("end"))
    ends = ends.select("part", F.lag("end").over(Window.orderBy("part")).alias("carried"))  # a row for each part
    rows = dealt.withColumn("before", F.lag(before).over(w)).join(F.broadcast(ends), "part").withColumn("before", F.coalesce("before", "carried"))
    rows = rows.where(F.col(url).eqNullSafe(F.col(f"before.{url}")))
    return rows.select(*by, F.col(f"before.{order}").alias("earlier"), F.col("before.key").alias("earlier_key")).where("earlier is not null")


def snapshot_pairs(rows: DataFrame, url: str, order: str, text: str) -> DataFrame:
    """Each snapshot with the one before it: lines added and removed (the first of them, and their numbers).

    The order is found over digests only; texts are then joined by snapshot. Equal snapshots at one place are one text.
    """
    key = F.sha2(F.to_json(F.struct(F.col(url).alias("u"), F.col(order).alias("o"), F.sha2(F.col(text).cast("binary"), 256).alias("d"))).cast("binary"), 256)
    keyed = rows.select(url, order, F.col(text).alias("text"), key.alias("key"))
    texts = keyed.groupBy("key").agg(F.first("text").alias("text"))
    later, earlier = texts.select("key", F.col("text").alias("later_text")), texts.select(F.col("key").alias("earlier_key"), F.col("text").alias("earlier_text"))
    pairs = _neighbours(keyed, url, order).join(later, "key").join(earlier, "earlier_key")
    pairs = pairs.withColumns({"a": clean_lines(F.col("earlier_text")), "b": clean_lines(F.col("later_text"))})
    added, removed = F.array_except("b", "a"), F.array_except("a", "b")
    return pairs.select(
        url, "earlier", F.col(order).alias("later"), F.size(added).alias("n_added"), F.size(removed).alias("n_removed"),
        F.slice(added, 1, LISTED).alias("added"), F.slice(removed, 1, LISTED).alias("removed"), F.col("earlier_text").eqNullSafe(F.col("later_text")).alias("same"), "earlier_text", "later_text",
    )


def line_counts(rows: DataFrame, url: str, order: str, text: str) -> DataFrame:
    """(url, earlier, later, n_added, n_removed): as ``snapshot_pairs``, by digests of lines (two times 64 bits), so no text is shuffled."""
    plain = F.coalesce(F.col(text), F.lit(""))
    digests = F.transform(F.array_distinct(F.filter(F.transform(F.split(plain, LINES), clean_space), lambda x: x != "")), lambda x: F.struct(F.xxhash64(x).alias("p"), F.xxhash64(F.lit(1), x).alias("q")))
    place = F.sha2(F.to_json(F.struct(F.col(url).alias("u"), F.col(order).alias("o"), F.sha2(F.col(text).cast("binary"), 256).alias("d"))).cast("binary"), 256)
    keyed = written(rows.select(url, order, place.alias("key"), digests.alias("lines")), "lines")
    sets = keyed.groupBy("key").agg(F.first("lines").alias("lines"))
    pairs = _neighbours(keyed, url, order).join(sets.withColumnRenamed("lines", "b"), "key").join(sets.select(F.col("key").alias("earlier_key"), F.col("lines").alias("a")), "earlier_key")
    return pairs.select(url, "earlier", F.col(order).alias("later"), F.size(F.array_except("b", "a")).alias("n_added"), F.size(F.array_except("a", "b")).alias("n_removed"))


def with_similarity(pairs: DataFrame) -> DataFrame:
    """similarity: 1 for equal texts, else the share of matching characters; changed: under 0.999999.

    The pairs are dealt to several tasks for each core, as the work on a pair is much larger than its texts.
    """
    pairs = pairs.repartition(4 * pairs.sparkSession.sparkContext.defaultParallelism)
    ratio = F.when(F.col("same"), F.lit(1.0)).otherwise(character_ratio(F.when(~F.col("same"), F.col("earlier_text")), F.when(~F.col("same"), F.col("later_text"))))
    return pairs.withColumn("similarity", ratio).withColumn("changed", F.col("similarity") < 0.999999).drop("earlier_text", "later_text")


def with_changed(pairs: DataFrame) -> DataFrame:
    """changed alone, equal to that of ``with_similarity``: different texts of up to 500,000 characters together share less than 0.999999."""
    a, b = F.coalesce("earlier_text", F.lit("")), F.coalesce("later_text", F.lit(""))
    both = F.length(a) + F.length(b)
    long = ~F.col("same") & (both > 500_000)
    ratio = character_ratio(F.when(long, a), F.when(long, b))
    changed = F.when(F.col("same") | (both == 0), False).when(long, ratio < 0.999999).otherwise(True)
    return pairs.withColumn("changed", changed).drop("earlier_text", "later_text")


def first_appearances(rows: DataFrame, queries: list[str], url: str, order: str, text: str) -> DataFrame:
    """(query, url, first, last): where each text first and last holds the query, whatever the case.

    Each row yields its matching queries only; the rest is a partial aggregation.
    """
    found = rows.select(url, order, F.filter(F.array(*map(F.lit, queries)), lambda q: F.contains(F.lower(text), F.lower(q))).alias("q"))
    return found.select(F.explode("q").alias("query"), url, order).groupBy("query", url).agg(F.min(order).alias("first"), F.max(order).alias("last"))


def exact_groups(rows: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, digest, representative, members) of texts that come more than once."""
    keyed = rows.select(id_col, F.sha2(F.col(text).cast("binary"), 256).alias("digest"))
    groups = keyed.groupBy("digest").agg(F.min(id_col).alias("representative"), F.count("*").alias("members")).where("members > 1")
    return keyed.join(groups, "digest").select(id_col, "digest", "representative", "members")


def provenance(groups: DataFrame, rows: DataFrame, id_col: str, url: str, group: str = "digest") -> DataFrame:
    """(source, mirror): from the first member of each group to every later one at another URL."""
    members = groups.join(rows.select(id_col, url), id_col)
    first = members.groupBy(group).agg(F.min_by(F.struct(id_col, url), id_col).alias("f"))
    pairs = members.join(first, group).where((F.col(id_col) != F.col(f"f.{id_col}")) & (F.col(url) != F.col(f"f.{url}")))
    return pairs.select(F.col(f"f.{id_col}").alias("source"), F.col(id_col).alias("mirror"), F.col(f"f.{url}").alias("source_url"), F.col(url).alias("mirror_url"))


@sliced(LongType())
def simhash64(text: list) -> list:
    """64 signs of summed shingle hashes; shingles of four words, weight by the logarithm of their number; 0 without words."""
    import re

    import numpy as np

    word = re.compile(r"[\w'-]+")
    out = []
    for value in text:
        words = word.findall(value or "")
        parts = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] if len(words) >= 4 else words
        if not parts:
            out.append(0)
            continue
        seen = Counter(parts)
        hashes = np.frombuffer(b"".join(blake2b(p.encode(), digest_size=8).digest() for p in seen), np.uint8).reshape(-1, 8)
        weight = np.array([n.bit_length() for n in seen.values()], np.float32)  # 1 + the whole part of the logarithm
        ones = weight @ np.unpackbits(hashes, axis=1).astype(np.float32)
        out.append(int(np.packbits(2 * ones >= weight.sum()).view(">u8")[0].astype(np.uint64).view(np.int64)))
    return out


def fingerprints(rows: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, exact key, 64-bit fingerprint) of the texts with content."""
    full = rows.where(F.length(F.trim(text)) > 0)
    return full.select(F.col(id_col).alias("id"), F.sha2(normalize_search(F.col(text)).cast("binary"), 256).alias("exact_key"), simhash64(normalize_search(F.col(text))).alias("value"))


def _join_keys(value: Column, differing: int) -> list[Column]:
    """Keys of which two fingerprints share one if they share a 16-bit band and differ in at most so many bits.

    The other 48 bits are cut into one part more than bits may differ, so one of the parts is equal as well. A key of a band
    and a part is met by far fewer fingerprints than a band alone, and no link is lost.
    """
    parts = min(differing + 1, 48)
    out = []
    for band in range(4):
        rest = [k for k in range(64) if k // 16 != band]
        for p in range(parts):
            mask = sum(1 << k for k in (*range(16 * band, 16 * band + 16), *rest[48 * p // parts : 48 * (p + 1) // parts]))
            out.append(F.struct(F.lit(band * 64 + p).alias("kind"), value.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("bits")))
    return out


def near_links(prints: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(a, b, similarity): links between different fingerprints that share one of four 16-bit bands and agree in enough bits.

    Equal fingerprints and equal texts are one node first (its smallest id), so a group of copies makes no pairs.
    """
    nodes = prints.groupBy("value").agg(F.min("id").alias("node"))
    banded = nodes.select("node", "value", F.explode(F.array(*_join_keys(F.col("value"), int(64 * (1 - threshold) + 1e-9)))).alias("key"))
    a, b = banded.select(F.col("node").alias("a"), F.col("value").alias("va"), "key"), banded.select(F.col("node").alias("b"), F.col("value").alias("vb"), "key")
    sim = hamming_similarity(F.col("va"), F.col("vb"))
    near = a.join(sorted_in(b), "key").where((F.col("a") < F.col("b")) & (sim >= threshold)).select("a", "b", sim.alias("similarity")).distinct()
    own = prints.join(sorted_in(nodes), "value").where("id <> node").select(F.col("node").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    keys = prints.groupBy("exact_key").agg(F.min("id").alias("a"))
    same = prints.join(sorted_in(keys), "exact_key").where("id <> a").select("a", F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    return near.unionByName(own).unionByName(same).groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def near_groups(prints: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(id, group, members, links, group_method, method, similarity): documents in groups of two or more.

    group: the smallest id; links: near links of the document's fingerprint or text; group_method: exact for groups of one text,
    else near; method: exact where the text is that of the group's first document, else near; similarity: of the two fingerprints.
    """
    prints = written(prints.select("id", "exact_key", "value"), "prints")  # read six times below: texts are fingerprinted once
    links = written(near_links(prints, threshold), "near-links")
    labels = smallest_labels(links)
    size = labels.join(prints.select("id", "exact_key"), "id").groupBy("label").agg(F.count("*").alias("members"), (F.min("exact_key") == F.max("exact_key")).alias("one"))
    ends = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).groupBy("id").agg(F.count("*").alias("links"))
    own = labels.join(size, "label").join(ends, "id").join(prints, "id")
    first = prints.select(F.col("id").alias("label"), F.col("exact_key").alias("first_key"), F.col("value").alias("first_value"))
    called = lambda same: F.when(same, "exact").otherwise("near")
    method, group_method = called(F.col("exact_key") == F.col("first_key")), called(F.col("one"))
    return own.join(first, "label").select("id", F.col("label").alias("group"), "members", "links", group_method.alias("group_method"), method.alias("method"), hamming_similarity(F.col("value"), F.col("first_value")).alias("similarity"))


def smallest_labels(links: DataFrame) -> DataFrame:
    """(id, label): the smallest id of each component; labels spread along links and are written each round."""
    both = written(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).toDF("id", "other"), "labels")
    labels = written(both.groupBy("id").agg(F.least(F.first("id"), F.min("other")).alias("label")), "labels")
    while True:
        around = both.join(sorted_in(labels.select(F.col("id").alias("other"), "label")), "other").groupBy("id").agg(F.min("label").alias("near"))
        stepped = labels.join(sorted_in(around), "id", "left").select("id", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        jumped = stepped.join(sorted_in(labels.select(F.col("id").alias("new"), F.col("label").alias("further"))), "new", "left")
        now = written(jumped.select("id", F.col("label").alias("old"), F.least("new", F.coalesce("further", "new")).alias("label")), "labels")
        if now.where("old <> label").isEmpty():
            return now.select("id", "label")
        labels = now.select("id", "label")
