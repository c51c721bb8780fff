"""Merges of whole collections: identities are carried along foreign keys, conflicts stop everything before a table is written.

A table has a natural key, which may hold foreign keys. Tables are taken in the order of their foreign keys: the other
collection's keys are put into own numbers by the maps of the tables before, then its rows meet own rows by natural key. Rows that
both have keep the own number; new ones get theirs behind the largest own one. So a second merge of the same collection adds nothing.

Null parts of a natural key agree with each other; rows of one natural key within a collection are one row (its smallest number). A
foreign key to a row that is not there, and different known digests under one key, are conflicts.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.storage import complete_numbers, written


@dataclass(frozen=True)
class Table:
    """A table of a collection. id: its number, None for facts without one; refs: table by foreign key column; digest: of the body."""

    name: str
    key: tuple[str, ...]
    id: str | None = None
    refs: dict[str, str] = field(default_factory=dict)
    digest: str | None = None


class MergeConflict(ValueError):
    """Conflicts between two collections; ``rows`` are (table, key, own, other)."""

    def __init__(self, rows: DataFrame, n: int):
        super().__init__(f"{n} conflicts; nothing was merged")
        self.rows = rows


def in_order(tables: list[Table]) -> list[Table]:
    """Tables behind those that they refer to."""
    by = {t.name: t for t in tables}
    return [by[n] for n in TopologicalSorter({t.name: set(t.refs.values()) - {t.name} for t in tables}).static_order()]


def _same(a: DataFrame, b: DataFrame, columns) -> F.Column:
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[f"own_{c}"]) for c in columns])


def _key_text(t: Table) -> F.Column:
    return F.to_json(F.struct(*t.key))


def merged(own: dict[str, DataFrame], other: dict[str, DataFrame], tables: list[Table]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The merged tables, and the conflicts (table, key, own, other). Intermediate results are written, the tables are not."""
    maps: dict[str, DataFrame] = {}
    out, conflicts = {}, []
    for t in in_order(tables):
        mine, theirs = own[t.name], other[t.name].select(*own[t.name].columns)
        if t.id:
            theirs = theirs.withColumn("__number", F.col(t.id))
        for column, target in t.refs.items():
            known = maps[target].select(F.col("other_id").alias(column), F.col("id").alias("__new"))
            theirs = theirs.join(known, column, "left")
            lost = theirs.where(F.col(column).isNotNull() & F.col("__new").isNull())
            conflicts.append(lost.select(F.lit(t.name).alias("table"), _key_text(t).alias("key"), F.lit(None).cast("string").alias("own"), F.concat(F.lit(f"no row of {target}: "), F.col(column).cast("string")).alias("other")))
            theirs = theirs.where(F.col(column).isNull() | F.col("__new").isNotNull()).withColumn(column, F.col("__new")).drop("__new")
        theirs = written(theirs, t.name)
        first = theirs.groupBy(*t.key).agg(F.min_by(F.struct(*theirs.columns), "__number" if t.id else F.struct(*mine.columns)).alias("__r")).select("__r.*")
        held = mine.select(*[F.col(c).alias(f"own_{c}") for c in dict.fromkeys([*t.key, *([t.id] if t.id else []), *([t.digest] if t.digest else [])])])
        if t.id:
            held = held.groupBy(*[f"own_{c}" for c in t.key]).agg(*[F.min_by(f"own_{c}", f"own_{t.id}").alias(f"own_{c}") for c in dict.fromkeys([t.id, *([t.digest] if t.digest else [])]) if c not in t.key])
        joined = written(first.join(held, _same(first, held, t.key), "left"), t.name) if t.id else first
        if t.digest:
            apart = joined.where(F.col(f"own_{t.id}").isNotNull() & (F.col(f"own_{t.digest}") != F.col(t.digest)))
            conflicts.append(apart.select(F.lit(t.name).alias("table"), _key_text(t).alias("key"), F.col(f"own_{t.digest}").cast("string").alias("own"), F.col(t.digest).cast("string").alias("other")))
        if t.id:
            top = mine.agg(F.max(t.id)).first()[0] or 0
            placed = joined.withColumn("__id", F.coalesce(f"own_{t.id}", F.lit(top) + F.col("__number")))
            added = placed.where(F.col(f"own_{t.id}").isNull()).withColumn(t.id, F.col("__id")).select(*mine.columns)
            renamed = placed.select(*[F.col(c).alias(f"own_{c}") for c in t.key], "__id")
            maps[t.name] = written(theirs.join(renamed, _same(theirs, renamed, t.key)).select(F.col("__number").alias("other_id"), F.col("__id").alias("id")), f"{t.name}-map")
        else:
            held = held.distinct()
            added = first.join(held, _same(first, held, t.key), "left_anti").select(*mine.columns)
        out[t.name] = mine.unionByName(added)
    none = own[tables[0].name].sparkSession.createDataFrame([], "table string, key string, own string, other string")
    return out, reduce(lambda a, b: a.unionByName(b), conflicts, none)


def merge(own: dict[str, DataFrame], other: dict[str, DataFrame], tables: list[Table], path: str) -> dict[str, DataFrame]:
    """Merge and write the tables as one generation below a path; its manifest is written last. Raises ``MergeConflict`` before any of it."""
    spark = own[tables[0].name].sparkSession
    out, conflicts = merged(own, other, tables)
    conflicts = written(conflicts, "conflicts")
    n = conflicts.count()
    if n:
        raise MergeConflict(conflicts, n)
    done = complete_numbers(spark, path, "manifest")
    number = done[-1] + 1 if done else 0
    for name, rows in out.items():
        rows.write.mode("overwrite").parquet(f"{path}/generation={number}/{name}")
    spark.createDataFrame([(json.dumps(sorted(out)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest={number}")
    return current(spark, path)


def current(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the newest whole generation."""
    done = complete_numbers(spark, path, "manifest")
    names = json.loads(spark.read.text(f"{path}/manifest={done[-1]}").first().value) if done else []
    return {n: spark.read.parquet(f"{path}/generation={done[-1]}/{n}") for n in names}
