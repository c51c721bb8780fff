"""The analysis of a collection from end to end, and the manifest that tells how complete an export is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.operators import extract as X
from webstrata.operators import history as H
from webstrata.storage import written

#: States of captures that still need work, of texts and of media.
UNFINISHED_TEXT = ("pending", "error", "downloading", "downloaded_unscanned")
UNFINISHED_MEDIA = ("pending", "error", "downloading")


def analysed(documents: DataFrame, pages: DataFrame, rules: list[tuple[str, str, str]] | None = None) -> dict[str, DataFrame]:
    """The tables of an analysis: posts, extractions, groups of exact copies, pairs of snapshots and edges of provenance.

    documents: (doc_id, url, text), snapshots of a URL in the order of doc_id; pages: (page_id, url, html). Tables that
    others build upon are written once. Near copies are ``history.near_groups``, which takes fingerprints.
    """
    groups = written(H.exact_groups(documents, "doc_id", "text"), "groups")
    return {
        "posts": written(X.posts(pages, "page_id", "url", "html"), "posts"),
        "extractions": X.extractions(pages, "page_id", {"url": "url", "source": "html"}, rules),
        "groups": groups,
        "pairs": written(H.with_changed(H.snapshot_pairs(documents, "url", "doc_id", "text")).select("url", "earlier", "later", "n_added", "n_removed", "changed"), "pairs"),
        "edges": H.provenance(groups, documents, "doc_id", "url"),
    }


def totals(parts: dict[str, DataFrame]) -> DataFrame:
    """(name, n): the numbers of an analysis."""
    asked: dict[str, tuple[str, Column]] = {
        "forum_threads": ("posts", F.count_distinct("thread")), "forum_posts": ("posts", F.count("*")), "extractions": ("extractions", F.count("*")),
        "exact_duplicate_groups": ("groups", F.count_if(F.col("doc_id") == F.col("representative"))), "grouped_documents": ("groups", F.count("*")),
        "snapshot_pairs": ("pairs", F.count("*")), "changed_snapshot_pairs": ("pairs", F.count_if("changed")), "provenance_edges": ("edges", F.count("*")),
    }
    out = None
    for name, (part, number) in asked.items():
        row = parts[part].agg(number.cast("long").alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def manifest(captures: DataFrame, media: DataFrame, documents: DataFrame, coverage: DataFrame, operations: DataFrame) -> DataFrame:
    """One row: the counts of an export and whether it is complete.

    captures and media: (state), coverage: (complete), operations: (sequence, mode, status). Complete needs an index, a last
    operation that ended and was no report, and nothing unfinished; an empty collection is not complete.
    """
    open_text, open_media = F.count_if(F.col("state").isin(*UNFINISHED_TEXT)), F.count_if(F.col("state").isin(*UNFINISHED_MEDIA))
    rows = captures.agg(F.count("*").alias("captures"), open_text.alias("unfinished_captures"))
    others = [
        media.agg(F.count("*").alias("media"), open_media.alias("unfinished_media")), documents.agg(F.count("*").alias("documents")),
        coverage.agg(F.count("*").alias("checkpoints"), F.count_if(~F.coalesce("complete", F.lit(False))).alias("unfinished_checkpoints")),
        operations.agg(F.max_by("mode", "sequence").alias("mode"), F.max_by("status", "sequence").alias("status")),
    ]
    for one in others:
        rows = rows.join(F.broadcast(one))  # a row each
    nothing_left = (F.col("unfinished_captures") + F.col("unfinished_media") + F.col("unfinished_checkpoints")) == 0
    ended = F.coalesce((F.col("status") == "complete") & (F.col("mode") != "report"), F.lit(False))
    return rows.withColumn("complete", nothing_left & ended & (F.col("checkpoints") > 0))
