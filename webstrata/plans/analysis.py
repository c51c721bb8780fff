"""Queries: the analysis from end to end, its changed snapshots, and the manifest of an export."""

from __future__ import annotations

from pyspark.sql import functions as F

from webstrata.catalog import ORACLES, query, table
from webstrata.functions.text import simple_search_form
from webstrata.operators import analysis as A
from webstrata.operators import history as H
from webstrata.operators import refresh as RF
from webstrata.operators.tables import snapshots
from webstrata.plans import corpus as Q
from webstrata.storage import new_path

_CHANGED = """SELECT source AS url, earlier, doc_id AS later, coalesce(text, '') <> coalesce(before, '') AS changed
    FROM (SELECT source, doc_id, text, lag(doc_id) OVER w AS earlier, lag(text) OVER w AS before FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)) WHERE earlier IS NOT NULL"""


@query("snapshot_changed", _CHANGED)
def snapshot_changed(spark, sf):
    return H.with_changed(H.snapshot_pairs(snapshots(spark, sf), "url", "doc_id", "text")).select("url", "earlier", "later", "changed")


@query(
    "analysis_totals",
    f"""WITH f AS ({ORACLES["forum_parse"]}), g AS ({ORACLES["duplicate_exact_groups"]}), p AS ({_CHANGED}), e AS ({ORACLES["provenance_edges"]})
    SELECT 'forum_threads' AS name, count(DISTINCT thread)::BIGINT AS n FROM f UNION ALL SELECT 'forum_posts', count(*) FROM f
    UNION ALL SELECT 'extractions', count(DISTINCT conv_id) FROM conversations WHERE text IS NOT NULL
    UNION ALL SELECT 'exact_duplicate_groups', count(DISTINCT digest) FROM g UNION ALL SELECT 'grouped_documents', count(*) FROM g
    UNION ALL SELECT 'snapshot_pairs', count(*) FROM p UNION ALL SELECT 'changed_snapshot_pairs', count(*) FILTER (WHERE changed) FROM p UNION ALL SELECT 'provenance_edges', count(*) FROM e""",
)
def analysis_totals(spark, sf):
    """Documents as snapshots, conversations as pages of a forum; each page yields the number in its URL."""
    return A.totals(A.analysed(snapshots(spark, sf), Q._forum_pages(spark, sf), [("page_number", "url", "[?&]page=([0-9]+)")]))


@query(
    "export_manifest",
    """SELECT (SELECT count(*) FROM pages)::BIGINT AS captures, (SELECT count(*) FILTER (WHERE page_id % 4 = 0) FROM pages)::BIGINT AS unfinished_captures, (SELECT count(*) FROM events)::BIGINT AS media,
    (SELECT count(*) FILTER (WHERE event_type = 'error') FROM events)::BIGINT AS unfinished_media, (SELECT count(*) FROM documents)::BIGINT AS documents, (SELECT count(*) FROM nation)::BIGINT AS checkpoints,
    (SELECT count(*) FILTER (WHERE n_nationkey % 6 = 5) FROM nation)::BIGINT AS unfinished_checkpoints, (SELECT arg_max(r_name, r_regionkey) FROM region) AS mode, 'complete' AS status, FALSE AS complete""",
)
def export_manifest(spark, sf):
    captures = table(spark, sf, "pages").select(F.when(F.col("page_id") % 4 == 0, "downloaded_unscanned").otherwise("downloaded").alias("state"))
    media = table(spark, sf, "events").select(F.col("event_type").alias("state"))
    coverage = table(spark, sf, "nation").select((F.col("n_nationkey") % 6 != 5).alias("complete"))
    operations = table(spark, sf, "region").select(F.col("r_regionkey").alias("sequence"), F.col("r_name").alias("mode"), F.lit("complete").alias("status"))
    return A.manifest(captures, media, table(spark, sf, "documents").select("doc_id"), coverage, operations)


@query(
    "index_refreshed",
    """SELECT doc_id, CASE WHEN doc_id % 97 = 3 AND doc_id % 10 <> 9 THEN 2 ELSE 1 END AS revision, CASE WHEN doc_id % 10 = 9 THEN 2 WHEN doc_id % 97 = 3 THEN 1 ELSE 0 END AS part,
    sha256(trim(regexp_replace(lower(CASE WHEN doc_id % 97 = 3 AND doc_id % 10 <> 9 THEN text || ' revised' ELSE text END), '[\\s_]+', ' ', 'g'))) AS form
    FROM documents WHERE NOT (doc_id % 89 = 5 AND doc_id % 10 <> 9)""",
)
def index_refreshed(spark, sf):
    """The index after three generations: nine tenths of the documents; a hundredth revised and a hundredth gone; the last tenth."""
    d = table(spark, sf, "documents").select("doc_id", F.lit(1).alias("revision"), "text")
    first = d.where("doc_id % 10 <> 9")
    revised = first.where("doc_id % 89 <> 5").withColumns({"revision": F.when(F.col("doc_id") % 97 == 3, 2).otherwise(1), "text": F.when(F.col("doc_id") % 97 == 3, F.concat("text", F.lit(" revised"))).otherwise(F.col("text"))})
    path = new_path(spark, "index")
    for docs in (first, revised, revised.unionByName(d.where("doc_id % 10 = 9"))):
        RF.refresh(docs, path, also={"form": F.sha2(simple_search_form(F.col("text")).cast("binary"), 256)})
    return RF.index_rows(spark, path).select(F.col("id").alias("doc_id"), "revision", "part", "form")
