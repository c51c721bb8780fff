"""Reports: ordered, tabbed and packed outputs, written by Spark; single files only for small summaries."""

from __future__ import annotations

import hashlib
import json
import os
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webstrata.storage import written

#: Report orders by name.
ORDERS = {
    "score": lambda: [F.desc("score"), F.asc("timestamp"), F.asc("doc_id")],
    "oldest": lambda: [F.asc("timestamp"), F.asc("doc_id")],
    "newest": lambda: [F.desc("timestamp"), F.desc("doc_id")],
    "url": lambda: [F.asc("url"), F.asc("timestamp"), F.asc("doc_id")],
}


def flat(text: Column) -> Column:
    """Tabs and line ends as spaces, null as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\t\r\n]+", " ")


def write_tsv(rows: DataFrame, path: str, order: list[Column] | None = None) -> None:
    """A folder of tab-separated parts in global order."""
    out = rows.select(*[flat(F.col(c)).alias(c) for c in rows.columns]) if order is None else rows.orderBy(*order).select(*[flat(F.col(c)).alias(c) for c in rows.columns])
    out.write.mode("overwrite").csv(path, sep="\t", header=True, quote="", escape="")


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def markdown_lines(rows: DataFrame, title: str) -> DataFrame:
    """(line): a table in Markdown, a row for each row."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.replace(flat(F.col(c)), F.lit("|"), F.lit("\\|")) for c in rows.columns]), F.lit(" |"))
    head = rows.sparkSession.createDataFrame([(f"# {title}",), ("",), ("| " + " | ".join(rows.columns) + " |",), ("|" + " --- |" * len(rows.columns),)], "line string")
    return head.unionByName(rows.select(cells.alias("line")))


def atomic_text(path: str, text: str) -> None:
    """A small file, there in full or not at all."""
    part = Path(f"{path}.part")
    part.write_text(text, encoding="utf-8")
    os.replace(part, path)


def summary(rows: dict[str, DataFrame]) -> str:
    """JSON of one-row aggregates by name."""
    return json.dumps({k: (v.first().asDict() if not v.isEmpty() else {}) for k, v in rows.items()}, sort_keys=True, default=str)


def pack(folder: str, target: str) -> str:
    """The files of a local report folder as a ZIP with a manifest of digests; the archive's path."""
    files = sorted(p for p in Path(folder).rglob("*") if p.is_file() and not p.name.startswith((".", "_")))
    with zipfile.ZipFile(f"{target}.part", "w", zipfile.ZIP_DEFLATED) as z:
        manifest = {}
        for p in files:
            manifest[str(p.relative_to(folder))] = hashlib.sha256(p.read_bytes()).hexdigest()
            z.write(p, p.relative_to(folder))
        z.writestr("manifest.json", json.dumps(manifest, indent=1, sort_keys=True))
    os.replace(f"{target}.part", target)
    return target


def inventory(captures: DataFrame, documents: DataFrame, routed: DataFrame, key: str = "capture_id") -> DataFrame:
    """Captures with their coverage: saved, or why not."""
    joined = captures.join(documents.select(key, F.lit(True).alias("__saved")), key, "left").join(routed.select(key, "routing"), key, "left")
    state = F.when(F.col("__saved"), "saved").when(F.col("routing").isNotNull(), F.concat(F.lit("skipped:"), F.col("routing"))).otherwise("pending")
    return joined.withColumn("coverage", state).drop("__saved")


def digest_of(rows: DataFrame) -> DataFrame:
    """(n, digest): number of rows and a digest that does not depend on their order, to tell whether a report changed."""
    return rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).cast("string").alias("digest"))


def ranked_matches(matches: DataFrame, *, least: int = 1, top: int | None = None) -> DataFrame:
    """Matches that count, best first, with their rank; ``top`` keeps the first ones only, which is the feature then.

    Ranks come from the sorted parts and the sizes of the parts before, so no single task numbers all rows.
    """
    kept = matches.where((F.col("score") >= least) & ~F.col("excluded") & ~F.col("required_missing"))
    if top is not None:
        first = kept.orderBy(*ORDERS["score"]()).limit(top)
        return first.withColumn("rank", F.row_number().over(Window.orderBy(*ORDERS["score"]())))  # at most top rows
    order = ORDERS["score"]()
    dealt = written(kept.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()), "ranked")
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))  # a row for each part
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.join(F.broadcast(before), "__part").withColumn("rank", (F.col("__before") + inside).cast("int")).drop("__part", "__before")


def first_seen(rows: DataFrame, value: Column, order: str = "score") -> DataFrame:
    """(value): each value once, in the order in which a report first shows it."""
    keyed = rows.select(value.alias("value"), "score", "timestamp", "doc_id", "url")
    keys = {"score": [(-F.col("score")).alias("k"), "timestamp", "doc_id"], "oldest": ["timestamp", "doc_id"], "newest": ["timestamp", "doc_id"], "url": ["url", "timestamp", "doc_id"]}[order]
    best = keyed.groupBy("value").agg((F.max if order == "newest" else F.min)(F.struct(*keys)).alias("b"))
    return best.orderBy(F.desc("b") if order == "newest" else F.asc("b")).select("value")


def interesting_links(links: DataFrame, rules: list, source: str, link: str, searched=None) -> DataFrame:
    """(source, link): distinct links to media and archives, or that a positive rule finds, in order."""
    from webstrata.functions.text import extension_of
    from webstrata.operators.classify import ARCHIVE, IMAGE, VIDEO
    from webstrata.operators.keyword_scan import prefilter

    form = (searched or F.lower)(F.col(link))
    suffix = extension_of(F.col(link))
    positive = [r for r in rules if r.kind != "excluded"]
    named = prefilter(positive, {"url": F.col(link), "form": form}) if positive else F.lit(False)
    return links.where(suffix.isin(*ARCHIVE, *IMAGE, *VIDEO) | named).select(F.col(source).alias("source_url"), F.col(link).alias("link")).distinct().orderBy("source_url", "link")


def comparison(compared: DataFrame, details: DataFrame, key: str) -> DataFrame:
    """(section, place, line) of a comparison of two runs: totals, changes of scores by size, and what only one run has, in order.

    Order by section and place for the text; the places of a section are its sort keys as one string of digits.
    """
    rows = compared.join(details, key, "left")
    tail = F.concat_ws("\t", flat(F.col("timestamp")), flat(F.col("url")), F.coalesce(F.nullif(flat(F.col("title")), F.lit("")), F.lit("(untitled)")))
    ident = F.lpad(F.col(key).cast("string"), 20, "0")
    delta = F.col("delta")
    change = F.concat_ws("\t", F.format_string("delta=%+d", delta), F.format_string("first=%d", "score_a"), F.format_string("second=%d", "score_b"), tail)
    both = rows.where("bucket = 'both'").select(F.lit(1).alias("section"), F.concat(F.lpad((F.lit(10**9) - F.abs(delta)).cast("string"), 10, "0"), ident).alias("place"), change.alias("line"))
    only = [rows.where(F.col("bucket") == b).select(F.lit(k).alias("section"), ident.alias("place"), F.concat_ws("\t", F.col(s).cast("string"), tail).alias("line")) for k, b, s in ((2, "only_a", "score_a"), (3, "only_b", "score_b"))]
    names = {"both": "Documents in both", "only_a": "Only in first", "only_b": "Only in second"}
    heads = F.array(*[F.struct(F.lit(k).alias("place"), F.concat(F.lit(f"{name}: "), F.format_number(F.count_if(F.col("bucket") == b), 0)).alias("line")) for k, (b, name) in enumerate(names.items())])
    totals = compared.agg(heads.alias("h")).select(F.explode("h").alias("h")).select(F.lit(0).alias("section"), F.col("h.place").cast("string").alias("place"), "h.line")
    return totals.unionByName(both).unionByName(only[0]).unionByName(only[1])
