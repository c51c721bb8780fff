"""Hit lists over several fields, spans of literals, and what a hit list has covered."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from webstrata.functions.slices import sliced
from webstrata.operators.keyword_scan import hit_list, simple_form

SPANS = ArrayType(StructType().add("literal", StringType()).add("start", IntegerType()).add("end", IntegerType()))


def phrase_list(lines: DataFrame, position: str, phrase: str) -> DataFrame:
    """(position, phrase): each phrase once by its form without case and spacing, as first spelt; blank lines and comments are left out."""
    form = F.trim(F.regexp_replace(F.lower(phrase), r"[\s_]+", " "))
    kept = lines.where((F.trim(phrase) != "") & ~F.startswith(F.trim(phrase), F.lit("#")))
    first = kept.groupBy(form.alias("__form")).agg(F.min(F.struct(F.col(position).alias("position"), F.trim(phrase).alias("phrase"))).alias("f"))
    return first.select("f.position", "f.phrase")


def field_hits(docs: DataFrame, phrases: DataFrame, fields: dict[str, str], *, id_col: str, phrase_id: str, phrase: str) -> DataFrame:
    """(id, phrase id, fields, counts): the fields that hold a literal phrase, in their order, and how often each does.

    Documents are read once for all fields and are not shuffled; only hits are.
    """
    each = F.array(*[F.struct(F.lit(k).alias("field"), F.col(c).alias("text")) for k, c in enumerate(fields.values())])
    rows = docs.select(F.col(id_col).alias("__id"), F.explode(each).alias("f")).select(F.struct("__id", "f.field").alias("key"), F.col("f.text").alias("text")).where("text is not null")
    found = hit_list(rows, phrases, id_col="key", text_col="text", phrase_id=phrase_id, phrase=phrase)
    names = F.array(*map(F.lit, fields))
    hits = F.sort_array(F.collect_list(F.struct("key.field", "n"))).alias("h")
    grouped = found.groupBy(F.col("key.__id").alias(id_col), phrase_id).agg(hits)
    return grouped.select(id_col, phrase_id, F.transform("h.field", lambda k: F.get(names, k)).alias("fields"), F.col("h.n").alias("counts"))


def spans(text: Column, literals: Sequence[str], *, overlapping: bool = True) -> Column:
    """array of (literal, start, end) of the literals in a text: all of them, or from the left without overlaps, shorter ones first."""
    wanted = [x for x in dict.fromkeys(literals) if x]

    @sliced(SPANS)
    def find(texts: list) -> pa.Array:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for literal in wanted:
            machine.add_word(literal, literal)
        if wanted:
            machine.make_automaton()
        ends, starts, lasts, own = [0], [], [], []
        for value in texts:
            found = sorted([(last + 1 - len(x), last + 1, x) for last, x in (machine.iter(value) if value and wanted else ())])
            free = 0
            for start, end, x in found:
                if overlapping or start >= free:
                    free = end
                    starts.append(start)
                    lasts.append(end)
                    own.append(x)
            ends.append(len(own))
        kind = to_arrow_type(SPANS)
        rows = pa.StructArray.from_arrays([pa.array(own, pa.string()), pa.array(starts, pa.int32()), pa.array(lasts, pa.int32())], fields=list(kind.value_type))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows, type=kind)

    return find(text)


def availability(payload: Column, resource_class: Column, has_file: Column) -> Column:
    """Why a capture's body can't be searched: discarded, partial, non_text or missing; null if it can."""
    state = F.coalesce(payload, F.lit("not_acquired"))
    return (
        F.when(state.isin("discarded", "partial"), state)
        .when(F.coalesce(resource_class, F.lit("unknown")).isin("image", "video", "audio", "other_binary"), "non_text")
        .when(~F.coalesce(has_file, F.lit(False)), "missing")
    )


def coverage_print(metadata: Sequence[Column], body: Column, version: int = 1) -> Column:
    """Digest of what a search saw of a capture: its metadata, the rules' version and the identity of its body."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in metadata]
    return F.sha2(F.to_json(F.array(*parts, F.lit(f"v{version}"), F.coalesce(body, F.lit("missing")))).cast("binary"), 256)


def to_search_again(covered: DataFrame, now: DataFrame, key: str, prints: str) -> DataFrame:
    """(key) whose fingerprint is another than the covered one, or that was not covered."""
    old = covered.select(key, F.col(prints).alias("__old"))
    return now.join(old, key, "left").where(~F.col(prints).eqNullSafe(F.col("__old"))).select(key)


def window_snippet(text: str | Column, words: Sequence[str], searched=None, limit: int = 520) -> Column:
    """A cut of ``limit`` characters around the first word of a query (words of three letters and more), a third of it before; from the start without one."""
    text = F.col(text) if isinstance(text, str) else text
    clean = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    form = (searched or F.lower)(clean)
    places = F.filter(F.array(*[F.instr(form, simple_form(w)) - 1 for w in words if len(w) > 2]).cast("array<int>"), lambda p: p >= 0)
    begin = F.greatest(F.coalesce(F.array_min(places), F.lit(0)) - limit // 3, F.lit(0))
    end = F.least(F.length(clean), begin + limit)
    cut = F.concat(F.when(begin > 0, "…").otherwise(""), F.substr(clean, begin + 1, end - begin), F.when(end < F.length(clean), "…").otherwise(""))
    return F.when(F.length(clean) > 0, cut).otherwise("")
