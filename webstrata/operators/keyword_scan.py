"""Keyword rules and scans: a line syntax for rules, and scores as column expressions over the fields of documents."""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass
from functools import reduce
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, StructType

from webstrata.functions.slices import sliced
from webstrata.functions.text import clean_space, literal_count
from webstrata.storage import once

#: Prefixes of rule lines, weights of fields, and word window.
KINDS = {
    "required": "required", "require": "required", "optional": "optional", "high": "optional", "exclude": "excluded",
    "excluded": "excluded", "negative": "excluded", "exact": "exact", "regex": "regex", "re": "regex",
}
FIELD_WEIGHTS = {"url": 6.0, "title": 5.0, "body": 1.0, "source": 0.75, "links": 2.5}
PROXIMITY_WORDS = 25
SENTENCES = r"(?<=[.!?])\s+|[\r\n]+"
PARAGRAPHS = r"(?i)(?:\r?\n){2,}|</p\s*>|<br\s*/?>\s*<br\s*/?>"


@dataclass(frozen=True)
class Rule:
    """One keyword rule."""

    label: str
    expression: str
    kind: str = "optional"
    weight: float = 1.0
    case_sensitive: bool = False
    whole_word: bool = False

    def __post_init__(self):
        if self.kind not in set(KINDS.values()):
            raise ValueError(f"no rule kind {self.kind!r}")
        if not self.expression.strip():
            raise ValueError("a rule has no expression")
        object.__setattr__(self, "weight", min(100.0, max(0.0, float(self.weight))))

    @property
    def pattern(self) -> str:
        """As a Java regular expression over the searched form of a field."""
        if self.kind == "regex":
            return self.expression if self.case_sensitive else f"(?iu){self.expression}"
        text = self.expression if self.case_sensitive else simple_form(self.expression)
        body = r"\s+".join(re.escape(part) for part in text.split(" "))
        body = rf"(?<!\w){body}(?!\w)" if self.whole_word else body
        return ("(?U)" if self.case_sensitive else "(?iU)") + body

    def count(self, original: Column, searched: Column) -> Column:
        """Occurrences in a field."""
        if self.kind == "regex" and not self.case_sensitive:
            return F.greatest(F.regexp_count(searched, F.lit(self.pattern)), F.regexp_count(original, F.lit(self.pattern)))
        text = original if self.case_sensitive else searched
        if self.kind in ("optional", "required", "excluded", "exact") and not self.whole_word and " " not in self.expression and self.expression.isascii():
            return literal_count(text, self.expression if self.case_sensitive else self.expression.lower())
        return F.regexp_count(text, F.lit(self.pattern))

    def found(self, text: Column) -> Column:
        return F.rlike(text, F.lit(self.pattern))


def simple_form(text: str) -> str:
    return " ".join(text.casefold().replace("_", " ").split())


def parse_rule(line: str) -> Rule | None:
    """``prefix: expression | option | option``; None for comments and empty lines."""
    line = line.strip()
    if not line or line[0] == "#":
        return None
    head, *options = [p.strip() for p in re.split(r"\s\|\s", line)]
    prefix, colon, rest = head.partition(":")
    known = KINDS.get(prefix.strip().lower().replace(" ", "_")) if colon and rest.strip() else None
    made = {"kind": known or "optional", "expression": rest.strip() if known else head}
    if known and prefix.strip().lower() == "high":
        made["weight"] = 3.0
    made["label"] = made["expression"]
    for option in filter(None, options):
        name, _, value = (x.strip() for x in option.partition("="))
        name = name.lower()
        if name in ("case", "case_sensitive", "casesensitive"):
            made["case_sensitive"] = True
        elif name in ("whole", "whole_word", "wholeword"):
            made["whole_word"] = True
        elif name == "weight":
            made["weight"] = float(value)
        elif name == "label":
            made["label"] = value or made["label"]
        elif name == "type":
            made["kind"] = value.lower()
        else:
            raise ValueError(f"no rule option {option!r}")
    if made["kind"] == "exact":
        made["whole_word"] = False
    return Rule(**made)


def parse_rules(lines: Iterable[str | dict | Rule]) -> list[Rule]:
    """Rules of several spellings, each once, in their order."""
    made = (x if isinstance(x, Rule) else Rule(**x) if isinstance(x, dict) else parse_rule(x) for x in lines)
    return list(dict.fromkeys(r for r in made if r))


def rules_json(rules: Iterable[Rule]) -> str:
    return json.dumps([asdict(r) for r in rules], sort_keys=True, ensure_ascii=False)


def rule_lines(rules: Iterable[Rule]) -> list[str]:
    """Lines that parse back to the rules."""
    out = []
    for r in rules:
        options = [f"weight={r.weight:g}"] * (r.weight != 1) + ["case"] * r.case_sensitive + ["whole"] * r.whole_word + [f"label={r.label}"] * (r.label != r.expression)
        out.append(" | ".join([("" if r.kind == "optional" else f"{r.kind}: ") + r.expression, *options]))
    return out


def prefilter(rules: Sequence[Rule], fields: dict[str, Column]) -> Column:
    """True where some positive rule may match: an alternation per field, before any counting. True if no rule is positive."""
    positive = [r for r in rules if r.kind != "excluded"]
    if not positive:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a | b, [r.found(c) for r in positive]) for c in fields.values()])


def _segment_bonus(text: Column, splitter: str, rules: Sequence[Rule], searched) -> Column:
    """n (n - 1) for every segment with n labels, two at least."""
    labels = {}
    for r in rules:
        labels.setdefault(r.label, []).append(r)

    def one(segment: Column) -> Column:
        n = sum((reduce(lambda a, b: a | b, [r.found(segment if r.case_sensitive else searched(segment)) for r in own]).cast("int") for own in labels.values()), F.lit(0))
        return F.when(n >= 2, n * (n - 1)).otherwise(0)

    return F.coalesce(F.aggregate(F.transform(F.split(text, splitter), one), F.lit(0), lambda a, x: a + x), F.lit(0))


def _least_gap(a: list[int], b: list[int]) -> int:
    """The least distance between members of two sorted lists, in one walk."""
    i = j = 0
    best = abs(a[0] - b[0])
    while i < len(a) and j < len(b) and best:
        best = min(best, abs(a[i] - b[j]))
        i, j = (i + 1, j) if a[i] < b[j] else (i, j + 1)
    return best


def proximity(body: Column, rules: Sequence[Rule]) -> Column:
    """Pairs of labels whose nearest words are within the window, and the least distance, in an Arrow function."""
    compiled = [(r.label, re.compile(r.pattern.replace("(?iU)", "(?i)").replace("(?U)", "").replace("(?iu)", "(?i)"))) for r in rules]

    @sliced(StructType().add("pairs", IntegerType()).add("minimum_distance", IntegerType()))
    def near(texts: list) -> list:
        rows = []
        for text in texts:
            text = text or ""
            begins = [m.start() for m in re.finditer(r"\S+", text)]
            at: dict[str, list[int]] = {}
            for label, pattern in compiled:
                at.setdefault(label, []).extend(bisect_right(begins, m.start()) - 1 for m in pattern.finditer(text))
            places = [sorted(set(v)) for v in at.values() if v]
            least = [_least_gap(a, b) for a, b in combinations(places, 2)]
            rows.append((sum(d <= PROXIMITY_WORDS for d in least), min(least, default=None)))
        return rows

    return near(body)


def scan(docs: DataFrame, rules: Sequence[Rule], fields: dict[str, tuple[str, str]], *, bonuses: bool = True, searched=None) -> DataFrame:
    """Score documents by rules.

    fields: by field name (of FIELD_WEIGHTS) the original column and its searched form. Per row: all columns and ``hits`` (label
    to count), ``hit_fields`` (label to fields), ``excluded``, ``required_missing``, ``score``. A null field holds nothing.
    """
    searched = searched or (lambda c: clean_space(F.lower(c)))
    counts = [[F.coalesce(rule.count(F.col(a), F.col(b)), F.lit(0)) for a, b in fields.values()] for rule in rules]
    staged = once(docs, __c=F.array(*[F.array(*row) for row in counts]))
    per = lambda k: F.get("__c", F.lit(k))
    total = [F.aggregate(per(k), F.lit(0), lambda a, x: a + x) for k in range(len(rules))]
    part = lambda k, r: sum((F.least(F.get(per(k), F.lit(j)), F.lit(10)) * FIELD_WEIGHTS[name] * r.weight * (2 if r.kind == "exact" else 1) for j, name in enumerate(fields)), F.lit(0.0))
    base = sum((part(k, r) for k, r in enumerate(rules) if r.kind != "excluded"), F.lit(0.0))
    labels = list(dict.fromkeys(r.label for r in rules))
    by_label = {x: sum((total[k] for k, r in enumerate(rules) if r.label == x), F.lit(0)) for x in labels}
    entries = F.array(*[F.struct(F.lit(x).alias("key"), n.alias("value")) for x, n in by_label.items()])
    names = F.array(*map(F.lit, fields))

    def fields_of(x: str) -> Column:
        own = [k for k, r in enumerate(rules) if r.label == x]
        return F.array_sort(F.filter(names, lambda _, j: sum((F.get(per(k), j) for k in own), F.lit(0)) > 0))

    where = [F.struct(F.lit(x).alias("key"), fields_of(x).alias("value")) for x in labels]
    ruled_out = [total[k] > 0 for k, r in enumerate(rules) if r.kind == "excluded"]
    missing = [total[k] == 0 for k, r in enumerate(rules) if r.kind == "required"]
    any_of = lambda xs: reduce(lambda a, b: a | b, xs, F.lit(False))
    out_labels = {r.label for r in rules if r.kind == "excluded"}
    excluded_label = lambda x: any_of([total[k] > 0 for k, r in enumerate(rules) if r.label == x and r.kind == "excluded"])
    distinct = sum((F.when((n > 0) & ~(excluded_label(x) if x in out_labels else F.lit(False)), 1).otherwise(0) for x, n in by_label.items()), F.lit(0))
    rated = staged.withColumns({
        "hits": F.map_from_entries(F.filter(entries, lambda e: e.value > 0)),
        "hit_fields": F.map_from_entries(F.filter(F.array(*where), lambda e: F.size(e.value) > 0)),
        "excluded": any_of(ruled_out), "required_missing": any_of(missing), "__base": base, "__distinct": distinct,
    })
    score = F.col("__base") + F.when(F.col("__distinct") >= 2, 3 * F.col("__distinct")).otherwise(0)
    positive = [r for r in rules if r.kind != "excluded"]
    if bonuses and len(positive) >= 2:
        body, raw = fields["body"][0], fields.get("source", fields["body"])[0]
        matched = sum((F.when(total[k] > 0, 1).otherwise(0) for k, r in enumerate(rules) if r.kind != "excluded"), F.lit(0))
        rated = rated.withColumn("__two", matched >= 2)
        rated = rated.withColumn("proximity", F.when(F.col("__two"), proximity(F.when(F.col("__two"), F.col(fields["body"][1])), positive)))
        more = 4 * _segment_bonus(F.col(body), SENTENCES, positive, searched) + 2 * _segment_bonus(F.col(raw), PARAGRAPHS, positive, searched)
        score = score + F.when(F.col("__two"), more + 6 * F.coalesce(F.col("proximity.pairs"), F.lit(0))).otherwise(0)
    final = F.when(F.col("excluded") | F.col("required_missing") | (score <= 0), 0).otherwise(F.greatest(F.lit(1), F.bround(score)))
    return rated.withColumn("score", final.cast("int")).drop("__c", "__base", "__distinct", "__two")


def keyword_totals(scanned: DataFrame) -> DataFrame:
    """(label, n) over all documents."""
    return scanned.select(F.explode("hits").alias("label", "count")).groupBy("label").agg(F.sum("count").cast("long").alias("n"))


#: Bytes of phrases in one automaton.
PHRASE_BYTES = 8 << 20


def hit_list(docs: DataFrame, phrases: DataFrame, *, id_col: str, text_col: str, phrase_id: str, phrase: str, block_bytes: int = PHRASE_BYTES) -> DataFrame:
    """Literal phrases anywhere in documents: (id, phrase id, n), n without overlaps.

    Phrases form automata of bounded size, sent to all tasks; a longer list is cut into blocks by a hash of the phrase, each of
    which reads the documents once more. Documents are not shuffled.
    """
    spark = docs.sparkSession
    own = phrases.where(F.length(F.trim(phrase)) > 0).select(F.col(phrase_id).alias("pid"), F.col(phrase).alias("phrase"))
    size = own.agg(F.sum(F.octet_length("phrase"))).first()[0] or 0
    blocks = -(-int(size * 1.3) // block_bytes) if size > block_bytes else 1
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kinds = rows.schema["id"].dataType.simpleString(), own.schema["pid"].dataType.simpleString()

    def one(block: DataFrame) -> DataFrame:
        shared = spark.sparkContext.broadcast([(r.pid, r.phrase) for r in block.collect()])  # at most block_bytes

        def run(batches):
            import ahocorasick

            ids: dict[str, list] = {}
            for pid, text in shared.value:
                ids.setdefault(text, []).append(pid)
            machine = ahocorasick.Automaton()
            for text in ids:
                machine.add_word(text, text)
            if ids:
                machine.make_automaton()
            for batch in batches:
                out = []
                for k, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    last, n = {}, {}
                    for end, found in machine.iter(text) if ids and text else ():
                        if last.get(found, -1) <= end - len(found):
                            last[found], n[found] = end, n.get(found, 0) + 1
                    out += [(k, pid, times) for found, times in n.items() for pid in ids[found]]
                types = batch.schema.field("id").type, None, pa.int32()
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t or pids) for k, t in enumerate(types)], names=["id", "pid", "n"])

        pids = to_arrow_type(own.schema["pid"].dataType)
        return rows.mapInArrow(run, f"id {kinds[0]}, pid {kinds[1]}, n int")

    found = reduce(lambda a, b: a.unionByName(b), [one(own.where(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == b)) for b in range(blocks)])
    return found.select(F.col("id").alias(id_col), F.col("pid").alias(phrase_id), "n")


def snippet(text: Column, needle: str, radius: int = 220) -> Column:
    """The first occurrence with its surroundings, white space collapsed, dots where text is left out; null without one."""
    at = F.locate(needle, text)
    begin, end = F.greatest(at - radius, F.lit(1)), F.least(at + len(needle) + radius, F.length(text) + 1)
    cut = clean_space(F.substr(text, begin, end - begin))
    return F.when(at > 0, F.concat(F.when(begin > 1, "…").otherwise(""), cut, F.when(end <= F.length(text), "…").otherwise("")))
