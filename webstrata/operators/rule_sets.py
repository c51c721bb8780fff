"""Scans by large sets of keyword rules: one automaton for all rules tells which of them a document can match at all.

Every rule has a text that each of its matches holds: the longest run of ASCII letters, digits and signs of a literal, or of
the parts that a pattern cannot do without. One pass of an automaton over a document's fields finds these texts; only the rules of
texts that are there are then counted, with word borders, case and patterns as they are. Rules without such a text are always
counted. The plan has one Arrow function and the score's columns, whatever the number of rules; results are those of
``keyword_scan.scan``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import combinations
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StructType

from webstrata.functions.slices import sliced
from webstrata.operators.automaton import Automaton, fits
from webstrata.operators.keyword_scan import FIELD_WEIGHTS, PARAGRAPHS, PROXIMITY_WORDS, SENTENCES, Rule, _least_gap, rules_json
from webstrata.storage import once

#: Bytes of a rule set, which is sent to all tasks.
RULE_BYTES = 16 << 20
#: With fewer texts than this, looking for each is faster than the automaton.
FEW = 48
#: Letters whose case folds to an ASCII letter.
_FOLDED = str.maketrans({"ı": "i", "ſ": "s", "K": "k"})


_ODD_SPACE = re.compile(r"[^\S ]|  ")
_SEPARATED = re.compile(r"[\s_]+")
_SPACE = re.compile(r"\s+")
#: What matches an ASCII letter without being one in lower case.
_OTHER_CASE = re.compile("[A-ZİıſK]")


def folded(text: str) -> str:
    return text.lower().translate(_FOLDED)


def required_text(rule: Rule) -> str:
    """The longest run of ASCII characters that every match of the rule holds, folded; empty if there is none."""
    runs: list[str] = []

    def walk(items) -> None:
        run = ""
        for op, value in items:
            if op is _parser.LITERAL and 32 < value < 128:
                run += chr(value)
                continue
            runs.append(run)
            run = ""
            if op is _parser.SUBPATTERN:
                walk(value[3])
            elif op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT) and value[0] >= 1:
                walk(value[2])
        runs.append(run)

    if rule.kind == "regex":
        walk(_parser.parse(rule.expression))
    else:
        runs = re.findall(r"[!-~]+", rule.expression if rule.case_sensitive else " ".join(rule.expression.casefold().replace("_", " ").split()))
    return folded(max(runs, key=len, default=""))


class RuleSet:
    """Rules ready to be counted; made once in each task."""

    def __init__(self, rules: Sequence[Rule]):
        import ahocorasick

        self.rules = list(rules)
        self.compiled = [re.compile(re.sub(r"^\(\?[iuU]+\)", "", r.pattern) if r.kind != "regex" else r.expression, 0 if r.case_sensitive else re.IGNORECASE) for r in self.rules]
        self.literal = [
            (r.expression if r.case_sensitive else r.expression.lower()) if r.kind != "regex" and not r.whole_word and " " not in r.expression and r.expression.isascii() else None
            for r in self.rules
        ]
        #: Of several words: as they stand in plain text, that is ASCII with single spaces.
        self.phrase = [None if r.kind == "regex" or r.whole_word or r.case_sensitive or not r.expression.isascii() else " ".join(r.expression.lower().replace("_", " ").split()) for r in self.rules]
        self.by_text: dict[str, list[int]] = {}
        for k, r in enumerate(self.rules):
            self.by_text.setdefault(required_text(r), []).append(k)
        self.always = self.by_text.pop("", [])
        self.required = [k for k, r in enumerate(self.rules) if r.kind == "required"]
        self.machine = None
        if len(self.by_text) > FEW:
            self.machine = ahocorasick.Automaton()
            for text in self.by_text:
                self.machine.add_word(text, text)
            self.machine.make_automaton()
        #: What is counted as it stands, and by one automaton for all: literals in any text, phrases in plain text.
        self.exact = [None if r.kind == "regex" or r.case_sensitive else a or b for r, a, b in zip(self.rules, self.literal, self.phrase, strict=True)]
        self.counter = None
        if self.machine and any(self.exact):
            self.counter = ahocorasick.Automaton()
            for text in {t for t in self.exact if t}:
                self.counter.add_word(text, text)
            self.counter.make_automaton()

    def candidates(self, texts: list[str]) -> list[int]:
        """Rules that can match one of the texts, in order."""
        found: set[str] = set()
        for text in texts:
            text = folded(text)
            if self.machine:
                found.update(t for _, t in self.machine.iter(text))
            else:
                found.update(t for t in self.by_text if t in text)
        return sorted([*self.always, *(k for t in found for k in self.by_text[t])])

    def count(self, k: int, original: str | None, searched: str | None, plain: bool = False) -> int:
        """Occurrences of a rule in a field, given in both forms; plain: the searched form is ASCII in lower case with single spaces."""
        rule, pattern = self.rules[k], self.compiled[k]
        times = lambda text: 0 if text is None else sum(1 for _ in pattern.finditer(text))
        if rule.kind == "regex" and not rule.case_sensitive:
            return max(times(searched), times(original)) if searched is not None and original is not None else 0
        text = original if rule.case_sensitive else searched
        if text is None:
            return 0
        literal = self.literal[k] or (self.phrase[k] if plain else None)
        return text.count(literal) if literal else times(text)

    def occurrences(self, text: str | None) -> dict[str, int]:
        """How often each of ``exact`` is in a text, without overlap from the left, as ``str.count`` has it; in one pass."""
        n: dict[str, int] = {}
        last: dict[str, int] = {}
        for end, found in self.counter.iter(text or ""):
            if found not in last or end - last[found] >= len(found):
                last[found] = end
                n[found] = n.get(found, 0) + 1
        return n

    def counts(self, originals: list[str | None], searched: list[str | None]) -> dict[int, list[int]]:
        """By rule the occurrences in each field, for the rules that occur."""
        plain = [t is not None and t.isascii() and t == t.lower() and not _ODD_SPACE.search(t) for t in searched]
        candidates = self.candidates([t for t in {*originals, *searched} if t])
        if not self.counter:
            made = {k: [self.count(k, a, b, p) for a, b, p in zip(originals, searched, plain, strict=True)] for k in candidates}
            return {k: c for k, c in made.items() if any(c)}
        known = [self.occurrences(t) for t in searched]
        # a phrase can match only where it stands in the text with single spaces
        single = [None if p or t is None else self.occurrences(_SEPARATED.sub(" ", folded(t))) for t, p in zip(searched, plain, strict=True)]
        made = {}
        for k in candidates:
            exact, literal, c = self.exact[k], self.literal[k], []
            for a, b, p, n, s in zip(originals, searched, plain, known, single, strict=True):
                if exact and (literal or p):
                    c.append(n.get(exact, 0))
                else:
                    c.append(0 if exact and s is not None and exact not in s else self.count(k, a, b, p))
            if any(c):
                made[k] = c
        return made

    def segments(self, text: str | None, splitter: str, of: list[int]) -> int:
        """n (n - 1) for every segment with n labels of these rules, two at least."""
        bonus = 0
        for segment in re.split(splitter, text or ""):
            plain = " ".join(segment.lower().split())
            n = len({self.rules[k].label for k in of if self.compiled[k].search(segment if self.rules[k].case_sensitive else plain)})
            bonus += n * (n - 1)
        return bonus

    def proximity(self, text: str | None, of: list[int]) -> tuple[int, int | None]:
        """Pairs of labels whose nearest words are within the window, and the least distance."""
        from bisect import bisect_right

        begins = [m.start() for m in re.finditer(r"\S+", text or "")]
        at: dict[str, set[int]] = {}
        for k in of:
            at.setdefault(self.rules[k].label, set()).update(bisect_right(begins, m.start()) - 1 for m in self.compiled[k].finditer(text or ""))
        least = [_least_gap(a, b) for a, b in combinations([sorted(v) for v in at.values() if v], 2)]
        return sum(d <= PROXIMITY_WORDS for d in least), min(least, default=None)


_RESULT = pa.struct([
    ("hits", pa.map_(pa.string(), pa.int32())), ("hit_fields", pa.map_(pa.string(), pa.list_(pa.string()))), ("excluded", pa.bool_()), ("required_missing", pa.bool_()), ("base", pa.float64()), ("labels", pa.int32()),
    ("proximity", pa.struct([("pairs", pa.int32()), ("minimum_distance", pa.int32())])), ("near", pa.int32()),
])
_DDL = (
    "struct<hits:map<string,int>,hit_fields:map<string,array<string>>,excluded:boolean,required_missing:boolean,base:double,labels:int,proximity:struct<pairs:int,minimum_distance:int>,near:int>"
)


def _rated(rules: RuleSet, names: list[str], originals: list[str | None], searched: list[str | None], bonuses: bool) -> dict:
    counts = rules.counts(originals, searched)
    hits: dict[str, int] = {}
    where: dict[str, list[int]] = {}
    base, out, out_labels = 0.0, False, set()
    for k, per in counts.items():
        rule = rules.rules[k]
        hits[rule.label] = hits.get(rule.label, 0) + sum(per)
        where[rule.label] = [a + b for a, b in zip(where.get(rule.label, [0] * len(per)), per, strict=True)]
        if rule.kind == "excluded":
            out = True
            out_labels.add(rule.label)
        else:
            part = 0.0
            for n, name in zip(per, names, strict=True):
                part += min(n, 10) * FIELD_WEIGHTS[name] * rule.weight * (2 if rule.kind == "exact" else 1)
            base += part
    matched = [k for k in counts if rules.rules[k].kind != "excluded"]
    near, pairs = 0, None
    if bonuses and len(matched) >= 2:
        body = names.index("body")
        source = originals[names.index("source")] if "source" in names else originals[body]
        positive = [k for k in rules.candidates([t for t in (originals[body], searched[body], source) if t]) if rules.rules[k].kind != "excluded"]
        pairs = rules.proximity(searched[body], positive) if searched[body] is not None else (0, None)
        near = 4 * rules.segments(originals[body], SENTENCES, positive) + 2 * rules.segments(source, PARAGRAPHS, positive) + 6 * pairs[0]
    return {
        "hits": list(hits.items()), "hit_fields": [(x, sorted(name for n, name in zip(per, names, strict=True) if n)) for x, per in where.items()], "excluded": out,
        "required_missing": any(k not in counts for k in rules.required), "base": base, "labels": sum(x not in out_labels for x in hits),
        "proximity": None if pairs is None else {"pairs": pairs[0], "minimum_distance": pairs[1]}, "near": near,
    }


def _score(r: Column, near: Column) -> Column:
    score = r.base + F.when(r.labels >= 2, 3 * r.labels).otherwise(0) + near
    return F.when(r.excluded | r.required_missing | (score <= 0), 0).otherwise(F.greatest(F.lit(1), F.bround(score))).cast("int")


def scan(docs: DataFrame, rules: Sequence[Rule], fields: dict[str, tuple[str, str]], *, bonuses: bool = True) -> DataFrame:
    """As ``keyword_scan.scan``, for any number of rules up to ``RULE_BYTES``; ``proximity`` comes with ``bonuses`` only.

    fields: by field name the original column and its searched form. A null field holds nothing; without rules every score is 0.
    """
    if len(rules_json(rules)) > RULE_BYTES:
        raise ValueError(f"a rule set of more than {RULE_BYTES} bytes; cut it into several")
    names, held = list(fields), list(rules)
    forms = list(dict.fromkeys(c for pair in fields.values() for c in pair))
    places = [(forms.index(a), forms.index(b)) for a, b in fields.values()]
    ready: list[RuleSet] = []

    @F.arrow_udf(_DDL)
    def rate(*columns: pa.Array) -> pa.Array:
        if not ready:
            ready.append(RuleSet(held))
        rows = zip(*(c.to_pylist() for c in columns), strict=True)
        return pa.array([_rated(ready[0], names, [r[a] for a, _ in places], [r[b] for _, b in places], bonuses) for r in rows], _RESULT)

    rated = once(docs, __r=rate(*[F.col(f"`{c}`").cast("string") for c in forms]))
    r = F.col("__r")
    extra = [r.proximity.alias("proximity")] if bonuses and sum(x.kind != "excluded" for x in held) >= 2 else []
    return rated.select(*[F.col(f"`{c}`") for c in docs.columns], r.hits.alias("hits"), r.hit_fields.alias("hit_fields"), r.excluded.alias("excluded"), r.required_missing.alias("required_missing"), *extra, _score(r, r.near).alias("score"))


_TOTALS = StructType().add("hits", LongType()).add("found", IntegerType()).add("excluded", BooleanType()).add("required_missing", BooleanType()).add("base", DoubleType()).add("labels", IntegerType())


def _literals(rules: Sequence[Rule]) -> list[str] | None:
    """What each rule counts, if all are literals with a label and a text of their own that an automaton's table holds."""
    if any(r.kind == "regex" or r.whole_word or r.case_sensitive for r in rules) or len({r.label for r in rules}) < len(rules):
        return None
    texts = [" ".join(r.expression.lower().replace("_", " ").split()) if " " in r.expression else r.expression.lower() for r in rules]
    return texts if fits(texts) else None


class Totals:
    """Sums over the rules in one field, ``_TOTALS`` for each text; literal rules are counted in all texts at once."""

    def __init__(self, rules: Sequence[Rule], name: str):
        self.rules, self.name, self.slow = list(rules), name, None
        literals = _literals(self.rules)
        self.automaton = Automaton(literals) if literals else None
        kinds = np.array([r.kind for r in self.rules], object)
        self.excluded, self.required = kinds == "excluded", kinds == "required"
        self.weight, self.twice = np.array([r.weight for r in self.rules], np.float64), np.where(kinds == "exact", 2, 1)

    def one(self, original: str | None, searched: str | None) -> tuple:
        """By the rules one by one."""
        self.slow = self.slow or RuleSet(self.rules)
        r = _rated(self.slow, [self.name], [original], [searched], False)
        return sum(n for _, n in r["hits"]), len(r["hits"]), r["excluded"], r["required_missing"], r["base"], r["labels"]

    def of(self, originals: list[str | None], searched: list[str | None]) -> pa.Array:
        if not self.automaton:
            columns = list(zip(*map(self.one, originals, searched), strict=True)) or [[]] * len(_TOTALS)
        else:
            # words of a phrase may have any spaces between them; no literal holds other spaces than one
            texts = [_SPACE.sub(" ", t) if t and _ODD_SPACE.search(t) else t or "" for t in searched]
            odd = [k for k, t in enumerate(texts) if _OTHER_CASE.search(t)]
            for k in odd:
                texts[k] = ""
            text, rule, n = self.automaton.counts(texts)
            size, out = len(texts), self.excluded[rule]
            part = np.where(out, 0.0, np.minimum(n, 10) * FIELD_WEIGHTS[self.name] * self.weight[rule] * self.twice[rule])
            each = lambda of, weights=None: np.bincount(of, weights, size)
            hits, base = np.zeros(size, np.int64), each(text, part)
            np.add.at(hits, text, n)
            missing = each(text[self.required[rule]]) < self.required.sum()
            columns = [c.tolist() for c in (hits, each(text), each(text[out]) > 0, missing, base, each(text[~out]))]
            for k in odd:
                for c, v in zip(columns, self.one(originals[k], searched[k]), strict=True):
                    c[k] = v
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.float64(), pa.int32()), strict=True)], _TOTALS.names)


def totals(docs: DataFrame, rules: Sequence[Rule], original: str, searched: str, name: str = "body") -> DataFrame:
    """As ``scan`` without bonuses over one field, with numbers instead of maps: the labels found, and hits of all rules."""
    if len(rules_json(rules)) > RULE_BYTES:
        raise ValueError(f"a rule set of more than {RULE_BYTES} bytes; cut it into several")
    held, ready = list(rules), []

    @sliced(_TOTALS)
    def summed(originals: list, texts: list) -> pa.Array:
        if not ready:
            ready.append(Totals(held, name))
        return ready[0].of(originals, texts)

    rated = once(docs, __r=summed(F.col(f"`{original}`").cast("string"), F.col(f"`{searched}`").cast("string")))
    r = F.col("__r")
    return rated.select(*[F.col(f"`{c}`") for c in docs.columns], r.found.alias("labels"), r.hits.alias("hits"), r.excluded.alias("excluded"), r.required_missing.alias("required_missing"), _score(r, F.lit(0)).alias("score"))


def _contexts(text: str, spans: list[tuple[int, int]], radius: int) -> list[str]:
    """Stretches of the text around the spans; stretches that touch or overlap are one."""
    joined: list[list[int]] = []
    for a, b in sorted(spans):
        a, b = max(0, a - radius), min(len(text), b + radius)
        if joined and a <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    return [("…" if a else "") + " ".join(text[a:b].split()) + ("…" if b < len(text) else "") for a, b in joined]


def field_snippets(rules: RuleSet, original: str | None, searched: str | None, radius: int) -> list[str]:
    """Every match of every rule in a field with its surroundings. Matches in the searched form are shown in the original where
    both have the same places (only the case differs); what stands in the searched form alone is shown from there."""
    if not original or searched is None:
        return []
    begin = len(original) - len(original.lstrip())
    same = original.isascii() and searched == original.strip().lower()
    shown, plain = [], []
    for k in rules.candidates([original, searched]):
        rule, pattern = rules.rules[k], rules.compiled[k]
        if not rule.case_sensitive:
            found = [m.span() for m in pattern.finditer(searched)]
            shown += [(a + begin, b + begin) for a, b in found] if same else []
            plain += [] if same else found
        if rule.case_sensitive or rule.kind == "regex":
            shown += [m.span() for m in pattern.finditer(original)]
    return _contexts(original, shown, radius) + _contexts(searched, plain, radius)


def snippets(docs: DataFrame, rules: Sequence[Rule], fields: dict[str, tuple[str, str]], id_col: str, *, radius: int = 220) -> DataFrame:
    """(id, position, field, snippet): all matches of each document in the order of ``fields``, each stretch once, none left out."""
    names, held = list(fields), list(rules)
    ready: list[RuleSet] = []

    @F.arrow_udf("array<struct<field:string,snippet:string>>")
    def made(*columns: pa.Array) -> pa.Array:
        if not ready:
            ready.append(RuleSet(held))
        rows = zip(*(c.to_pylist() for c in columns), strict=True)
        kind = pa.list_(pa.struct([("field", pa.string()), ("snippet", pa.string())]))
        return pa.array([[{"field": n, "snippet": s} for n, a, b in zip(names, r[::2], r[1::2], strict=True) for s in field_snippets(ready[0], a, b, radius)] for r in rows], kind)

    pairs = [F.col(f"`{c}`").cast("string") for pair in fields.values() for c in pair]
    return docs.select(id_col, F.posexplode(made(*pairs)).alias("position", "s")).select(id_col, "position", "s.*")
