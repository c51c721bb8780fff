"""Large rule sets against the scan that counts each rule."""

import random

import pytest
from pyspark.sql import functions as F

from webstrata.functions.text import clean_space
from webstrata.operators import automaton
from webstrata.operators import keyword_scan as K
from webstrata.operators import rule_sets as RS

SF = "/root/testdata/sf0.001"
FIELDS = {"url": ("url", "url_s"), "title": ("title", "title_s"), "body": ("body", "body_s"), "source": ("source", "source_s")}


def pages(spark, more=()):
    d = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    rows = d.select(F.col("doc_id").alias("id"), F.col("source").alias("url"), F.substring("text", 1, 40).alias("title"), F.substring("text", 1, 1500).alias("body"), F.substring("text", 1, 900).alias("source"))
    if more:
        rows = rows.unionByName(spark.createDataFrame(more, rows.schema))
    return rows.withColumns({f"{c}_s": clean_space(F.lower(c)) for c in ("url", "title", "body", "source")})


def compared(frame):
    keep = ["id", "excluded", "required_missing", "score", *(["proximity"] if "proximity" in frame.columns else [])]
    fields = F.array_sort(F.transform(F.map_entries("hit_fields"), lambda e: F.struct(e.key.alias("k"), F.array_sort(e.value).alias("v"))))
    hits = F.array_sort(F.map_entries("hits"))
    return {r.id: r for r in frame.select(*keep, hits.alias("hits"), fields.alias("fields")).collect()}


MIXED = [
    "the", "high: Thing", "exclude: disgusting", "exact: ation", "a b | whole", "Sport | case", "regex: (foo|bar)\\s+ba[rz]", "re: item_id\\s{2}ABC", "regex: \\d+", "straße | whole", "İx | case",
    "of the | label=the", "regex: colou?r", "regex: (?:very )+long", "regex: x*", "kayip", "was | whole | weight=2.1", "not | weight=0.3", "es", "exclude: zzz | label=the",
]
MORE = [
    (-1, "http://Foo/bar", "Thing", "foo  bar foo bar item_id  ABC. a b, A  B! very very long\n\ncolor the thing", "the<br><br>thing a\tb</p>thing of the", ), (-2, None, None, None, None), (-3, "", "kayıp", "kayıp STRASSE straße kayip ſports", ""),
    (-4, "u", "zzz disgusting", "Sport sport a_b", "x"), (-5, "u", "t", "12 34 İx was not", None),
]


@pytest.mark.parametrize("bonuses", [False, True])
@pytest.mark.parametrize("few", [48, 0])
def test_rule_set_equals_scan(spark, monkeypatch, bonuses, few):
    monkeypatch.setattr(RS, "FEW", few)
    docs, rules = pages(spark, MORE), K.parse_rules(MIXED)
    want, got = compared(K.scan(docs, rules, FIELDS, bonuses=bonuses)), compared(RS.scan(docs, rules, FIELDS, bonuses=bonuses))
    assert want.keys() == got.keys() and len(got) == 65
    for k in want:
        assert want[k] == got[k], (k, want[k], got[k])
    assert any(r.score for r in got.values())


def test_required_rules_are_missed_without_candidates(spark):
    docs, rules = pages(spark, MORE), K.parse_rules(["required: nowhere to be seen", "the"])
    assert all(r.required_missing and not r.score for r in compared(RS.scan(docs, rules, FIELDS)).values())
    assert all(r.score == 0 for r in compared(RS.scan(docs, [], FIELDS)).values())
    assert RS.scan(docs.limit(0), rules, FIELDS).count() == 0


def test_required_texts():
    text = lambda line: RS.required_text(K.parse_rule(line))
    assert text("Hello wide_World") == "hello" and text("é") == "" and text("straße") == "strasse" and text("Straße | case") == "stra"
    assert text("regex: (abc|abd)x+yz") == "ab" and text("regex: a|bcd") == "" and text("regex: (?:very )+lo?ng") == "very" and text("regex: \\d*") == ""
    assert text("regex: [abc]defg?hi") == "def"


def test_many_rules_keep_the_plan_small(spark):
    rng = random.Random(1)
    words = sorted({w for r in pages(spark).collect() for w in r.body.split() if len(w) > 2})
    rules = [K.Rule(f"{k} {w}", w, rng.choice(["optional", "optional", "exact", "excluded" if k == 5 else "optional"]), 1, rng.random() < 0.2, rng.random() < 0.3) for k, w in enumerate(rng.choices(words, k=2000))]
    docs = pages(spark)
    some = rules[:25]
    size = lambda rs: len(RS.scan(docs, rs, FIELDS)._jdf.queryExecution().toString())
    assert abs(size(rules) - size(some)) < 500
    assert compared(RS.scan(docs, some, FIELDS, bonuses=False)) == compared(K.scan(docs, some, FIELDS, bonuses=False))
    got = compared(RS.scan(docs, rules, FIELDS, bonuses=False))
    bodies = {r.id: r for r in docs.collect()}
    whole = RS.RuleSet(rules)
    for k, r in got.items():
        row = bodies[k]
        for n, rule in enumerate(rules):  # each rule by itself, without candidates
            total = sum(whole.count(n, row[a], row[b]) for a, b in FIELDS.values())
            assert dict(r.hits).get(rule.label, 0) == total


def test_totals_equal_the_maps_of_a_scan(spark):
    """Also where literals overlap themselves, in other spaces and cases, and for rules that are not all literals."""
    texts = ["aaaa a a a a", "the  the\tthe\n the", "a\u00a0b a_b A b", "kelvin K elvin ſum sum İi ı", "", None, "é the a é", "banana ananas\u2028a b"]
    docs = spark.createDataFrame([(k, t, t if k % 2 else (t or "").lower()) for k, t in enumerate(texts)], "id int, body string, body_s string")
    lines = ["a", "aa", "a a", "the the", "high: the", "a b", "a_b", "exact: ana", "exclude: nana", "sum", "kelvin", "i", "k"]
    for more in ([], ["required: a a a"], ["straße | whole", "regex: a+"]):
        rules = K.parse_rules(lines + more)
        want = RS.scan(docs, rules, {"body": ("body", "body_s")}, bonuses=False)
        want = want.select("id", F.size("hits").alias("labels"), F.aggregate(F.map_values("hits"), F.lit(0), lambda a, x: a + x).alias("hits"), "excluded", "required_missing", "score")
        got = RS.totals(docs, rules, "body", "body_s").select(want.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_literals_are_counted_for_all_texts_at_once(monkeypatch):
    """No document of thousands of literal rules is rated rule by rule, and no pattern or label is touched for it."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abcde", k=rng.randint(1, 5))) for _ in range(400)]
    rules = [K.Rule(x, x, rng.choice(["optional", "exact"]), rng.random()) for x in sorted({" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(3000)})]
    texts = [" ".join(rng.choices(words, k=n)) for n in (0, 1, 40, 900)]
    slow = RS.Totals(rules, "body")
    want = [slow.one(t, t) for t in texts]
    monkeypatch.setattr(RS, "_rated", None)
    monkeypatch.setattr(RS, "RuleSet", None)
    got = RS.Totals(rules, "body").of(texts, texts).to_pylist()
    assert [tuple(r.values()) for r in got] == want and want[3][0] > 3000


def test_automaton_counts_as_str_does():
    rng = random.Random(3)
    for n in range(60):
        letters = "ab "[: 1 + n % 3] if n % 2 else "abcd e"
        literals = list({"".join(rng.choices(letters, k=rng.randint(1, rng.choice([3, 6, 40])))) for _ in range(rng.randint(1, 60))})
        texts = ["".join(rng.choices(letters + "éz", k=rng.choice([0, 3, 50, 2000]))) for _ in range(rng.randint(1, 6))]
        got = {(int(t), int(k)): int(c) for t, k, c in zip(*automaton.Automaton(literals).counts(texts), strict=True)}
        assert got == {(t, k): x.count(y) for t, x in enumerate(texts) for k, y in enumerate(literals) if y in x}
    assert not any(map(automaton.fits, ([], [""], ["é"], ["a", "a"], ["a\tb"], ["a" * 600])))


def test_rule_sets_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(RS, "RULE_BYTES", 100)
    with pytest.raises(ValueError, match="cut it into several"):
        RS.scan(pages(spark), K.parse_rules(MIXED), FIELDS)


def test_snippets_hold_every_match():
    rules = RS.RuleSet(K.parse_rules(["needle", "Case | case", "regex: n\\d+", "straße"]))
    body = "start " + " ".join(f"needle {'x ' * 300}" for _ in range(12)) + " Case n7"
    got = RS.field_snippets(rules, body, body.strip().lower(), 220)
    assert len(got) == 13 and got[0].startswith("start needle") and not got[0].startswith("…") and got[-1].endswith("Case n7") and all("…" in s for s in got)
    assert RS.field_snippets(rules, "a needle b needle c", "a needle b needle c", 2) == ["a needle b needle c"]
    assert RS.field_snippets(rules, "  a NEEDLE b", "a needle b", 1) == ["…NEEDLE…"] and RS.field_snippets(rules, "case", "case", 9) == []
    assert RS.field_snippets(rules, "Straße  needle", "strasse needle", 3) == ["strasse needle"] and RS.field_snippets(rules, None, None, 3) == []


def test_snippets_query_against_brute_force(spark):
    from webstrata import catalog
    from webstrata.plans import load_all

    load_all()
    got = {}
    for r in catalog.QUERIES["match_snippets"](spark, SF).orderBy("doc_id", "position").collect():
        got.setdefault(r.doc_id, []).append((r.field, r.snippet))
    import re

    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        body = d.text or ""
        hits = [m.span() for m in re.finditer(r"(?i)stupid|(?:disgust|idiot)\w*", body)] + [m.span() for m in re.finditer("License", body)]
        shown = [s for f, s in got.get(d.doc_id, []) if f == "body"]
        assert bool(hits) == bool(shown)
        if body.isascii() and body == body.strip():
            ends, n = -(10**9), 0
            for a, b in sorted(hits):
                n += a - 60 > ends
                ends = max(ends, b + 60)
            assert len(shown) == n


def test_many_literals_are_counted_in_one_pass(monkeypatch):
    rules = [K.Rule(f"{k}", w) for k, w in enumerate(["a", "aa", "aba", "b c", "a_a", "b  c a", *(f"word{k}" for k in range(60))])]
    texts = ["aaaa aba ababa b c b c a word7 word70", "B_C a aa é b c", "a_a\tb \n c a ſ K aaa", "", None]
    whole = RS.RuleSet(rules)
    want = []
    for t in texts:
        s = None if t is None else t.lower()
        want.append({k: [n] for k in range(len(rules)) if (n := whole.count(k, t, s))})
    assert [whole.counts([t], [None if t is None else t.lower()]) for t in texts] == want
    monkeypatch.setattr(RS.RuleSet, "count", None)  # plain text needs no search by rule
    assert RS.RuleSet(rules).counts([texts[0]], [texts[0]]) == want[0]
