"""Operators of the collection on small hand-made rows."""

import json
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from webstrata import catalog
from webstrata.functions import text as T
from webstrata.operators import classify as C
from webstrata.operators import extract as X
from webstrata.operators import fulltext as FT
from webstrata.operators import history as H
from webstrata.operators import keyword_scan as K
from webstrata.operators import reports as R
from webstrata.operators import shaping as S
from webstrata.operators import similarity as SIM
from webstrata.operators import vectors as V
from webstrata.plans import load_all
from webstrata.sources import bodies, cdx

load_all()


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(expr.alias("x")).first().x

SF = "/root/testdata/sf0.001"


def test_rule_lines():
    r = K.parse_rule("required: World Trade Center | weight=2 | whole")
    assert (r.kind, r.weight, r.whole_word, r.expression) == ("required", 2, True, "World Trade Center")
    assert K.parse_rule("high: jumper").weight == 3
    assert K.parse_rule("exclude: base jumping").kind == "excluded"
    assert K.parse_rule(r"regex: sky(light|line)\.mov | label=sky").label == "sky"
    assert K.parse_rule("# note") is None and K.parse_rule("  ") is None
    assert not K.parse_rule("exact: a b | whole").whole_word
    with pytest.raises(ValueError):
        K.parse_rule("a | colour=red")
    rules = K.parse_rules(["a", "a", "required: b | case", {"label": "l", "expression": "c"}])
    assert K.parse_rules(K.rule_lines(rules)) == rules and len(rules) == 3
    assert len(json.loads(K.rules_json(rules))) == 3


def _scored(spark, rules, *bodies_):
    rows = spark.createDataFrame([(k, "http://x/", b) for k, b in enumerate(bodies_)], "id int, url string, body string").withColumns({"u": T.normalize_search(F.col("url")), "b": T.normalize_search(F.col("body"))})
    out = K.scan(rows, K.parse_rules(rules), {"url": ("url", "u"), "body": ("body", "b")})
    return {r.id: r for r in out.collect()}


def test_scan_required_excluded_and_order(spark):
    got = _scored(spark, ["required: WTC", "high: jumper", "exclude: stock market"], "a jumper", "the WTC and a jumper", "WTC stock market", "WTC " * 30)
    assert got[0].score == 0 and got[0].required_missing
    assert got[2].score == 0 and got[2].excluded
    assert got[1].score > 0 and got[1].hits == {"WTC": 1, "jumper": 1} and got[1].hit_fields["WTC"] == ["body"]
    assert got[3].score == 10  # counts stop at ten


def test_scan_proximity(spark):
    near = "WTC jumper"
    far = "WTC " + "word " * 100 + "jumper"
    got = _scored(spark, ["WTC", "jumper"], near, far)
    assert got[0].score > got[1].score
    assert got[0].proximity.pairs == 1 and got[1].proximity.pairs == 0 and got[1].proximity.minimum_distance == 101


def test_scan_same_label_required(spark):
    got = _scored(spark, ["required: a1 | label=x", "required: b2 | label=x"], "only a1 here", "a1 and b2")
    assert got[0].required_missing and got[0].score == 0 and not got[1].required_missing


def test_normalize_search(spark):
    assert one(spark, T.normalize_search(F.col("v")), v="Stra%C3%9Fe_&amp;  Ｘ") == "strasse & x"


def test_hit_list_counts_without_overlap(spark):
    docs = spark.createDataFrame([(1, "aaaa b"), (2, None), (3, "xaay aa")], "id int, text string")
    phrases = spark.createDataFrame([(7, "aa"), (8, ""), (9, "zz")], "pid int, phrase string")
    for block in (1 << 20, 1):
        got = K.hit_list(docs, phrases, id_col="id", text_col="text", phrase_id="pid", phrase="phrase", block_bytes=block)
        assert sorted(map(tuple, got.collect())) == [(1, 7, 2), (3, 7, 2)]


def test_dates(spark):
    cases = {"2001": ("20010101000000", "20011231235959"), "200102": ("20010201000000", "20010228235959"), "2001-2-3": ("20010203000000", "20010203235959"), "02/03/2001": ("20010203000000", "20010203235959"), "2001-13-40": (None, None), "x": (None, None)}
    for text, (low, high) in cases.items():
        assert (one(spark, T.archive_date(F.col("v")), v=text), one(spark, T.archive_date(F.col("v"), True), v=text)) == (low, high), text


def test_urls(spark):
    assert one(spark, T.without_replay(F.col("v")), v="https://web.archive.org/web/2001id_/http://a.b/c") == "http://a.b/c"
    assert one(spark, T.extension_of(F.col("v")), v="http://h/a/clip.WMV;sid=1?x=y.png") == ".wmv"
    assert one(spark, T.host_of(F.col("v")), v="HTTP://user@Ex.Org:80/p") == "ex.org"
    assert one(spark, T.target_pattern(F.col("v")), v="http://example.com") == "example.com/*"
    got = [one(spark, T.host_within(F.col("h"), F.lit("example.org")), h=h) for h in ("example.org", "sub.example.org", "example.org.evil.net", "badexample.org")]
    assert got == [True, True, False, False]
    assert one(spark, X.thread_key(F.col("v")), v="https://web.archive.org/web/2005/http://example.com/showthread.php?t=55&page=3#post99") == "example.com|thread:55"


def test_classification(spark):
    k = lambda url, mime: tuple(one(spark, C.classify(F.col("u"), F.col("m")), u=url, m=mime))[::2]
    assert k("http://a/b.html", "text/html; charset=x") == ("text", True)
    assert k("http://a/b.jpg", "text/html") == ("image", True)
    assert k("http://a/b.html", "image/png") == ("unknown", False)
    assert k("http://a/b", "application/pdf") == ("other_binary", True)
    assert k("http://a/b.css", "") == ("text", False)
    assert k("http://a/b", None) == ("unknown", False)
    assert k("http://a/b.asx", "video/x-ms-asf") == ("media_descriptor", True)


def test_plans_compute_once(spark):
    """Pages are parsed once and each field is searched once by rule, whatever filters and columns follow."""
    from webstrata.plans import collection, corpus

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(collection.cdx_json_rows(spark, SF)).count("from_json(") == 1
    assert plan(corpus.eligible_matches(spark, SF)).count("replace(") == 3 * len(corpus.RULES)
    assert plan(corpus.scan_ranked(spark, SF)).count("replace(") == 3 * len(corpus.RULES)
    assert plan(corpus.scan_keyword_counts(spark, SF)).count("replace(") == 3 * len(corpus.RULES)


def test_near_groups(spark):
    words = [f"word{k}" for k in range(400)]
    rows = [(5, " ".join(words)), (3, " ".join(words)), (8, " ".join([*words[:399], "other"])), (9, "nothing like it at all " * 9), (10, None)]
    got = {r.id: r for r in H.near_groups(H.fingerprints(spark.createDataFrame(rows, "id int, text string"), "id", "text")).collect()}
    assert got[3].method == got[5].method == "exact" and got[3].group == got[5].group == 3 and got[3].similarity == 1 and 9 not in got and 10 not in got
    if 8 in got:
        assert got[8].method == "near" and 0.9 <= got[8].similarity < 1 and got[8].group == 3


def test_merge_keeps_the_last_complete_generation(spark, tmp_path):
    from webstrata.streaming import jobs

    write = jobs.merge_each_batch(str(tmp_path), "k", "n")
    frame = lambda *rows: spark.createDataFrame(rows, "k int, n int, v string")
    write(frame((1, 1, "a"), (2, 1, "b")), 0)
    write(frame((1, 2, "c")), 7)  # numbers were left out
    write(frame((1, 2, "c")), 7)  # the same batch again
    (tmp_path / "generation=8").mkdir()  # begun and lost
    write(frame((3, 1, "d")), 9)
    assert jobs.generations(spark, str(tmp_path)) == [0, 7, 9]
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/generation=9").collect())) == [(1, 2, "c"), (2, 1, "b"), (3, 1, "d")]


def test_matching(spark):
    docs = spark.createDataFrame([(1, "red fish, blue fish", "sea"), (2, "red bird", "air"), (3, None, "sea red"), (4, "", None)], "id int, text string, place string")
    fields = {"text": "text", "place": "place"}
    ids = lambda **k: sorted(r.id for r in FT.matching(docs, fields, **k).collect())
    assert ids(every=["red"]) == [1, 2, 3] and ids(every=["red"], field="text") == [1, 2] and ids(some=["blue fish", "bi*"]) == [1, 2]
    assert ids(every=["red"], none=["sea"]) == [2] and ids(some=["fish red"]) == [] and ids() == [1, 2, 3, 4]


def test_payload_kinds(spark):
    heads = {
        b"\x89PNG\r\n\x1a\n": "image", b"BMW news today": "text", b"MZ notes": "text", b"ID3 tag how-to": "text", b"RIFF cards": "text", "é\r\n".encode("utf-16"): "text", b"\0\0\0\x1cftypavif": "image",
        b"\0\0\0\x1cftypmp42": "video", b"RIFF....AVI ": "video", b"%PDF-1": "other_binary", b"a" * 600 + b"\0": "other_binary", b"a" * 9000 + b"\0": "text", b"": "text", None: "text", b"ID3\x03": "audio",
        b"BM" + (26).to_bytes(4, "little") + bytes(4) + (26).to_bytes(4, "little") + (12).to_bytes(4, "little") + bytes(8): "other_binary", b"\x1b" * 5 + b"a" * 95: "other_binary", b"\x1b" * 3 + b"a" * 97: "text",
    }
    rows = spark.createDataFrame([(k, h) for k, h in enumerate(heads)], "n int, b binary")
    assert [r.k for r in rows.select("n", C.payload_kind(F.col("b")).alias("k")).orderBy("n").collect()] == list(heads.values())
    typed = [(b"<p>", "image/jpeg", "http://a/x", "other_binary"), (b"<svg>", "image/svg+xml", "http://a/x", "image"), (b"#EXTM3U", "audio/x-mpegurl", "http://a/x", "other_binary"), (b"<p>", "text/html", "http://a/x.jpg", "image"), (b"x", "application/smil+xml", "http://a/x.smil", "media_descriptor"), (b"<p>", None, "http://a/x", "text")]
    frame = spark.createDataFrame([(k, *t) for k, t in enumerate(typed)], "n int, b binary, m string, u string, want string")
    got = frame.select("n", "want", C.payload_kind(F.col("b"), F.col("m"), F.col("u")).alias("k")).orderBy("n").collect()
    assert [r.k for r in got] == [r.want for r in got]


def test_pages_and_posts(spark):
    html = '<title>Thread &amp; title</title><script>x</script><div class="post" id="post10"><span class="username">ann</span> first body</div><div class="post" id="post11">second body</div><a href="/x.swf">l</a><img src=\'y.png\'>'
    pages = spark.createDataFrame([(1, "http://h/a/showthread.php?t=9", html), (2, "http://h/", None)], "id int, url string, html string")
    posts = X.posts(pages, "id", "url", "html").orderBy("position").collect()
    assert [(p.key, p.author, p.thread) for p in posts] == [("10", "ann", "h|thread:9"), ("11", "", "h|thread:9")]
    parsed = {r.id: r for r in X.pages_parsed(pages, "id", "url", "html").collect()}
    assert parsed[1].title == "Thread & title" and "http://h/x.swf" in parsed[1].links and "http://h/a/y.png" in parsed[1].links and "x " not in parsed[1].body.split("first")[0]
    assert X.forum_profile(F.col("h"), F.col("u")) is not None
    assert one(spark, X.forum_profile(F.col("h"), F.col("u")), h=html, u="http://h/showthread.php") == "vbulletin"


def test_embeds(spark):
    html = '<object data="a.wmv"></object><embed src="b.swf"><param name="movie" value="c.wmv"><script>file: "d.flv"</script><a href="javascript:x">'
    got = {(r.url, r.player) for r in X.embeds(spark.createDataFrame([(1, "http://h/p/", html)], "id int, url string, html string"), "id", "url", "html").collect()}
    assert {("http://h/p/b.swf", "Adobe Flash"), ("http://h/p/c.wmv", "Windows Media Player"), ("http://h/p/d.flv", "Embedded media")} <= got


def test_extractions(spark):
    rows = spark.createDataFrame([(1, "http://v/play?docid=-123456789", "ABC-999 and viploader12345")], "id int, url string, body string")
    rules = X.parse_extractors([r"mirror_code :: body :: (ABC-\d+)", "# no"])
    got = {(r.name, r.value) for r in X.extractions(rows, "id", {"url": "url", "body": "body"}, rules).collect()}
    assert {("google_video_docid", "-123456789"), ("mirror_code", "ABC-999"), ("legacy_uploader_id", "viploader12345")} <= got


def test_full_text(spark):
    docs = spark.createDataFrame([(1, "jumper impact at noon"), (2, "impact of a jumper"), (3, "nothing")], "id int, text string")
    index = FT.index(docs, "id", "text")
    assert [r.id for r in FT.phrase(index, ["jumper", "impact"]).collect()] == [1]
    ranked = FT.bm25(docs, "id", "text", ["jumper", "noon"]).orderBy(F.desc("score")).collect()
    assert [r.id for r in ranked] == [1, 2] and ranked[0].score > ranked[1].score > 0
    assert FT.bm25(docs, "id", "text", ["noth"], prefix=True).first().id == 3


def test_snapshots_are_compared_as_a_whole(spark, tmp_path):
    head = "one\ntwo\nthree\n"
    rows = [(1, "u", head + "four"), (2, "u", head + "changed"), (3, "v", head), (4, "u", head + "changed"), (5, None, "x"), (6, None, None)]
    spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, source string, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.earlier, r.later): (r.similarity, r.changed) for r in catalog.QUERIES["snapshot_similarity"](spark, str(tmp_path)).collect()}
    ratio = round(SequenceMatcher(None, rows[0][2], rows[1][2], autojunk=False).ratio(), 6)
    assert got == {(1, 2): (ratio, True), (2, 4): (1.0, False), (5, 6): (0.0, True)}


@pytest.mark.parametrize("places", [1 << 20, 200, 10])
def test_ratios_are_the_matchers(monkeypatch, places):
    monkeypatch.setattr(SIM, "PLACES", places)
    rng = random.Random(5)
    pairs = [("", ""), ("a", ""), ("abc", "abc"), ("é🙂x", "🙂x"), ("a" * 700, "a" * 650 + "b" * 40), ("\ud800", "\ud800 ")]
    for _ in range(150):
        letters = rng.choice(["ab", "abc", "abcdefgh", "the quick brown fox "])
        a, b = ("".join(rng.choice(letters) for _ in range(rng.randint(0, 150))) for _ in "ab")
        pairs.append((a, a[: rng.randint(0, len(a))] + b[: rng.randint(0, 30)] + a[rng.randint(0, len(a)) :] if rng.random() < 0.5 else b))
    monkeypatch.setattr(SIM, "TOGETHER", 1000)
    assert SIM.ratios(pairs) == [SequenceMatcher(None, a, b, autojunk=False).ratio() for a, b in pairs]


def test_substrings_of_one_text_alone_get_no_rank():
    """Unlike texts are not ranked up to the longest substrings, and like ones still are."""
    assert max(SIM._Text(["abcdefgh" * 80, "ijklmnop" * 80]).ranks) == 4
    assert max(SIM._Text(["abcdefgh" * 80, "abcdefgh" * 79]).ranks) == 256


def test_similarity_query_against_the_matcher(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = catalog.QUERIES["snapshot_similarity"](spark, sf).collect()
    assert len(rows) > 100
    for r in rows:
        a, b = texts[r.earlier], texts[r.later]
        if len(a) * len(b) < 4_000_000:
            assert r.similarity == round(SequenceMatcher(None, a, b, autojunk=False).ratio(), 6)


def test_history(spark):
    rows = spark.createDataFrame([(1, "u", "a\nb"), (2, "u", "a\nb\nNEW-ID"), (3, "v", "a\nb"), (4, "u", "a\nb\nNEW-ID")], "id int, url string, text string")
    pairs = {r.later: r for r in H.with_similarity(H.snapshot_pairs(rows, "url", "id", "text")).collect()}
    assert pairs[2].added == ["NEW-ID"] and pairs[2].changed and pairs[4].similarity == 1.0 and not pairs[4].changed
    assert [tuple(r) for r in H.first_appearances(rows, ["new-id"], "url", "id", "text").collect()] == [("new-id", "u", 2, 4)]
    groups = H.exact_groups(rows, "id", "text")
    assert sorted((r.id, r.representative) for r in groups.collect()) == [(1, 1), (2, 2), (3, 1), (4, 2)]
    assert [(r.source, r.mirror) for r in H.provenance(groups, rows, "id", "url").collect()] == [(1, 3)]


def test_near_groups_and_labels(spark, tmp_path):
    base = " ".join(f"w{k}" for k in range(200))
    rows = spark.createDataFrame([(1, base), (2, base + " x"), (3, "other text entirely here now"), (4, base), (5, "")], "id int, text string")
    links = H.near_links(H.fingerprints(rows, "id", "text"))
    labels = {r.id: r.label for r in H.smallest_labels(links).collect()}
    assert labels[4] == labels[1] == 1 and 3 not in labels and 5 not in labels
    chain = spark.createDataFrame([(k, k + 1) for k in range(1, 30)] + [(50, 51)], "a int, b int")
    got = {r.id: r.label for r in H.smallest_labels(chain).collect()}
    assert set(list(got.values())) == {1, 50} and len(got) == 32


def test_gaps_cover_the_range(spark):
    rng = random.Random(5)
    rows = [(k % 7, a, a + rng.randint(0, 9)) for k in range(80) for a in [rng.randint(0, 200)]]
    df = spark.createDataFrame(rows, "k int, a long, b long")
    got = S.gaps(df, ["k"], "a", "b", F.lit(10).cast("long"), F.lit(180).cast("long")).collect()
    for k in range(7):
        open_ = {x for r in got if r.k == k for x in range(r.gap_start, r.gap_end + 1)}
        assert open_ == set(range(10, 181)) - {x for q, a, b in rows if q == k for x in range(a, b + 1)}


def test_merge_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, None, 2)], "k int, e string, s int")
    new = spark.createDataFrame([(2, None, 9), (3, "c", 9), (1, "z", 9)], "k int, e string, s int")
    got = {r.k: tuple(r)[1:] for r in S.merged(old, new, ["k"], ["e"], ["s"]).collect()}
    assert got == {1: ("z", 1, "changed"), 2: (None, 2, "unchanged"), 3: ("c", 9, "added")}
    again = S.merged(spark.createDataFrame([(k, *v[:2]) for k, v in got.items()], old.schema), new, ["k"], ["e"], ["s"])
    assert {r.change for r in again.collect()} == {"unchanged"}


def test_run_comparison_and_latest(spark):
    a, b = spark.createDataFrame([(1, 10), (2, 5)], "d int, s int"), spark.createDataFrame([(1, 25), (3, 7)], "d int, s int")
    got = {r.d: (r.bucket, r.delta) for r in S.compare_runs(a, b, "d", "s").collect()}
    assert got == {1: ("both", 15), 2: ("only_a", None), 3: ("only_b", None)}
    log = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (1, 3, "y"), (2, 1, "z")], "k int, n int, v string")
    assert {r.k: r.v for r in S.latest(log, ["k"], "n", ["v"]).collect()} == {1: "y", 2: "z"}
    assert {r.k: r.repeats for r in S.consecutive_repeats(log, ["k"], "n", "v").collect()} == {1: 2, 2: 1}


def test_index_pages(spark):
    pages = [("ok", '[["timestamp","original"],["1","u"]]'), ("tail", '[["timestamp","original"],["1","u"],[],["key"]]'), ("empty", "[]"), ("ragged", '[["timestamp","original"],["1"]]'), ("bad", "{"), ("none", ""), ("double", '[["timestamp","timestamp"],["1","2"]]'), ("null", '[["timestamp","original"],["1",null]]')]
    got = {r.page: r for r in cdx.parse_json(spark.createDataFrame(pages, "page string, value string")).collect()}
    assert {k: r.problem for k, r in got.items()} == {"ok": None, "tail": None, "empty": None, "ragged": "ragged_row", "bad": "not_an_array", "none": "empty_body", "double": "doubled_header", "null": "missing_value"}
    assert got["tail"].resume == "key" and len(got["tail"].records) == 1
    text = spark.createDataFrame([("a", "20060102030405 text/html 200 ABC 100 http://x/a b\n\nres\n"), ("b", "<html>no")], "page string, value string")
    got = {r.page: r for r in cdx.parse_text(text).collect()}
    assert got["a"].resume == "res" and got["a"].records[0][-1] == "http://x/a b" and got["b"].problem == "error_page"
    assert [one(spark, cdx.page_count(F.col("v")), v=v) for v in ("7", '[["3"]]', '{"pages": 4}', "x")] == [7, 3, 4, None]
    assert cdx.signature(a=1, b=2) == cdx.signature(b=2, a=1)


def test_bodies(spark, tmp_path):
    assert bodies.decoded("é".encode("cp1252")) == "é" and bodies.decoded("é".encode()) == "é"
    assert bodies.decoded("a😀".encode("utf-32")) == "a😀" and bodies.decoded(b"\x93", "text/plain; charset=latin-1") == "\x93" and bodies.decoded(b"\x81\x93") == "\x81\x93"
    assert bodies.textual("é".encode("utf-32")) and bodies.textual("ab".encode("utf-16-le"), "text/plain; charset=utf-16-le") and not bodies.textual(b"\xff\xfe\x00\xd8a\0") and not bodies.textual(b"x", "image/png")
    import gzip

    packed = gzip.compress(b"x" * 5000)
    assert bodies.opened(packed) == (b"x" * 5000, None) and bodies.opened(packed, 4999) == (None, "body_too_large") and bodies.opened(packed[:3] + b"?") == (packed[:3] + b"?", None)
    assert bodies.decoded(b"<meta charset=iso-8859-1>\x93", "text/html") == "<meta charset=iso-8859-1>“" and bodies.decoded(b"<meta charset=iso-8859-1>\x93") == "<meta charset=iso-8859-1>\x93"
    assert bodies.textual(b"hello") and bodies.textual(b"MZ is a band") and not bodies.textual(b"\x89PNG\r\n\x1a\n") and not bodies.textual(b"a\0b")
    (tmp_path / "a.html").write_text("<p>x")
    (tmp_path / "b.exe").write_text("x")
    found = bodies.read_folder(spark, str(tmp_path))
    assert found.count() == 1 and found.select(bodies.decode("content", F.lit("text/html")).alias("t")).first().t == "<p>x"
    records = found.select("path", "size", F.lit("0").alias("sha256"))
    assert [r.state for r in bodies.integrity(found, records).collect()] == ["digest_differs"]
    lines = spark.createDataFrame([("*.Example.com/*",), ("# c",), ("bad_host",), ("example.com",)], "value string")
    assert [tuple(r) for r in bodies.domain_list(lines).collect()] == [("example.com", 2)]


def test_vectors(spark):
    rows = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha beta gamma"), (3, "x")], "id int, text string").withColumn("v", V.hashed_vector(F.col("text")))
    v = {r.id: r.v for r in rows.collect()}
    assert v[1] == v[2] and abs(sum(x * x for x in v[1]) - 1) < 1e-5
    top = V.nearest(rows, "id", "v", v[1], 2).collect()
    assert [r.id for r in top] == [1, 2] and abs(top[0].similarity - 1) < 1e-5
    links = V.links_by_bands(spark.createDataFrame([(1, [0.5] * 64), (2, [0.5] * 63 + [0.49])], "id int, v array<double>"), "id", "v", 64, 0.9)
    assert [(r.a, r.b) for r in links.collect()] == [(1, 2)]
    g = V.graph(spark.createDataFrame([(1, 2, "t", 0.5), (1, 2, "t", 0.9), (3, 3, "t", 1.0)], "src int, dst int, type string, weight double"))
    assert [tuple(r) for r in g.collect()] == [(1, 2, "t", 0.9)]
    assert [r.related for r in V.around(spark.createDataFrame([(2,)], "id int"), g, "id").collect()] == [1]


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a\tb"), (2, None)], "doc_id int, t string")
    R.write_tsv(rows, str(tmp_path / "r"), [F.desc("doc_id")])
    text = "".join(p.read_text() for p in sorted((tmp_path / "r").glob("part-*")))
    assert "1\ta b" in text
    assert R.digest_of(rows).first() == R.digest_of(rows.orderBy(F.desc("doc_id"))).first()
    R.atomic_text(str(tmp_path / "s.json"), R.summary({"n": rows.agg(F.count("*").alias("n"))}))
    assert json.loads((tmp_path / "s.json").read_text()) == {"n": {"n": 2}}
    assert R.pack(str(tmp_path / "r"), str(tmp_path / "r.zip")).endswith("zip")


def test_vector_links_leave_near_vectors_apart(spark, tmp_path):
    rng = random.Random(5)
    base = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(4)]
    rows = [(k, [x + rng.gauss(0, 0.02) for x in base[k % 4]]) for k in range(40)] + [(40, base[0]), (41, base[0])]  # near ones, and one twice
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    e.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in catalog.QUERIES["vector_links"](spark, str(tmp_path)).collect())
    assert got == [(k, k + 10_000_000, 1.0) for k in range(42)]
    near = V.links_by_bands(e, "vec_id", "embedding", 64, 0.8)
    assert near.count() > 41  # without a condition, links between near ones are found


def test_files_too_large_take_no_room(spark, tmp_path):
    assert catalog.QUERIES["folder_imported"](spark, SF).where("problem = 'too_large'").count() > 0
    rows = spark.createDataFrame([(1, "html", b"<p>x"), (2, "html", b"<p>y")], "id int, s string, c binary")
    bodies.write_files(rows, str(tmp_path / "f"), "id", "s", "c", F.when(F.col("id") == 2, 3_000_000)).collect()
    one, two = (tmp_path / "f" / f"{k}.html" for k in (1, 2))
    assert one.read_bytes() == b"<p>x" and two.stat().st_size == 3_000_004 and two.read_bytes()[:5] == b"<p>y\0" and two.stat().st_blocks * 512 < 1_000_000
    found = {r.size: r.problem for r in bodies.imported(bodies.read_folder(spark, str(tmp_path / "f"), most=2_000_000)).collect()}
    assert found == {4: None, 3_000_004: "too_large"}
