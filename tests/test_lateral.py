"""Table functions: every kind of entity and origin of media, lateral joins, and their columns."""

import re

import pytest

from webstrata.functions import lateral as L
from webstrata.operators.extract import ENTITIES

PAGE = """<html><head><meta property="og:video" content="/v/a.mp4"><meta name="author" content="x.png"><style>body{background:url('/bg.gif')}</style>
<script>player({"file": "http:\\/\\/cdn.example\\/f.flv", url: 'x'});</script></head><body background="b.jpg"><img src="i.png" srcset="i-1.png 1x, /i-2.webp 2x"><img data-src="lazy"><p style="background: url(p.png)">
<object data="o.swf"><param name="movie" value="m.swf"><param name="flashvars" value="file=%2Fw.wmv&amp;autoplay=1"><embed src="e.swf" flashvars="image=t.jpg"></object>
<video poster="still"><source src="s.webm"></video><iframe src="http://frames.example/x"></iframe><a href="song.MP3;v=1">s</a><a href="page.html">p</a><a href="javascript:x.png">j</a><img src="data:image/png;base64,x"><img src="i.png"></body></html>"""


def test_media_of_a_page():
    got = {(u.removeprefix("http://a.example/d/"), kind, origin) for u, kind, origin, _ in L.MediaLinks().eval(PAGE, "http://a.example/d/p.html")}
    assert got == {
        ("http://a.example/v/a.mp4", "video", "meta"), ("http://a.example/bg.gif", "image", "css"), ("http://cdn.example/f.flv", "video", "setting"), ("b.jpg", "image", "background"), ("i.png", "image", "src"), ("i-1.png", "image", "srcset"),
        ("http://a.example/i-2.webp", "image", "srcset"), ("lazy", "image", "data-src"), ("p.png", "image", "css"), ("o.swf", "video", "data"), ("m.swf", "video", "param"), ("http://a.example/w.wmv", "video", "flashvars"),
        ("e.swf", "video", "src"), ("t.jpg", "image", "flashvars"), ("still", "image", "poster"), ("s.webm", "video", "src"), ("http://frames.example/x", None, "src"), ("song.MP3;v=1", "audio", "href"),
    }
    assert list(L.MediaLinks().eval(None, None)) == [] and list(L.MediaLinks().eval("<img src='http://[x'>", "http://a/")) == []


def test_entities_of_every_kind():
    text = "On 2001-09-11 see http://Sub.Example.com/a/File.WMV and u/some_user, me@mail.example.org, notes.txt d41d8cd98f00b204e9800998ecf8427e; again 2001-09-11 ME@mail.example.org"
    got = {(k, n) for k, _, n in L.PageEntities().eval(text, "https://Host.example/x/p.html", "")}
    assert {("date", "2001-09-11"), ("domain", "sub.example.com"), ("domain", "host.example"), ("filename", "file.wmv"), ("filename", "p.html"), ("filename", "notes.txt"), ("username", "some_user"), ("email", "me@mail.example.org"), ("hash", "d41d8cd98f00b204e9800998ecf8427e"), ("url", "http://sub.example.com/a/file.wmv")} <= got
    assert {k for k, *_ in L.PageEntities().eval(text, None, "domain")} == {"domain"} and list(L.PageEntities().eval(None, None, "")) == []
    at = {(k, n): a for k, _, n, a in L.PageEntities().eval(text, None, "", True)}
    assert text[at["filename", "notes.txt"] :].startswith("notes.txt")


def test_lateral_join_against_patterns(spark):
    L.register(spark)
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    d.createOrReplaceTempView("lateral_documents")
    got = {(r.doc_id, r.kind, r.normalized) for r in spark.sql("SELECT doc_id, e.* FROM lateral_documents, LATERAL page_entities(text, source, '') e").collect()}
    want = set()
    for r in d.collect():
        for k, p in ENTITIES.items():
            for v in re.findall(p, r.text or ""):
                want.add((r.doc_id, k, " ".join(v.split()).casefold()))
                want |= {(r.doc_id, a, b.casefold()) for a, b in (L.url_parts(v) if k == "url" else ())}
        want |= {(r.doc_id, a, b.casefold()) for a, b in L.url_parts(r.source or "") if r.source}
    assert got == want and len({k for _, k, _ in got}) >= 3
    assert spark.sql("SELECT * FROM page_entities('a@b.example', NULL, 'email', true)").columns == ["kind", "value", "normalized", "at"]
    with pytest.raises(Exception, match="constant list"):
        spark.sql("SELECT * FROM page_entities('x', NULL, 'nothing')")
