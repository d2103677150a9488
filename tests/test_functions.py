"""Column functions on small cases, and against plain Python by hypothesis."""

import re
from urllib.parse import unquote_plus

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomstone.functions import dom
from loomstone.functions import html as H
from loomstone.functions import jsonx as J
from loomstone.functions import text as X
from loomstone.functions import urls as U

RULES = U.UrlRules()
SHOP = "https://www.shop.example.com"


def run(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_parse_price(spark):
    cases = {"£51.77": (51.77, "GBP"), "": (None, None), None: (None, None), "Â£51.77": (51.77, "GBP"), "$5": (5.0, "USD"), "€1,50": (1.5, "EUR"), "£1,234.56": (1.234, "GBP"), "51.77£": (51.77, None), "n/a": (None, None), "-5": (5.0, None), "£ 7": (7.0, "GBP")}
    assert [tuple(r) for r in run(spark, list(cases), X.parse_price)] == list(cases.values())


def test_clean_text(spark):
    cases = [(None, None), ([], None), ([None, ""], None), ([" a b", None, "\n c "], "a b c"), ([" \t"], None), (["x"], "x")]
    assert run(spark, [c for c, _ in cases], X.clean_text, "array<string>") == [e for _, e in cases]


def test_strip_preview(spark):
    full = "Hello world this is the whole thing, really."
    cases = [(None, None), ("", None), ("short", "short"), ("...more", None), (f"{full[:43]} {full} ...more", full), ("a" * 60, "a" * 59), ("ab...more...more", "ab...more")]
    assert run(spark, [c for c, _ in cases], X.strip_preview) == [e for _, e in cases]


def test_largest_image(spark):
    cases = [
        ('<img src="s.jpg" srcset="a.jpg 300w,\n b.jpg 1400w, c.jpg 700w">', "b.jpg"), ("<img srcset='a 300w, b 300w'>", "a"), ('<img srcset="a 2x, b 300w">', "b"), ('<img srcset="a, b">', "a"),
        ('<img src="x" srcset="">', None), ('<img src=" x ">', "x"), ('<img src="">', ""), ('<img data-srcset="q 5w">', "q"), ("<p>", None), (None, None),
    ]
    assert run(spark, [c for c, _ in cases], H.largest_image) == [e for _, e in cases]


def test_embedded_json(spark):
    head = "<script>window.PRODUCT_DATA = "
    cases = [
        (head + '{"media": {"thumbnail": {"url": "t"}, "primary": {"url": "p"}}};</script>', "p"), (head + '{"media": {"primary": {"url": "a}\\"b"}}} tail', 'a}"b'), (head + '{"media": {"primary": {"url": 3}}}', None),
        (head + '{"media": {"primary": {"url": null}}}', None), (head + '{"media": {"primary"', None), (head + "{'media': 1}", None), ("nothing", None), (None, None),
    ]
    assert run(spark, [c for c, _ in cases], J.primary_image) == [e for _, e in cases]


def test_video_and_pagination(spark):
    videos = [('<video poster="a.jpg"><source src="v.mp4"><track src="c.vtt">', "v.mp4"), ("<a data-video='V.MP4?s=1&t=2'>", "V.MP4?s=1&t=2"), ("<a src=\"v.mp4'>", None), ("none", None), (None, None)]
    assert run(spark, [c for c, _ in videos], H.video_url) == [e for _, e in videos]
    pages = [("Page\n 6\n of 24", (6, 24)), ("PAGE 1 OF 2 Page 3 of 4", (1, 2)), ("Page x of 2", None), (None, None)]
    assert [r and tuple(r) for r in run(spark, [c for c, _ in pages], H.pagination)] == [e for _, e in pages]


def test_page_facts(spark):
    page = "<title> A\n</title><h1 class=x>B <b>c</b></h1>" + "x" * 5000 + "Just a moment"
    assert run(spark, [page, "<p>", None], H.title) == ["A", None, None]
    assert run(spark, [page], H.h1) == ["B c"]
    assert run(spark, [page, "Just A Moment", None], H.challenged) == [False, True, False]
    assert run(spark, [page, None], H.rejected) == [True, False]
    assert run(spark, ["<link REL='canonical'>"], lambda c: H.has_attribute(c, "rel", "canonical")) == [True]


EDGES = [
    ("images", "https://images.example.com/Shop/DP0710202307351034Mwidth=550&amp;height=550", True, "DP0710202307351034M"), ("images", "https://images.example.com/Shop/DP68-2026Mimpolicy=product_detail", True, "DP68-2026M"),
    ("images", "https://images.example.com/Shop/DP09M", True, "DP09M"), ("videos", "https://videos.example.com/Shop/91A_V_VA_5-1OZwidth=550", True, "91A_V_VA_5-1OZ"),
    ("images", "https://images.example.com/Other/DP09M", False, None), ("images", "https://images.example.com.evil.com/Shop/DP09M", False, None), ("videos", "https://videos.example.com/Shop/91/extra", False, None),
    ("catalog", SHOP + "/g/shoes", False, None), ("catalog", SHOP + "/g/shoes?id=xyz123", False, None), ("catalog", SHOP + "/g/shoes?id=cat1&id=cat2&id=cat3", True, "cat2"), ("catalog", SHOP + "/g/shoes?id=cat1#x", False, None),
    ("product", SHOP + "/p/foo-bar", False, None), ("product", SHOP + "/p/foo-bar/ppr123/extra", False, None), ("product", "http://shop.example.com/p/foo-bar/ppr123?x=1", True, "ppr123"),
    ("search", SHOP + "/s?searchTerm=", False, None), ("search", SHOP + "/s?searchTerm=red+pants&x=1", True, "red+pants"),
    ("titles", SHOP + "/g/shoes?id=dept20&brand=adidas", True, "adidas"), ("titles", SHOP + "/g/shoes?xbrand=nope&id=dept20", True, "shoes"), ("titles", SHOP + "/p/biltmore-mens-fedora/ppr5", True, "biltmore-mens-fedora"),
    ("titles", SHOP + "/p/biltmore-mens-fedora", False, None), ("titles", SHOP + "/p/foo-bar/ppr123/extra", False, None), ("catalog", SHOP + "/g/shoes?id=cat1\r", True, "cat1"),
]


def test_url_edges(spark):
    df = spark.createDataFrame([(i, k, u) for i, (k, u, _, _) in enumerate(EDGES)], "i int, kind string, url string")
    got = df.select("i", RULES.check("kind", "url")["passed"].alias("p"), RULES.primary("kind", "url").alias("c")).orderBy("i").collect()
    for r, (kind, url, should, capture) in zip(got, EDGES, strict=True):
        assert r["p"] == should, url
        if should:
            assert r["c"] == capture, (kind, url)


def test_url_patterns_against_python(spark):
    urls = [u for _, u, _, _ in EDGES] + [None, "", " " + SHOP + "/p/a/ppr1 "]
    got = run(spark, urls, RULES.matched)
    for u, hits in zip(urls, got, strict=True):
        want = [k for k, p in RULES.patterns().items() if u is not None and re.match(p.replace(r"\z", r"\Z"), u.strip(), re.A)]
        assert hits == want


def test_titles(spark):
    cases = [("st-johns-bay+3d", "St Johns Bay 3D"), ("o'neill", "O'Neill"), ("4pc", "4Pc"), ("éclair", "Éclair")]
    assert run(spark, [c for c, _ in cases], lambda c: X.title_case(F.translate(c, "-+", "  "))) == [e for _, e in cases]


def test_check_report(spark):
    df = spark.createDataFrame([("catalog", SHOP + "/g/a?id=cat1"), ("search", SHOP + "/g/a?id=cat1"), ("any", "x"), ("any", SHOP + "/p/a/ppr1")], "kind string, url string")
    got = [r["c"] for r in df.select(RULES.check("kind", "url").alias("c")).collect()]
    assert [g["verdict"] for g in got] == ["PASS", "FAIL", "FAIL", "PASS"]
    assert got[0]["unexpected"] == [] and got[1]["hint"] == "no match, but it matches catalog, titles" and got[3]["also_matched"] == ["product", "titles"]


def test_case_lists():
    assert U.cases(["# c", "", "catalog  http://x y"]) == [("catalog", "http://x y")]
    assert U.pairs(["a", "b"]) == [("a", "b")]
    for bad in (lambda: U.cases(["one"]), lambda: U.pairs(["a"])):
        with pytest.raises(ValueError):
            bad()


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab%2Fé + \t3dE", max_size=12), min_size=20, max_size=40))
def test_text_against_python(spark, values):
    assert run(spark, values, X.decoded_plus) == [unquote_plus(v) for v in values]
    assert run(spark, values, X.stripped) == [v.strip() for v in values]
    assert run(spark, values, X.title_case) == [v.title() for v in values]
    assert run(spark, values, X.clean_one) == [re.sub(r"\s+", " ", v).strip() or None for v in values]


def test_selectors():
    top = dom.parse('<div class="a b"><ul><li>1<li>2</ul><p id=x>P<b>q</b>r<p>second&amp;<br>line</div><p>out<img src=i.png>')
    assert dom.select(top, "li::text") == ["1", "2"]
    assert dom.select(top, "div.a.b > p::text") == ["P", "r", "second&", "line"]
    assert dom.select(top, "#x ~ p::text") == ["second&", "line"]
    assert dom.select(top, "p#x b::text") == ["q"] and dom.select(top, "#x") == ["Pqr"]
    assert dom.select(top, "img::attr(src)") == ["i.png"] and dom.select(top, 'img[src="i.png"]::attr(src)') == ["i.png"]
    assert dom.select(top, "img[alt]::attr(src)") == []
    with pytest.raises(ValueError):
        dom.compiled("a:hover")


def test_json_paths():
    doc = {"a": [{"k": 1, "t": "X"}, {"k": {"k": 2}, "t": ["Y"]}], "b": {"k": None}}
    assert J.walk(doc, "$.a[0].k") == [1] and J.walk(doc, "$.a[*].k") == [1, {"k": 2}] and J.walk(doc, "$..k") == [1, {"k": 2}, None]
    assert J.walk(doc["a"], "$[?(@['t'] in ['Y','Z'])].k") == [{"k": 2}] and J.walk(doc["a"], "$[?(@.t=='X')].k") == [1]
    with pytest.raises(ValueError):
        J.steps("$.a[?x]")


def test_balanced_object(spark):
    cases = [('x{"a": {"b": "}\\"}"}} tail', 1, '{"a": {"b": "}\\"}"}}'), ("{{}", 0, None), ("{}", 1, None), ('{"open', 0, None), (None, 0, None), ("{'a': {}}", 0, "{'a': {}}")]
    df = spark.createDataFrame([(i, s, p) for i, (s, p, _) in enumerate(cases)], "i int, s string, p int")
    assert [r[0] for r in df.select(J.balanced_object("s", "p"), "i").orderBy("i").collect()] == [e for _, _, e in cases]


def test_plain_tags_give_the_tokenizers_nodes(monkeypatch):
    """Markup that passes the tokenizer only in parts, against all of it by the tokenizer; and no walk for any number of selectors."""
    import random
    from html.parser import HTMLParser

    from loomstone.functions import dom

    parts = [
        "<div>", "</div>", "<p class='a b'>", '<p class="a">', "</p>", "<br>", "<br/>", "<img src=x>", '<img src="a&amp;b" src="c">', "<a href='q?x=1&copy=2'>", "</a>", '<A ID="u">', "text", "&amp;", "& ", "&#65", "<", "<!", "<!-- c -->",
        "<script>", "if(a<b){'</p>'}", "</script>", "<title>", "</title>", "<td>", "<tr>", "<table>", "</table>", "<li>", "<ul>", "</ul>", "<p a='x>y'>", '<p a="<b>">', '<p  a="x">', '<p a="x" >', """<p a="x"b='y'>""", "</p >", "</>", "<p/>", '<p a="x', "<o:p>",
    ]
    shown = lambda n: n if isinstance(n, str) else (n.tag, n.attrs, n.index, [shown(k) for k in n.kids])
    rnd = random.Random(3)
    pages = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 20))) for _ in range(3000)]
    mine = [shown(dom.parse(h)) for h in pages]
    with monkeypatch.context() as m:
        m.setattr(dom._Builder, "goahead", HTMLParser.goahead)
        assert [shown(dom.parse(h)) for h in pages] == mine
    walks = []
    walk = dom.Node.walk
    monkeypatch.setattr(dom.Node, "walk", lambda n: walks.append(n) or walk(n))
    page = dom.Below(dom.parse("<ul id=u class='x y'><li><a href=1>one</a><li><a href=2>two</a></ul><p class=y>z</p>"))
    got = {s: page.select(s) for s in ("#u a::text", "li > a::attr(href)", ".y", "ul.x.y li", "ul ~ p::text", "*[class]")}
    assert got == {"#u a::text": ["one", "two"], "li > a::attr(href)": ["1", "2"], ".y": ["onetwo", "z"], "ul.x.y li": ["one", "two"], "ul ~ p::text": ["z"], "*[class]": ["onetwo", "z"]} and not walks
