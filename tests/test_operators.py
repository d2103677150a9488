"""Operators on small tables: dedup, coverage, gates, merge, traversal, sources, sinks, streams, config."""

import datetime
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from loomstone.functions import html as H
from loomstone.functions import jsonx as J
from loomstone.functions import urls as U
from loomstone.operators import crawl, quality
from loomstone.plans.extraction import Plan, with_companion
from loomstone.sources import io
from loomstone.streaming import dedup


def test_keep_first(spark):
    rows = [(1, "u", "x"), (2, "u", "y"), (3, None, "p"), (4, None, "q"), (5, "", "z"), (6, "", "z"), (7, None, None), (8, None, None), (9, "", ""), (10, "", "")]
    df = spark.createDataFrame(rows, "seq int, upc string, product_url string")
    assert sorted(r["seq"] for r in quality.keep_first(df, quality.item_key(), "seq").collect()) == [1, 3, 4, 5, 7, 8, 9]
    assert tuple(quality.duplicate_tally(df, quality.item_key()).first()) == (5, 3)
    assert quality.keep_first(df.limit(0), quality.item_key(), "seq").count() == 0


def test_coverage_and_gates(spark):
    df = spark.createDataFrame([("a", 0.0), ("", None), (None, 1.0)], "title string, price double")
    assert {r["field"]: r["missing"] for r in quality.coverage(df, ("title", "price")).collect()} == {"title": 2, "price": 1}
    assert {r["field"]: r["failed"] for r in quality.missing_gate(df, ("title", "price"), 0.5).collect()} == {"title": True, "price": False}
    assert not quality.run_gate(df, 3).first()["failed"] and quality.run_gate(df, 4).first()["failed"]
    assert quality.coverage(df.limit(0), ("title",)).count() == 0
    seen_df, seen = quality.observed(df, ("title", "price"))
    seen_df.collect()
    assert seen.get == {"items": 3, "title": 2, "price": 1}


def test_diff(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "y"), (2, None), (4, "w")], "k int, v string")
    assert {r["k"]: (r["change"], r["fields"]) for r in quality.diff(a, b, "k", ("v",)).collect()} == {1: ("changed", ["v"]), 3: ("removed", None), 4: ("added", None)}


def test_reach_with_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "src string, dst string")
    got = {r["node"]: r["depth"] for r in crawl.reach(edges, spark.createDataFrame([("a",)], "node string")).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_reach_query_takes_all_orders(spark, tmp_path):
    """The traversal over whole tables against a search by brute force: cycles, keys far apart, nulls, parts that nothing leads to."""
    from loomstone import queries

    rnd = random.Random(5)
    keys = [rnd.randrange(10**6) for _ in range(300)]
    lines = [(k, rnd.randrange(200)) for k in keys for _ in range(2)] + [(keys[0], None), (None, 3), (keys[1], keys[1]), (5_000_000, 999), (5_000_001, 999)]
    spark.createDataFrame([(k,) for k in [*keys, 5_000_000, None]], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    near = {}
    for o, p in lines:
        if o is not None and p is not None:
            near.setdefault(f"o{o}", set()).add(f"p{p}")
            near.setdefault(f"p{p}", set()).add(f"o{o}")
    want, todo = {f"o{min(keys)}": 0}, [f"o{min(keys)}"]
    for n in todo:
        for m in near[n] - set(want):
            want[m] = want[n] + 1
            todo.append(m)
    got = queries.QUERIES["frontier_reach_all"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and dict(map(tuple, got)) == want and max(want.values()) > 3


def test_chain(spark):
    pages = spark.createDataFrame([("http://h/", "<ul><li class=next><a href='p2.html'>n</a></ul>"), ("http://h/p2.html", "<li class='next x'><a href='/p3.html'>n</a>"), ("http://h/p3.html", "<p>end"), ("http://h/other", None)], "url string, html string")
    assert {r["url"]: r["depth"] for r in crawl.chain(pages, "http://h/").collect()} == {"http://h/": 0, "http://h/p2.html": 1, "http://h/p3.html": 2}


def test_listing_and_detail(spark):
    lists = [("http://h/l/1.html", """<article class="product_pod"><h3><a title="Full one" href="../d/1.html">Full..</a></h3><p class="price_color">£5.00</p><p class="availability"> In stock </p><img src="t.jpg"></article>
      <article class="product_pod"><h3><a title="No link">x</a></h3></article><article class="product_pod"><h3><a href="/d/2.html"> Anchor\n text </a></h3></article>""")]
    details = [
        ("http://h/d/1.html", """<ul class="breadcrumb"><li><a>Home</a><li><a>Books</a><li><a> Poetry </a><li>T</ul><div id="product_gallery"><img src="/f.jpg"></div><div class="product_main"><h1>H</h1><p class="price_color">£9</p><p class="instock availability"><i></i> In stock (3) </p></div>
         <div id="product_description"><h2>D</h2></div><p>Some <i>text</i></p><table class="table table-striped"><tr><th>Tax</th><td>0</td></tr><tr><th>UPC</th><td>u1</td></tr></table><div class="tile"><p class="availability">Gone</p></div>"""),
        ("http://h/d/2.html", """<ul class="breadcrumb"><li><a>Home</a><li><a>Books</a></ul><div class="product_main"><h1>Two</h1></div><table class="table-striped"><tr><th>UPC</th><td>a</td></tr><tr><th></th><td>?</td></tr><tr><th>UPC</th><td>u2</td></tr><tr><th>Price (incl. tax)</th><td>$7,5</td></tr></table>"""),
    ]
    make = lambda x: spark.createDataFrame(x, "url string, html string")
    listed = crawl.listing(make(lists))
    assert [tuple(r) for r in crawl.rejected_pods(listed).collect()] == [("http://h/l/1.html", 1)]
    got = {r["upc"]: r.asDict() for r in crawl.merged(listed, crawl.detail(make(details))).collect()}
    one, two = got["u1"], got["u2"]
    assert (one["title"], one["price"], one["currency"], one["availability"], one["category"], one["description"], one["image_url"]) == ("Full one", 5.0, "GBP", "In stock (3)", "Poetry", "Some", "http://h/f.jpg")
    assert (two["title"], two["price"], two["currency"], two["availability"], two["category"], two["description"], two["image_url"]) == ("Anchor text", 7.5, "USD", None, None, None, "http://h/l/1.html")


def test_links_and_cases(spark, tmp_path):
    path = tmp_path / "links.txt"
    path.write_text("Search URLs\n===\nhttps://h/s?x=1\n\n----\nTitle URLs:\n--\nhttps://h/a for (Ann B) search\nhttps://h/b for adidas\n")
    got = [(r["section"], r["url"], r["annotation"]) for r in io.links(io.numbered_lines(spark, str(path))).orderBy("line_no").collect()]
    assert got == [("Search URLs", "https://h/s?x=1", None), ("Title URLs:", "https://h/a", "Ann B"), ("Title URLs:", "https://h/b", "adidas")]
    good, bad = io.case_lines(spark.createDataFrame([("# x",), ("a  u v",), ("alone",), ("",)], "value string"))
    assert [tuple(r) for r in good.collect()] == [("a", "u v")] and bad.count() == 1


def test_sitemap(spark, tmp_path):
    path = tmp_path / "map.xml"
    path.write_text('<urlset xmlns:image="i"><url><loc>http://h/products/a</loc><lastmod>2024-02-03</lastmod><image:image><image:loc>http://h/products/i.jpg</image:loc></image:image></url><url><loc>http://h/b</loc></url></urlset>')
    rows = io.sitemap(spark, str(path))
    assert sorted(tuple(r) for r in rows.collect()) == [("http://h/b", None), ("http://h/products/a", datetime.date(2024, 2, 3))] or rows.count() == 2
    assert io.newer(rows, datetime.date(2024, 1, 1)).count() == 1
    assert spark.createDataFrame([(path.read_text(),)], "x string").select(io.product_count(F.col("x"))).first()[0] == 1


def test_pages_that_cannot_be_read_stop_nothing(spark):
    rows = [("s", 1, '{"products":["a"]}'), ("s", 2, None), ("s", 3, '{"products":["b"]}'), ("s", 4, '{"products":'), ("s", 5, "{}"), ("s", 6, '{"products":["c"]}'), ("s", 7, '{"products":[]}'), ("s", 8, '{"products":["d"]}')]
    got = io.paged_items(spark.createDataFrame(rows, "source string, page int, body string"))
    assert [r["item"] for r in got.orderBy("page").collect()] == ["a", "b", "c"]
    with pytest.raises(ValueError):
        io.paged_items(spark.createDataFrame(rows, "source string, page int, body string"), "$.products is empty")


def test_hints(spark):
    urls = [("any", "https://x.example/"), ("catalog", "https://x.example/"), ("search", "https://www.shop.example.com/p/a-b/ppr1"), ("product", "https://www.shop.example.com/p/a-b/ppr1")]
    got = spark.createDataFrame(urls, "kind string, url string").select(U.UrlRules().check("kind", "url").alias("c")).select("c.*").collect()
    assert [r["hint"] for r in got] == [*(U.HINTS[k] for k in ("any", "none")), U.HINTS["others"] + "product, titles", None]


def test_deep_input_is_no_failure(spark):
    deep = "<i>" * 30_000 + "<b>x" + "[" * 100
    row = spark.createDataFrame([(deep, "[" * 50_000 + "]" * 50_000, '{"a":1}')], "h string, j string, k string")
    got = row.select(H.html_extract({"b": "b", "all": "i b::text"})("h").alias("e"), J.json_path("$..a")(F.array("j", "k")).alias("v")).first()
    assert got["e"]["b"][0].startswith("x[") and got["e"]["all"][0].startswith("x[") and got["v"] == ["1"]


def test_joined_references(spark):
    base = "https://h/a/b?c#d"
    refs = ["../x", "?q", "", "/r", "p", "//c/e", "http://z/", "data:,x", None, "http://["]
    got = spark.createDataFrame([(base, refs), (None, ["p", "//c"]), (base, None)], "b string, r array<string>").select(U.url_join_all("b", "r")).collect()
    assert got[0][0] == ["https://h/x", "https://h/a/b?q", "https://h/a/b?c#d", "https://h/r", "https://h/a/p", "https://c/e", "http://z/", "data:,x", None, "http://["]
    assert got[1][0] == [None, "https://c"] and got[2][0] is None


def test_a_long_chain_keeps_the_plan_short(spark):
    edges = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(30)], "src string, dst string")
    got = crawl.reach(edges, spark.createDataFrame([("n0",)], "node string"))
    assert {r["node"]: r["depth"] for r in got.collect()} == {f"n{k}": k for k in range(31)}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= crawl.FOLD


def test_reach_shuffles_the_links_once(spark):
    """Rounds too large for a broadcast shuffle what they lead to, not all links again."""
    shuffled = lambda: spark._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    other = spark.range(50_000).select(F.md5(F.col("id").cast("string")).alias("src"), F.md5((-F.col("id") - 1).cast("string")).alias("dst"))
    edges = io.written(spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(6)], "src string, dst string").unionByName(other), "links")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        start = shuffled()
        edges.repartition(4, "src").write.format("noop").mode("overwrite").save()
        once, start = shuffled() - start, shuffled()
        got = crawl.reach(edges, spark.createDataFrame([("n0",)], "node string"))
        assert 0 < shuffled() - start < 1.5 * once
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {r["node"]: r["depth"] for r in got.collect()} == {f"n{k}": k for k in range(7)}
    assert not [x for x in spark.catalog.listTables() if x.name.startswith(("links_", "frontier_"))]


@pytest.mark.parametrize("name", ["config_extraction", "absolutized_images", "json_descent", "balanced_objects"])
def test_pages_made_from_one_file_are_read_in_all_tasks(spark, name):
    from loomstone import queries

    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    at = plan.index("RoundRobinPartitioning(4)")
    assert plan.rindex("EvalPython") < at  # the plan shows the last step first


def test_json_paths_read_each_text_once(spark):
    paths = {"a": "$.a", "all": "$..a", "b": "$[*].b", "none": "$.x.y"}
    texts = [['{"a":1,"c":[{"a":"z"}]}', "no", '[{"b":2},{"a":null}]'], ["[" * 50_000, None], [], None]
    df = spark.createDataFrame([(x,) for x in texts], "t array<string>")
    got = df.select(J.json_paths(paths)("t").alias("v"), *(J.json_path(p)("t").alias(n) for n, p in paths.items())).collect()
    assert all(r["v"].asDict() == {n: r[n] for n in paths} for r in got)
    assert got[0]["v"]["a"] == ["1"] and got[0]["v"]["all"] == ["1", "z"] and got[3]["v"]["a"] is None
    page = [("http://h/", "<h1>x</h1>", '{"t":"T","p":"1"}')]
    config = {"extraction": {n: {"sources": [{"type": "json_endpoint", "request": "body", "path": f"$.{n[0]}"}]} for n in ("title", "price")}}
    out = Plan(config).apply(spark.createDataFrame(page, "url string, html string, body string"))
    assert out.first()[3:] == ("T", "1")
    assert out._jdf.queryExecution().executedPlan().toString().count("run(array(body") == 1


def test_settings():
    got = io.FetchSettings.of({"delay": 1.0, "retry_statuses": [500]})
    assert got.delay == 1.0 and got.retry_statuses == (500,) and got.concurrency == 8
    with pytest.raises(ValueError):
        io.FetchSettings.of({"delays": 1.0})


def test_export_and_gate(spark, tmp_path):
    df = spark.createDataFrame([("T é", 1.5, "u")], "title string, price double, upc string")
    path = str(tmp_path / "out")
    io.export(df, path)
    line = "".join(open(os.path.join(path, f), encoding="utf-8").read() for f in os.listdir(path) if f.startswith("part-"))  # a part may be empty
    assert list(json.loads(line)) == [f.name for f in io.ITEM.fields] and "é" in line and '"currency":null' in line
    for kind in ("csv", "xml", "parquet"):
        io.export(df, str(tmp_path / kind), kind)
    fails = lambda got: [quality.run_gate(got, 100)]
    assert not io.gated_export(df.limit(0), path, fails) and io.read_items(spark, path).count() == 1
    assert io.gated_export(df.unionByName(df), path, lambda got: [quality.run_gate(got, 2)]) and io.read_items(spark, path).count() == 2
    io.export(df, path, mode="append")
    assert io.read_items(spark, path).count() == 3


def test_stream_dedup(spark, tmp_path):
    rows = [("a", 1), ("a", 2), (None, 3), (None, 4)]
    spark.createDataFrame(rows, "k string, id long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, id long").parquet(str(tmp_path / "in"))
    dedup.run_once(dedup.first_seen(stream, F.col("k"), "id"), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == 3 and sum(r["k"] is None for r in got) == 2


def test_stream_dedup_first_wins(spark, tmp_path):
    """In a batch the smallest id of a key wins, whatever the order of rows and files; a later batch changes nothing."""
    def add(rows):
        spark.createDataFrame(rows, "k string, id long").repartition(4).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("k string, id long").parquet(str(tmp_path / "in"))
        dedup.run_once(dedup.first_seen(stream, F.col("k"), "id"), str(tmp_path / "out"), str(tmp_path / "cp"))
        return sorted((r["k"] or "", r["id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    first = [("", 7), ("", 3000), *((f"k{n}", 10 + n) for n in range(5))]
    assert add([(None, 7), (None, 3000), *((f"k{i % 5}", i) for i in range(2009, 9, -1))]) == sorted(first)
    assert add([("k0", 1), ("new", 2), (None, 4)]) == sorted([*first, ("new", 2), ("", 4)])


def test_stream_dedup_query_streams_all(spark, tmp_path, monkeypatch):
    """The registered query streams every row of events and keeps those without a type."""
    from loomstone import queries

    rows = [(i, None if i % 7 == 0 else f"t{i % 3}") for i in range(500, 0, -1)]
    spark.createDataFrame(rows, "event_id long, event_type string").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    run, seen = dedup.run_once, {}

    def watched(stream, path, checkpoint):
        q = run(stream, path, checkpoint)
        seen.update(rows=sum(p["numInputRows"] for p in q.recentProgress), path=path)
        return q

    monkeypatch.setattr(dedup, "run_once", watched)
    got = sorted(map(tuple, queries.stream_dedup(spark, str(tmp_path)).collect()))
    assert got == [(f"t{n}", min(i for i, k in rows if k == f"t{n}")) for n in range(3)]
    assert seen["rows"] == len(rows)
    assert spark.read.parquet(seen["path"]).where("event_type is null").count() == sum(k is None for _, k in rows)


def test_config(spark):
    config = {
        "url_patterns": {"product": [r"^https://h/products/(?P<handle>[a-z0-9-]+)$"]},
        "extraction": {
            "companion_requests": {"product_json": {"required": False}},
            "title": {"sources": [{"type": "json_endpoint", "request": "product_json", "path": "$.product.title"}, {"type": "json_ld", "path": "$[?(@['@type'] in ['Product','ProductGroup'])].name"}, {"type": "css", "selector": "h1", "get": "text"}], "post_process": ["strip", "collapse_whitespace"]},
            "price": {"sources": [{"type": "json_ld", "path": "$..offers.price"}, {"type": "json_in_html", "locator": r"var meta\s*=\s*(?P<json>\{)", "path": "$.p[0].price", "transform": "divide_by_100"}], "output_type": "float"},
            "images": {"sources": [{"type": "regex", "pattern": r"https://c/[^\"' ]+\.jpg(?:\?v=\d+)?"}], "post_process": ["strip_query_string", "deduplicate"], "min_expected": 1},
            "videos": {"sources": [{"type": "css", "selector": "video source", "get": "attr:src"}], "post_process": ["absolutize"], "prefer_format": "mp4", "ignore_patterns": [r"\.m3u8$"]},
            "variants": {
                "source": {"type": "json_endpoint", "request": "product_json", "items_path": "$.product.variants[*]"},
                "fields": {"sku": "$.sku", "price": "$.price", "options": {"strategy": "zip_positional", "values_path": ["$.option1", "$.option2"]}, "image": {"strategy": "lookup"}},
            },
            "product_url": {"sources": [{"type": "template", "value": "https://h/products/{handle}"}, {"type": "css", "selector": 'link[rel="canonical"]', "get": "attr:href"}]},
        },
        "validation": {"response": {"expect_status": [200], "require_any": [{"type": "regex", "pattern": "<h1"}]}, "item": {"required_fields": ["title", "images"], "warn_if_missing": ["price"], "fail_run_if_missing_ratio": 0.4}, "run": {"expected_item_count": 4, "fail_if_below_ratio": 0.8}},
    }
    rows = [
        ("https://h/products/a", 200, "<h1> x </h1><p>https://c/1.jpg?v=2 https://c/1.jpg</p><video><source src='a.webm'><source src='/b.mp4'><source src='c.m3u8'></video>", '{"product":{"title":" T  a ","options":[{"name":"Size"},{"name":"Col"}],"variants":[{"sku":"s","price":"2.50","option1":"M","option2":null,"image_id":null}],"images":[{"id":1,"src":"i"}]}}'),
        ("https://h/x", 404, "<link rel='canonical' href='https://h/c'><script type='application/ld+json'>{\"@type\":\"Product\",\"name\":\"L\",\"offers\":{\"price\":3}}</script>", None),
        ("https://h/y", 200, "<h1>H</h1><script>var meta = {\"p\":[{\"price\":1250}]}; x</script>", None),
    ]
    pages = spark.createDataFrame(rows, "url string, status int, html string, product_json string")
    plan = Plan(config)
    got = [r.asDict() for r in plan.valid_response(plan.apply(pages)).orderBy("url").collect()]
    assert [g["title"] for g in got] == ["T a", "L", "H"] and [g["price"] for g in got] == [None, 3.0, 12.5]
    assert got[0]["images"] == ["https://c/1.jpg"] and got[0]["main_image"] == "https://c/1.jpg" and got[0]["videos"] == ["https://h/b.mp4", "https://h/products/a.webm"]
    assert got[0]["variants"][0].asDict() == {"sku": "s", "price": 2.5, "options": {"Size": "M"}, "image": "i"} and got[1]["variants"] is None
    assert [g["product_url"] for g in got] == ["https://h/products/a", "https://h/c", None] and [g["valid"] for g in got] == [True, False, True]
    items = plan.apply(pages)
    assert {r["field"]: r["failed"] for r in plan.item_gate(items).collect()} == {"title": False, "images": True}
    assert {r["field"] for r in plan.warnings(items).collect()} == {"price"} and plan.run_gate(items).first()["failed"]
    with pytest.raises(ValueError):
        Plan({"extraction": {"t": {"sources": [{"type": "xpath"}]}}})


def test_html_select_null(spark):
    assert spark.createDataFrame([(None,), ("<a href=x>",)], "h string").select(H.html_select("h", "a::attr(href)").alias("v")).collect()[1]["v"] == ["x"]


def test_companion(spark):
    plan = Plan({"url_patterns": {"product": [r"^https://h/products/(?P<handle>[a-z]+)$"]}, "extraction": {}})
    pages = spark.createDataFrame([("https://h/products/a",), ("https://h/products/b",), ("https://h/x",)], "url string")
    bodies = spark.createDataFrame([("a", 200, "A"), ("a", 200, "A"), ("b", 404, "B")], "handle string, status int, body string")
    got = {r["url"]: r["product_json"] for r in with_companion(pages, bodies, "product_json", plan).collect()}
    assert got == {"https://h/products/a": "A", "https://h/products/b": None, "https://h/x": None}
