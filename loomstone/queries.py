"""The library's operators over the supplied tables, each with SQL that must give the same rows.

Where a table lacks an operator's input, query and SQL build the same input
from the table's columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions import html as H
from loomstone.functions import jsonx as J
from loomstone.functions import text as X
from loomstone.functions import urls as U
from loomstone.operators import crawl, quality
from loomstone.plans.extraction import Plan, with_companion
from loomstone.sources import io
from loomstone.streaming import dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
RULES = U.UrlRules()
SITE = "https://www.shop.example.com"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


t = io.table


def _spread(spark, d, name):
    """A small table from which larger pages or texts are made: in all tasks, not in the few that its files make."""
    return t(spark, d, name).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


# --- pages ------------------------------------------------------------------

WS = r"E' \t\n\r\f\v'"


@query(rf"""select page_id, case when regexp_matches(html, '(?is)<title>.*?</title>') then left(trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), {WS}), 58) end as title from pages""")
def page_title(spark, d):
    return t(spark, d, "pages").select("page_id", H.title("html").alias("title"))


@query(rf"""select page_id, case when regexp_matches(html, '(?is)<h1[^>]*>.*?</h1>') then left(trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g'), {WS}), 58) end as h1 from pages""")
def page_h1(spark, d):
    return t(spark, d, "pages").select("page_id", H.h1("html").alias("h1"))


@query(r"""select page_id, len(regexp_extract_all(html, 'href="/'))::bigint as links, len(regexp_extract_all(html, '<p>'))::bigint as paragraphs, len(regexp_extract_all(html, '\.mp4'))::bigint as videos, octet_length(encode(html))::bigint as bytes from pages""")
def page_counts(spark, d):
    return t(spark, d, "pages").select("page_id", H.occurrences("html", 'href="/').alias("links"), H.occurrences("html", "<p>").alias("paragraphs"), H.occurrences("html", r"\.mp4").alias("videos"), F.octet_length("html").cast("long").alias("bytes"))


@query(r"""select page_id, len(list_distinct(regexp_extract_all(html, 'href="(/[^"]*)"', 1)))::bigint as anchors, coalesce(nullif(array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'href="(/[^"]*)"', 1))), ', '), ''), 'none') as listed from pages""")
def page_anchor_set(spark, d):
    found = H.distinct_matches("html", 'href="(/[^"]*)"', 1)
    return t(spark, d, "pages").select("page_id", F.size(found).cast("long").alias("anchors"), H.listed(found).alias("listed"))


@query("""select page_id, regexp_matches(lower(left(html || case when page_id % 3 = 0 then '<p>Attention Required</p>' else '' end, 5000)), 'just a moment|access denied|checking your browser|attention required|enable javascript and cookies') as blocked, case when not regexp_matches(lower(left(html || case when page_id % 3 = 0 then '<p>Attention Required</p>' else '' end, 5000)), 'just a moment|access denied|checking your browser|attention required|enable javascript and cookies') then contains(html, '<h1') and contains(html, 'application/ld+json') end as meaningful, page_id % 3 = 0 as rejected from pages""")
def page_challenge(spark, d):
    html = F.concat("html", F.when(F.col("page_id") % 3 == 0, "<p>Attention Required</p>").otherwise(""))
    p = t(spark, d, "pages").withColumn("blocked", H.challenged(html))
    return p.select("page_id", "blocked", F.when(~F.col("blocked"), H.meaningful("html")).alias("meaningful"), H.rejected(html, ("(?i)attention required",)).alias("rejected"))


@query(r"""select page_id, md5(coalesce(nullif(trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '[\s\x0b\x1c-\x1f]+', ' ', 'g')), ''), '')) as digest from pages""")
def page_clean_text(spark, d):
    return t(spark, d, "pages").select("page_id", F.md5(F.coalesce(X.clean_one(X.without_tags("html")), F.lit(""))).alias("digest"))


@query("""select page_id, label, value from (select page_id, unnest(['article', 'JSON-LD', 'canonical', 'style']) as label, unnest([case when contains(html, '<article') then 'present' else 'absent' end, case when contains(html, 'application/ld+json') then 'present' else 'absent' end, case when regexp_matches(html, '(?i)rel=[''"]canonical[''"]') then 'present' else 'absent' end, case when contains(html, '<style') then 'present' else 'absent' end]) as value from pages)""")
def page_report(spark, d):
    canon = F.when(H.has_attribute("html", "rel", "canonical"), "present").otherwise("absent")
    p = t(spark, d, "pages").select("page_id", H.marker("html", "<article").alias("a"), H.marker("html", "application/ld+json").alias("b"), canon.alias("c"), H.marker("html", "<style").alias("s"))
    return p.selectExpr("page_id", "stack(4, 'article', a, 'JSON-LD', b, 'canonical', c, 'style', s) as (label, value)")


CLASSES = {"exclude": (r"\?.*utm_", "/cart"), "search": (r"\?page=\d+",), "product": (r"^https?://[^/]+/[a-z]{2}/(\d+)/?(?:\?.*)?$",)}


@query(r"""select page_id, case when regexp_matches(url, '\?.*utm_') or regexp_matches(url, '/cart') then 'exclude' when regexp_matches(url, '\?page=\d+') then 'search' when regexp_matches(url, '^https?://[^/]+/[a-z]{2}/(\d+)/?(?:\?.*)?$') then 'product' else 'other' end as class, case when regexp_matches(url, '^https?://[^/]+/[a-z]{2}/(\d+)/?(?:\?.*)?$') then 'https://www.shop.example.com/products/' || regexp_extract(url, '^https?://[^/]+/[a-z]{2}/(\d+)/?(?:\?.*)?$', 1) end as canonical, regexp_replace(url, '\?.*$', '') as bare, regexp_matches(url, '^https?://([^/]*\.)?example\.com(/|$)') as allowed, starts_with(url, 'https://') as absolute from pages""")
def page_url_class(spark, d):
    p = t(spark, d, "pages")
    return p.select("page_id", U.page_class("url", CLASSES["search"], CLASSES["product"], CLASSES["exclude"]).alias("class"), U.canonical("url", CLASSES["product"][0], f"{SITE}/products/{{handle}}").alias("canonical"), X.without_query("url").alias("bare"), U.allowed("url", "example.com").alias("allowed"), U.absolute("url").alias("absolute"))


@query(r"""select page_id, array_to_string(regexp_extract_all(html, '<li><a href="([^"]*)">', 1), ' ') as hrefs, len(regexp_extract_all(html, '<li><a href="([^"]*)">', 1))::bigint as n from pages""")
def html_select_links(spark, d):
    got = H.html_select("html", "nav li > a::attr(href)")
    return t(spark, d, "pages").select("page_id", got.alias("v")).select("page_id", F.array_join("v", " ").alias("hrefs"), F.size("v").cast("long").alias("n"))


@query(r"""select page_id, case when h = '' then url when starts_with(h, '/') then regexp_extract(url, '^(https?://[^/]*)', 1) || h else h end as joined from (select page_id, url, regexp_extract(html, '<a href="([^"]*)">', 1) as h from pages)""")
def url_resolved(spark, d):
    p = t(spark, d, "pages").select("page_id", "url", F.regexp_extract("html", '<a href="([^"]*)">', 1).alias("h"))
    return p.select("page_id", U.url_join("url", "h").alias("joined"))


@query("""select page_id, case when octet_length(encode(html)) > 3 * m or octet_length(encode(html)) * 3 < m then 'odd' else 'usual' end as size from pages, (select avg(octet_length(encode(html))) as m from pages)""")
def page_size_anomaly(spark, d):
    p = t(spark, d, "pages")
    odd = quality.size_anomalies(p).select("page_id", F.lit("odd").alias("size"))
    return p.select("page_id").join(odd, "page_id", "left").select("page_id", F.coalesce("size", F.lit("usual")).alias("size"))


# --- prices and embedded values -----------------------------------------------


@query(r"""with c as (select p_partkey, case p_partkey % 6 when 0 then '£' || p_retailprice when 1 then '$' || p_retailprice when 2 then '€ ' || replace(p_retailprice::varchar, '.', ',') when 3 then 'Â£' || p_retailprice when 4 then p_size || ' kr' else 'n/a' end as raw from part) select p_partkey, nullif(replace(regexp_extract(raw, '([^\d\s]*)\s*(\d+(?:[.,]\d+)?)', 2), ',', '.'), '')::double as price, case when regexp_matches(raw, '\d') then case when contains(regexp_extract(raw, '([^\d\s]*)\s*(\d+(?:[.,]\d+)?)', 1), '£') then 'GBP' when contains(regexp_extract(raw, '([^\d\s]*)\s*(\d+(?:[.,]\d+)?)', 1), '$') then 'USD' when contains(regexp_extract(raw, '([^\d\s]*)\s*(\d+(?:[.,]\d+)?)', 1), '€') then 'EUR' end end as currency from c""")
def parse_price(spark, d):
    k, price = F.col("p_partkey") % 6, F.col("p_retailprice").cast("string")
    raw = F.when(k == 0, F.concat(F.lit("£"), price)).when(k == 1, F.concat(F.lit("$"), price)).when(k == 2, F.concat(F.lit("€ "), F.translate(price, ".", ","))).when(k == 3, F.concat(F.lit("Â£"), price)).when(k == 4, F.concat(F.col("p_size"), F.lit(" kr"))).otherwise("n/a")
    return t(spark, d, "part").select("p_partkey", X.parse_price(raw).alias("p")).select("p_partkey", "p.price", "p.currency")


@query("""select p_partkey, case when p_partkey % 5 = 4 then 'c.jpg' when p_size > 51 - p_size then 'a.jpg' when p_size < 51 - p_size then 'b.jpg' else 'a.jpg' end as image from part""")
def largest_image(spark, d):
    k = F.col("p_partkey") % 5
    html = F.when(k == 4, F.lit("<img src=' c.jpg '>")).otherwise(F.concat(F.lit("<img src='x.jpg' srcset=\"a.jpg "), F.col("p_size"), F.lit("w,\n b.jpg "), 51 - F.col("p_size"), F.lit("w, d.jpg\">")))
    return t(spark, d, "part").select("p_partkey", H.largest_image(html).alias("image"))


@query(r"""with c as (select doc_id, trim(case when ends_with(x, '...more') then left(x, length(x) - 7) else x end, E' \t\n\r\f\v') as b from (select doc_id, case when doc_id % 2 = 0 then left(text, 60) || ' ' || text || '...more' else text end as x from documents)), p as (select doc_id, b, instr(substr(b, 2), left(b, 40)) as k from c) select doc_id, md5(coalesce(nullif(trim(case when b <> '' and k > 0 then substr(b, k + 1) else b end, E' \t\n\r\f\v'), ''), '-')) as digest from p""")
def strip_preview(spark, d):
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(F.left("text", F.lit(60)), F.lit(" "), F.col("text"), F.lit("...more"))).otherwise(F.col("text"))
    return t(spark, d, "documents").select("doc_id", F.md5(F.coalesce(X.strip_preview(raw), F.lit("-"))).alias("digest"))


@query("""select p_partkey, case when p_partkey % 4 < 3 then 'https://v/' || p_partkey || case when p_partkey % 4 = 1 then '.MP4?sig=1' else '.mp4' end end as video from part""")
def video_url(spark, d):
    k = F.col("p_partkey")
    html = F.when(k % 4 == 3, F.lit('<video poster="a.jpg"><track src="c.vtt">')).otherwise(F.concat(F.lit("<video poster='p.jpg'><source data-v"), F.when(k % 4 == 2, "=\"").otherwise("='"), F.lit("https://v/"), k, F.when(k % 4 == 1, ".MP4?sig=1").otherwise(".mp4"), F.when(k % 4 == 2, "\">").otherwise("'>")))
    return t(spark, d, "part").select("p_partkey", H.video_url(html).alias("video"))


@query("""select o_orderkey, case when o_orderkey % 3 > 0 then (o_orderkey % 24 + 1)::int end as current_page, case when o_orderkey % 3 > 0 then (o_orderkey % 24 + 9)::int end as total_pages from orders""")
def pagination(spark, d):
    k = F.col("o_orderkey")
    html = F.when(k % 3 == 0, F.lit("<p>Pages: none</p>")).otherwise(F.concat(F.lit("<p>PAGE\n  "), k % 24 + 1, F.lit("\n of "), k % 24 + 9, F.lit("</p>")))
    return t(spark, d, "orders").select("o_orderkey", H.pagination(html).alias("p")).select("o_orderkey", "p.current_page", "p.total_pages")


@query("""select p_partkey, case p_partkey % 4 when 0 then 'https://i/' || p_name || '.jpg' end as image from part""")
def product_json_path(spark, d):
    k = F.col("p_partkey") % 4
    body = F.when(k == 0, F.concat(F.lit('{"media":{"thumbnail":{"url":"t}"},"primary":{"url":"https://i/'), F.col("p_name"), F.lit('.jpg"}}}; var x = {};')))
    body = body.when(k == 1, F.lit('{"media":{"primary":{"url":7}}};')).when(k == 2, F.lit('{"media":{"primary":')).otherwise('{"media":{"primary":{"url":null}}}')
    return t(spark, d, "part").select("p_partkey", J.primary_image(F.concat(F.lit("<script>window.PRODUCT_DATA = "), body, F.lit("</script>"))).alias("image"))


@query("""select event_id, json_extract_string(props, '$.k')::bigint as k from events""")
def event_property(spark, d):
    return t(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k"))


@query("""select p_partkey, p_name || ', deep ' || p_size as found, 1::bigint as offers from part""")
def json_descent(spark, d):
    ld = F.concat(F.lit('[{"@type":"Thing","name":"no"},{"@type":"Product","name":"'), F.col("p_name"), F.lit('","offers":{"price":'), F.col("p_size"), F.lit("}}]"))
    p = _spread(spark, d, "part").select("p_partkey", F.array(ld).alias("ld"))
    p = p.select("p_partkey", J.json_path("$[?(@['@type'] in ['Product','ProductGroup'])].name")("ld").alias("name"), J.json_path("$..offers.price")("ld").alias("price"))
    return p.select("p_partkey", F.concat(F.get("name", F.lit(0)), F.lit(", deep "), F.get("price", F.lit(0))).alias("found"), F.size("price").cast("long").alias("offers"))


@query("""select p_partkey, p_name as title, 'Size:3' as options, 2::bigint as variants, 1::bigint as images from part""")
def product_summary(spark, d):
    body = F.concat(F.lit('{"product":{"title":"'), F.col("p_name"), F.lit('","options":[{"name":"Size","values":["S","M","L"]}],"variants":[{"id":1},{"id":2}],"images":[{"id":9,"src":"a"}]}}'))
    s = t(spark, d, "part").select("p_partkey", J.product_summary(J.product(body)).alias("s"))
    return s.select("p_partkey", "s.title", F.array_join(F.transform("s.options", lambda o: F.concat(o["name"], F.lit(":"), o["values"])), ",").alias("options"), F.col("s.variants").cast("long").alias("variants"), F.col("s.images").cast("long").alias("images"))


# --- URLs ---------------------------------------------------------------------

_URL_SQL = """with u as (select p_partkey, case p_partkey % 8
 when 0 then 'https://www.shop.example.com/g/brands/' || replace(p_name, ' ', '-') || '?id=cat' || p_size
 when 1 then 'http://shop.example.com/g/shoes?id=dept' || p_size || '&amp;brand=' || replace(p_name, ' ', '+')
 when 2 then 'https://www.shop.example.com/p/' || replace(p_name, ' ', '-') || '/ppr' || p_partkey || '?t=regular'
 when 3 then 'https://www.shop.example.com/s?searchTerm=' || replace(p_name, ' ', '+') || '%3D&page=2'
 when 4 then 'https://images.example.com/Shop/DP' || p_partkey || 'Mwidth=550&amp;height=550'
 when 5 then 'https://videos.example.com/Shop/91A_V-' || p_partkey
 when 6 then 'https://www.shop.example.com/g/shoes?xbrand=no&id=cat' || p_size
 else 'https://www.shop.example.com/cart/' || p_partkey end as url from part) """


def _urls(spark, d):
    k, name, size = F.col("p_partkey"), F.col("p_name"), F.col("p_size").cast("string")
    dash, plus = F.translate(name, " ", "-"), F.translate(name, " ", "+")
    s = lambda *x: F.concat(*(F.lit(i) if isinstance(i, str) else i for i in x))
    url = (
        F.when(k % 8 == 0, s(SITE + "/g/brands/", dash, "?id=cat", size)).when(k % 8 == 1, s("http://shop.example.com/g/shoes?id=dept", size, "&amp;brand=", plus))
        .when(k % 8 == 2, s(SITE + "/p/", dash, "/ppr", k, "?t=regular")).when(k % 8 == 3, s(SITE + "/s?searchTerm=", plus, "%3D&page=2"))
        .when(k % 8 == 4, s("https://images.example.com/Shop/DP", k, "Mwidth=550&amp;height=550")).when(k % 8 == 5, s("https://videos.example.com/Shop/91A_V-", k))
        .when(k % 8 == 6, s(SITE + "/g/shoes?xbrand=no&id=cat", size)).otherwise(s(SITE + "/cart/", k))
    )
    return t(spark, d, "part").select("p_partkey", url.alias("url"))


@query(_URL_SQL + """select p_partkey, case p_partkey % 8 when 0 then 'catalog,titles' when 1 then 'catalog,titles' when 2 then 'product,titles' when 3 then 'search' when 4 then 'images' when 5 then 'videos' when 6 then 'catalog,titles' else '' end as matched from u""")
def url_matches(spark, d):
    return _urls(spark, d).select("p_partkey", F.array_join(RULES.matched("url"), ",").alias("matched"))


@query(_URL_SQL + r""", r as (select p_partkey, case when p_partkey % 8 = 2 then regexp_extract(url, '/p/([a-z0-9-]+)/', 1) when contains(url, '/g/') then coalesce(nullif(regexp_extract(url, '[?;&]brand=([^&#]+)', 1), ''), regexp_extract(url, '/g/(?:[a-z0-9-]+/)*([a-z0-9-]+)\?', 1)) end as raw from u) select p_partkey, list_aggregate(list_transform(regexp_extract_all(replace(replace(raw, '-', ' '), '+', ' '), '[a-zA-Z]+|[^a-zA-Z]+'), lambda x: upper(x[1]) || lower(x[2:])), 'string_agg', '') as title from r""")
def url_title(spark, d):
    return _urls(spark, d).select("p_partkey", RULES.title("url").alias("title"))


@query(_URL_SQL + r"""select p_partkey, case when p_partkey % 8 in (0, 1, 6) then regexp_extract(url, '[?;&]id=((?:cat|dept)\d+)', 1) end as catalog_id, case when p_partkey % 8 = 2 then 'ppr' || p_partkey end as product_id, case when p_partkey % 8 = 4 then 'DP' || p_partkey || 'M' end as image_id, case when p_partkey % 8 = 5 then '91A_V-' || p_partkey end as video_id, case when p_partkey % 8 = 3 then replace(split_part(split_part(url, '=', 2), '%', 1), '+', ' ') || '=' end as decoded_term from u""")
def url_extraction(spark, d):
    e = _urls(spark, d).select("p_partkey", RULES.extraction("url").alias("e"))
    return e.select("p_partkey", "e.catalog_id", "e.product_id", "e.image_id", "e.video_id", "e.decoded_term")


@query(_URL_SQL + """, c as (select p_partkey, url, ['catalog', 'search', 'product', 'titles', 'images', 'videos', 'any'][(p_partkey % 7 + 1)::int] as kind, case p_partkey % 8 when 0 then ['catalog','titles'] when 1 then ['catalog','titles'] when 2 then ['product','titles'] when 3 then ['search'] when 4 then ['images'] when 5 then ['videos'] when 6 then ['catalog','titles'] else [] end as m from u) select p_partkey, kind, case when (kind = 'any' and len(m) > 0) or list_contains(m, kind) then 'PASS' else 'FAIL' end as verdict, array_to_string(case when kind = 'any' then m else list_filter(m, lambda x: x <> kind) end, ',') as also_matched from c""")
def url_check(spark, d):
    kind = F.element_at(F.array(*map(F.lit, (*U.KINDS, "any"))), (F.col("p_partkey") % 7 + 1).cast("int"))
    c = _urls(spark, d).select("p_partkey", kind.alias("kind"), "url").withColumn("c", RULES.check("kind", "url"))
    return c.select("p_partkey", "kind", "c.verdict", F.array_join("c.also_matched", ",").alias("also_matched"))


@query(_URL_SQL + """select p_partkey, case p_partkey % 3 when 0 then 'search' when 1 then 'images' else case when contains(url, '/g/') then 'catalog,titles' else 'product,titles' end end as kinds from u""")
def url_expected_kinds(spark, d):
    section = F.element_at(F.array(F.lit("Search URLs"), F.lit("Image URLs"), F.lit("Title URLs:")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return _urls(spark, d).select("p_partkey", F.array_join(U.expected_kinds(section, "url"), ",").alias("kinds"))


@query("""select passed, total, passed = total as ok from (select count(*) filter (where p_partkey % 8 < 7) as passed, count(*) as total from part)""")
def url_tally(spark, d):
    return quality.passed_tally(_urls(spark, d).select(RULES.check(F.lit("any"), "url")["passed"].alias("passed")))


@query("""select p_partkey, p_name || ' 100% a%zb' as term from part""")
def decoded_term(spark, d):
    return t(spark, d, "part").select("p_partkey", X.decoded_plus(F.concat(F.translate("p_name", " ", "+"), F.lit("%20100%+a%zb"))).alias("term"))


@query("""select * from (values ('Catalog', 1, 'https://h/a', 'Alfred'), ('Catalog', 2, 'https://h/b', null), ('Search', 1, 'https://h/c', 'x y')) v(section, n, url, annotation)""")
def link_sections(spark, d):
    lines = ["junk http://h/before", "Catalog", "=======", "https://h/a for (Alfred) search", "", "https://h/b", "-----", "Search", "  https://h/c   for x  y search "]
    got = io.links(spark.createDataFrame(list(enumerate(lines[1:])), "line_no int, value string"))
    return got.groupBy("section", "line_no", "url", "annotation").agg(F.lit(1)).select("section", F.when(F.col("url") == "https://h/b", 2).otherwise(1).alias("n"), "url", "annotation")


@query("""select 'images' as name, 'differs' as problem union all select 'other', 'unknown' union all select 'videos', 'missing'""")
def registry_drift(spark, d):
    rules = RULES.patterns()
    a = spark.createDataFrame(list(rules.items()), "name string, regex string")
    b = spark.createDataFrame([(f"{k}: {v}",) for k, v in {**rules, "images": "x", "other": "y"}.items() if k != "videos"], "value string")
    return io.drift(a, io.pattern_lines(b))


# --- items: dedup, coverage, gates, diffs ---------------------------------------


@query("""with p as (select * exclude (r) from (select *, row_number() over (order by p_partkey, c) as r from (select p.*, c from part p, (values (0), (1)) v(c)))), k as (select p_partkey, c, p_partkey * 2 + c as seq, case when p_partkey % 10 = 0 then null when p_partkey % 10 = 1 then '' else p_brand || p_type end as upc, case when p_partkey % 20 = 0 then null else 'u' || (p_partkey % 50) end as url from p), q as (select *, case when upc is not null and upc <> '' then upc else url end as key from k) select p_partkey, c::int as c, key from (select *, row_number() over (partition by key order by seq) as rn from q) where key is null or rn = 1""")
def dedup_keep_first(spark, d):
    return quality.keep_first(_keyed(spark, d), quality.item_key("upc", "url"), "seq").select("p_partkey", "c", quality.item_key("upc", "url").alias("key"))


def _keyed(spark, d):
    p = t(spark, d, "part").withColumn("c", F.explode(F.array(F.lit(0), F.lit(1))))
    k = F.col("p_partkey")
    upc = F.when(k % 10 == 0, None).when(k % 10 == 1, "").otherwise(F.concat("p_brand", "p_type"))
    return p.select("p_partkey", "c", (k * 2 + F.col("c")).alias("seq"), upc.alias("upc"), F.when(k % 20 != 0, F.concat(F.lit("u"), k % 50)).alias("url"))


@query("""with k as (select case when p_partkey % 10 > 1 then p_brand || p_type else case when p_partkey % 20 = 0 then null else 'u' || (p_partkey % 50) end end as key from part, (values (0), (1)) v(c)) select count(distinct key) as unique_keys, count(key) - count(distinct key) as dropped from k""")
def duplicate_tally(spark, d):
    return quality.duplicate_tally(_keyed(spark, d), quality.item_key("upc", "url"))


def _items(spark, d):
    docs, labels = t(spark, d, "documents"), t(spark, d, "labels")
    return docs.join(labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")), "doc_id", "left").withColumn("note", F.when(F.col("doc_id") % 7 == 0, "").otherwise("x"))


_ITEMS = "with l as (select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by 1), i as (select d.*, quality, toxic, case when d.doc_id % 7 = 0 then '' else 'x' end as note from documents d left join l using (doc_id)) "


@query(_ITEMS + """select field, missing, items from (select count(*) as items, count(*) filter (where text is null or text = '') as text, count(*) filter (where quality is null) as quality, count(*) filter (where note = '') as note from i) unpivot (missing for field in (text, quality, note)) where missing > 0""")
def field_coverage(spark, d):
    return quality.coverage(_items(spark, d), ("text", "quality", "note"))


@query(_ITEMS + """, g as (select lang, count(*) as items, round(avg((quality is not null)::int::double), 6) as quality, round(avg((note <> '')::int::double), 6) as note from i group by 1) select lang, field, share, items from g unpivot (share for field in (quality, note))""")
def coverage_by_group(spark, d):
    return quality.coverage_by(_items(spark, d), "lang", ("quality", "note")).withColumn("share", F.round("share", 6))


@query(_ITEMS + """select field, round(ratio, 6) as ratio, items, ratio > 0.1 as failed from (select count(*) as items, avg((quality is null)::int::double) as quality, avg((lang is null or lang = '')::int::double) as lang from i) unpivot (ratio for field in (quality, lang))""")
def missing_ratio_gate(spark, d):
    return quality.missing_gate(_items(spark, d), ("quality", "lang")).withColumn("ratio", F.round("ratio", 6))


@query("""select count(*) as items, count(*) / 20000.0::double as ratio, count(*) / 20000.0::double < 0.8 as failed from orders""")
def run_gate(spark, d):
    return quality.run_gate(t(spark, d, "orders"), 20000)


_RESP = "with r as (select page_id, url, case when page_id % 9 = 0 then 503 when page_id % 9 = 1 then 404 else 200 end as status, html from pages) "


def _responses(spark, d):
    k = F.col("page_id") % 9
    return t(spark, d, "pages").withColumn("status", F.when(k == 0, 503).when(k == 1, 404).otherwise(200))


@query(_RESP + """select status, count(*) as requests, round(avg(octet_length(encode(html))), 4) as mean_bytes, status = 503 as retryable from r group by 1""")
def run_stats(spark, d):
    return quality.run_stats(_responses(spark, d)).withColumn("mean_bytes", F.round("mean_bytes", 4))


@query("""with a as (select o_orderkey, o_totalprice, o_orderstatus from orders where o_orderkey % 11 > 0), b as (select o_orderkey, case when o_orderkey % 13 = 0 then null else o_totalprice end as o_totalprice, case when o_orderkey % 26 = 0 then 'X' else o_orderstatus end as o_orderstatus from orders where o_orderkey % 17 > 0), j as (select coalesce(a.o_orderkey, b.o_orderkey) as o_orderkey, case when a.o_orderkey is null then 'added' when b.o_orderkey is null then 'removed' when a.o_totalprice is distinct from b.o_totalprice or a.o_orderstatus is distinct from b.o_orderstatus then 'changed' end as change, array_to_string(list_filter([case when a.o_totalprice is distinct from b.o_totalprice then 'o_totalprice' end, case when a.o_orderstatus is distinct from b.o_orderstatus then 'o_orderstatus' end], lambda x: x is not null), ',') as f from a full join b on a.o_orderkey = b.o_orderkey) select o_orderkey, change, case when change = 'changed' then f end as fields from j where change is not null""")
def run_diff(spark, d):
    o, k = t(spark, d, "orders"), F.col("o_orderkey")
    new = o.where(k % 17 > 0).select("o_orderkey", F.when(k % 13 != 0, F.col("o_totalprice")).alias("o_totalprice"), F.when(k % 26 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    return quality.diff(o.where(k % 11 > 0), new, "o_orderkey", ("o_totalprice", "o_orderstatus")).withColumn("fields", F.array_join("fields", ","))


@query("""with a as (select o_orderkey as k, o_totalprice as v from orders where o_orderkey % 11 > 0), b as (select o_orderkey as k, case when o_orderkey % 13 = 0 then 0 else o_totalprice end as v from orders where o_orderkey % 17 > 0) select case when a.k is null then 'right only' when b.k is null then 'left only' when a.v is not distinct from b.v then 'agree' else 'differ' end as verdict, count(*) as n from a full join b on a.k = b.k group by 1""")
def cross_source_agreement(spark, d):
    o, k = t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v")), F.col("k")
    return quality.agreement(o.where(k % 11 > 0), o.where(k % 17 > 0).withColumn("v", F.when(k % 13 == 0, 0.0).otherwise(F.col("v"))), "k", "v")


@query("""with f as (select distinct p_partkey as k from part where p_partkey % 5 > 0), l as (select distinct p_partkey as k from part where p_partkey % 7 > 0) select (select count(*) from f) as found, (select count(*) from l) as listed, (select count(*) from l anti join f using (k)) as missed, (select count(*) from f anti join l using (k)) as extra""")
def completeness(spark, d):
    p = t(spark, d, "part").select(F.col("p_partkey").alias("k"))
    return quality.completeness(p.where("k % 5 > 0"), p.where("k % 7 > 0"), "k")


@query("""select page_id, (page_id % 10 = 0)::int * 6000::bigint as gap, case when page_id % 10 = 0 then 'investigate' else 'no gating' end as verdict from pages""")
def agent_gating(spark, d):
    p = t(spark, d, "pages").select("page_id", "html")
    other = p.withColumn("html", F.when(F.col("page_id") % 10 == 0, F.concat("html", F.repeat(F.lit("x"), F.lit(6000)))).otherwise(F.col("html")))
    return quality.same_size(p, other, "page_id")


@query("""select conv_id, turn, last_value(case when role = 'user' then turn end ignore nulls) over (partition by conv_id order by turn rows unbounded preceding) as asked_filled from conversations""")
def section_ffill(spark, d):
    c = t(spark, d, "conversations").withColumn("asked", F.when(F.col("role") == "user", F.col("turn")))
    return quality.forward_fill(c, "asked", "turn", ["conv_id"]).select("conv_id", "turn", "asked_filled")


@query("""select p_brand, min(p_partkey * 2) filter (where p_partkey % 2 = 0) as at, 'sitemap' as source from part group by 1 having count(*) filter (where p_partkey % 2 = 0) > 0 union all select p_brand, min(p_partkey * 2), 'endpoint' from part group by 1 having count(*) filter (where p_partkey % 2 = 0) = 0""")
def discovery_priority(spark, d):
    p = t(spark, d, "part").withColumn("source", F.when(F.col("p_partkey") % 2 == 0, "sitemap").otherwise("endpoint"))
    p = p.select("p_brand", (F.col("p_partkey") * 2).alias("at"), "source", (F.when(F.col("source") == "sitemap", 0).otherwise(1) * 10**9 + F.col("p_partkey")).alias("rank"))
    return quality.ranked_sources(p, "p_brand", "rank").select("p_brand", "at", "source")


@query("""select count(*) as items, count(distinct p_brand) as brands, array_to_string(list_sort(list_distinct(list(p_type)))[1:5], ',') as first_types, (select p_name from part order by p_retailprice desc, p_partkey limit 1) as dearest, count(*) filter (where contains(p_name, 'ring')) as rings, min(p_retailprice) as low, max(p_retailprice) as high from part""")
def analyst_summary(spark, d):
    p = t(spark, d, "part")
    first = p.select("p_type").distinct().orderBy("p_type").limit(5).agg(F.array_join(F.array_sort(F.collect_list("p_type")), ",").alias("first_types"))  # five rows
    row = p.agg(F.count("*").alias("items"), F.count_distinct("p_brand").alias("brands"), F.max_by("p_name", F.struct("p_retailprice", -F.col("p_partkey"))).alias("dearest"), F.count_if(F.col("p_name").contains("ring")).alias("rings"), F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"))
    return row.crossJoin(first)  # one row each


# --- nested product data ----------------------------------------------------------


def _orders_with_lines(spark, d):
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    return t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))


_LINES = "with o as (select l_orderkey, list({'n': l_linenumber, 'p': l_partkey, 's': l_suppkey, 'f': l_returnflag} order by l_linenumber, l_partkey, l_suppkey, l_returnflag) as lines from lineitem group by 1) "


@query(_LINES + """select l_orderkey, coalesce(list_filter(lines, lambda x: x.n = 3)[1].p, lines[1].p)::varchar as src from o""")
def variant_image_lookup(spark, d):
    o = _orders_with_lines(spark, d).withColumn("images", F.transform("lines", lambda x: F.struct(x["l_linenumber"].cast("long").alias("id"), x["l_partkey"].cast("string").alias("src"))))
    return o.select("l_orderkey", J.variant_image(F.struct(F.lit(3).cast("long").alias("image_id")), F.col("images")).alias("src"))


@query("""select p_partkey, case when p_size % 2 = 0 then 'Color=' || p_type || ',Size=' || p_size else 'Color=' || p_type end as options from part""")
def option_zip(spark, d):
    z = J.zipped(F.array(F.lit("Color"), F.lit("Size"), F.lit(None).cast("string")), F.array(F.col("p_type"), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")), F.lit("z")))
    return t(spark, d, "part").select("p_partkey", F.array_join(F.transform(F.map_entries(z), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("options"))


@query(_LINES + """select l_orderkey, len(list_filter(lines, lambda x: x.f = 'R')) > 0 as available, case when len(list_filter(lines, lambda x: x.f = 'R')) > 0 then 'in_stock' else 'out_of_stock' end as stock from o""")
def availability_any(spark, d):
    o = _orders_with_lines(spark, d).select("l_orderkey", J.any_true(F.transform("lines", lambda x: F.when(x["l_returnflag"] == "R", True).when(x["l_returnflag"] == "A", False))).alias("available"))
    return o.withColumn("stock", F.when(F.col("available"), "in_stock").otherwise("out_of_stock"))


# --- traversal, merging, sources and sinks ------------------------------------------


@query("""with recursive e as (select distinct 'o' || l_orderkey as o, 'p' || l_partkey as p from lineitem where l_orderkey is not null and l_partkey is not null), b as (select o as src, p as dst from e union all select p, o from e), r(node, depth) using key (node) as (select 'o' || min(o_orderkey), 0 from orders union select b.dst, min(r.depth) + 1 from r join b on b.src = r.node left join recurring.r k on k.node = b.dst where k.node is null group by 1) select node, depth::int as depth from r""")
def frontier_reach_all(spark, d):
    """All that the first order leads to where every order links to its parts and every part to its orders."""
    o, p = F.concat(F.lit("o"), "l_orderkey"), F.concat(F.lit("p"), "l_partkey")
    line = t(spark, d, "lineitem")
    edges = line.select(o.alias("src"), p.alias("dst")).unionByName(line.select(p.alias("src"), o.alias("dst")))
    first = t(spark, d, "orders").agg(F.concat(F.lit("o"), F.min("o_orderkey")).alias("node"))
    return crawl.reach(edges.where("src is not null and dst is not null"), first)


def _shop_pages(spark, d):
    p, k = _spread(spark, d, "part"), F.col("p_partkey")
    pod = F.concat(F.lit('<article class="product_pod"><img src="t/'), k, F.lit('.jpg"><h3><a href="../item/'), k, F.lit('.html" title="'), F.when(k % 4 != 3, F.col("p_name")).otherwise(""), F.lit('">'), F.substring("p_name", 1, 4), F.lit("</a></h3>"), F.when(k % 5 != 0, F.concat(F.lit('<p class="price_color">£'), "p_retailprice", F.lit("</p>"))).otherwise(""), F.lit('<p class="instock availability"><i></i>\n In stock \n</p></article>'))
    lists = p.select(F.concat(F.lit("https://b.example.com/list/"), k, F.lit(".html")).alias("url"), F.concat(F.lit("<html><body><section><ol><li>"), pod, F.lit("</ol></section>")).alias("html"))
    body = F.concat(
        F.lit('<ul class="breadcrumb"><li><a href="/">Home</a><li><a href="/b">Books</a>'), F.when(k % 3 != 0, F.concat(F.lit('<li><a href="c">'), "p_type", F.lit("</a>"))).otherwise(""), F.lit("<li>x</ul>"),
        F.lit('<div class="product_main"><h1>'), F.col("p_name"), F.lit('</h1><p class="price_color">$'), F.col("p_size"), F.lit('</p><p class="availability">'), F.when(k % 2 == 0, F.concat(F.lit(" In stock ("), "p_size", F.lit(" available) "))).otherwise(" "), F.lit("</p></div>"),
        F.when(k % 6 == 0, F.lit('<div id="product_gallery"><img src="/full.jpg"></div>')).otherwise(""), F.lit('<table class="table table-striped"><tr><th>UPC</th><td>u'), k, F.lit("</td></tr><tr><th>Tax</th><td>1</td></tr></table>"),
        F.lit('<div id="product_description"></div><p>Text of '), F.col("p_name"), F.lit("</p><article><p class='availability'>Sold</p></article>"),
    )
    details = p.select(F.concat(F.lit("https://b.example.com/item/"), k, F.lit(".html")).alias("url"), body.alias("html"))
    return lists, details


@query("""select case when p_partkey % 4 <> 3 then p_name else trim(left(p_name, 4)) end as title, case when p_partkey % 5 <> 0 then p_retailprice else p_size end::double as price, case when p_partkey % 5 <> 0 then 'GBP' else 'USD' end as currency, case when p_partkey % 2 = 0 then 'In stock (' || p_size || ' available)' else 'In stock' end as availability, case when p_partkey % 3 <> 0 then p_type end as category, 'u' || p_partkey as upc, 'Text of ' || p_name as description, 'https://b.example.com/item/' || p_partkey || '.html' as product_url, case when p_partkey % 6 = 0 then 'https://b.example.com/full.jpg' else 'https://b.example.com/list/t/' || p_partkey || '.jpg' end as image_url from part""")
def listing_detail_merge(spark, d):
    lists, details = _shop_pages(spark, d)
    return crawl.merged(crawl.listing(lists), crawl.detail(details)).drop("page_url", "pos")


@query("""select p_partkey, p_name as title, case when p_partkey % 2 = 0 then p_retailprice else p_size / 100.0 end::double as price, case when p_partkey % 2 = 0 then 'in_stock' else 'out_of_stock' end as availability, 'https://c/a.jpg https://c/' || p_partkey || '.png' as images, 'https://www.shop.example.com/products/p' || p_partkey as product_url, case when p_partkey % 2 = 0 then 'https://c/a.jpg' end as variant_image, p_partkey % 2 = 0 as valid from part""")
def config_extraction(spark, d):
    k = F.col("p_partkey")
    config = {
        "url_patterns": {"product": [r"^https://www\.shop\.example\.com/products/(?P<handle>[a-z0-9-]+)/?(?:\?.*)?$"]},
        "extraction": {
            "title": {"sources": [{"type": "json_endpoint", "request": "product_json", "path": "$.product.title"}, {"type": "css", "selector": "h1", "get": "text"}], "post_process": ["strip", "collapse_whitespace"]},
            "price": {"sources": [{"type": "json_endpoint", "request": "product_json", "path": "$.product.variants[0].price"}, {"type": "json_in_html", "locator": r"var meta\s*=\s*(?P<json>\{)", "path": "$.price", "transform": "divide_by_100"}], "output_type": "float"},
            "availability": {"sources": [{"type": "json_endpoint", "request": "product_json", "path": "$.product.variants[*].available", "reduce": "any"}, {"type": "json_ld", "path": "$..offers.availability"}], "output_type": "enum", "map": {"https://schema.org/OutOfStock": "out_of_stock", True: "in_stock", False: "out_of_stock"}},
            "images": {"sources": [{"type": "css", "selector": 'meta[property="og:image"]', "get": "attr:content"}], "post_process": ["strip_query_string", "absolutize", "deduplicate"]},
            "product_url": {"sources": [{"type": "template", "value": SITE + "/products/{handle}"}]},
            "variants": {"source": {"request": "product_json"}, "fields": {"sku": "$.sku", "image": {"strategy": "lookup"}}},
        },
        "validation": {"response": {"require_any": [{"type": "json_ld", "path": "$[?(@['@type']=='Product')]"}], "reject_if_body_matches": ["(?i)just a moment"]}},
    }
    ld = F.when(k % 2 == 0, '{"@type":"Product"}').otherwise('{"@type":"Offer","offers":{"availability":"https://schema.org/OutOfStock"}}')
    html = F.concat(F.lit("<head><meta property='og:image' content='//c/a.jpg?v=1'><meta property=\"og:image\" content=\"https://c/"), k, F.lit('.png"><meta property="og:image" content="https://c/a.jpg"><script type="application/ld+json">'), ld, F.lit("</script><script>var meta = {\"price\": "), F.col("p_size"), F.lit("};</script></head><h1> "), F.col("p_name"), F.lit("\n</h1>"))
    body = F.when(k % 2 == 0, F.concat(F.lit('{"product":{"title":"'), "p_name", F.lit('","variants":[{"sku":"s","price":"'), F.col("p_retailprice"), F.lit('","available":true,"image_id":5},{"available":false}],"images":[{"id":4,"src":"x"},{"id":5,"src":"https://c/a.jpg"}]}}')))
    pages = _spread(spark, d, "part").select("p_partkey", F.concat(F.lit(SITE + "/products/p"), k, F.lit("?variant=1")).alias("url"), html.alias("html"), body.alias("product_json"))
    plan = Plan(config)
    out = plan.valid_response(plan.apply(pages))
    return out.select("p_partkey", "title", "price", "availability", F.array_join("images", " ").alias("images"), "product_url", F.get("variants", F.lit(0))["image"].alias("variant_image"), "valid")


@query("""select r_name as source, n.n_nationkey::bigint as page, i::int as pos, n_name || i as item from nation n join region on n_regionkey = r_regionkey, (values (0), (1)) v(i) where n_nationkey < 12 or r_name not in (select r_name from nation join region on n_regionkey = r_regionkey where n_nationkey = 12)""")
def paged_endpoint(spark, d):
    n = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    body = F.when(F.col("n_nationkey") == 12, '{"products":[]}').otherwise(F.concat(F.lit('{"products":["'), "n_name", F.lit('0","'), "n_name", F.lit('1"]}')))
    return io.paged_items(n.select(F.col("r_name").alias("source"), F.col("n_nationkey").cast("long").alias("page"), body.alias("body")))


@query("""select n_nationkey, 'https://s/sitemap_products_' || n_nationkey || '.xml?a=1&b=2' as first_map, 2::bigint as maps, 1::bigint as products from nation""")
def sitemap_scan(spark, d):
    k = F.col("n_nationkey")
    index = F.concat(F.lit("<loc>https://s/pages.xml</loc><loc> https://s/sitemap_products_"), k, F.lit(".xml?a=1&amp;b=2</loc><loc>https://s/sitemap_products_9.xml</loc>"))
    site = F.concat(F.lit("<url><loc>https://s/products/a</loc><image:loc>https://s/products/i.jpg</image:loc></url><url><loc>https://s/pages/"), k, F.lit("</loc></url>"))
    return t(spark, d, "nation").select("n_nationkey", io.first_product_map(index).alias("first_map"), F.size(io.product_maps(index)).cast("long").alias("maps"), io.product_count(site).cast("long").alias("products"))


@query("""select event_id, ts from events where ts > timestamp '2024-01-05 00:00:00'""")
def incremental(spark, d):
    return io.newer(t(spark, d, "events").select("event_id", F.col("ts").alias("lastmod")), "2024-01-05 00:00:00").withColumnRenamed("lastmod", "ts")


@query("""select case when p_partkey % 3 > 0 then p_name end as title, p_retailprice as price, case when p_partkey % 2 = 0 then 'GBP' end as currency, null::varchar as availability, null::varchar as category, 'u' || p_partkey as upc, null::varchar as description, null::varchar as product_url, null::varchar as image_url from part""")
def fixed_schema_export(spark, d):
    k = F.col("p_partkey")
    p = t(spark, d, "part").select(F.concat(F.lit("u"), k).alias("upc"), F.when(k % 3 > 0, F.col("p_name")).alias("title"), F.col("p_retailprice").alias("price"), F.when(k % 2 == 0, "GBP").alias("currency"), F.lit(1).alias("extra"))
    import uuid

    path = f"{io.shared(spark)}/export-{uuid.uuid4().hex}"
    io.export(p, path)
    return io.read_items(spark, path)


@query("""select event_type, min(event_id) as first_id from events where event_type is not null group by 1""")
def stream_dedup(spark, d):
    import uuid

    path = f"{io.shared(spark)}/stream-{uuid.uuid4().hex}"
    # A stream of a path that is one file needs it as a pattern.
    stream = spark.readStream.schema("event_type string, event_id long").parquet(f"{d}/events.parque[t]")
    dedup.run_once(dedup.first_seen(stream, F.col("event_type"), "event_id"), f"{path}/out", f"{path}/state")
    kept = spark.read.schema("event_type string, event_id long").parquet(f"{path}/out")
    return kept.where("event_type is not null").select("event_type", F.col("event_id").alias("first_id"))


# --- faults, rules and reports -------------------------------------------------------


@query("""with p as (select r_name as source, n_nationkey::bigint as page, n_name from nation join region on n_regionkey = r_regionkey), s as (select source, min(page) as stop from p where page in (12, 20) group by 1) select p.source, page, i::int as pos, n_name || i as item from p left join s using (source), (values (0), (1)) v(i) where page not in (1, 6, 7, 12, 20) and (stop is null or page < stop)""")
def paged_endpoint_gaps(spark, d):
    """Pages that failed or broke off stand between good ones and stop nothing."""
    n = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey")
    body = F.when(k.isin(12, 20), '{"products":[]}').when(k == 7, '{"products":').when(~k.isin(1, 6), F.concat(F.lit('{"products":["'), "n_name", F.lit('0","'), "n_name", F.lit('1"]}')))
    return io.paged_items(n.select(F.col("r_name").alias("source"), k.cast("long").alias("page"), body.alias("body")))


@query("""select p_partkey, case p_partkey % 6 when 0 then 'https://www.shop.example.com/products/x.jpg' when 1 then 'https://www.shop.example.com/products/a/p' || p_partkey || '?q=1' when 2 then 'https://www.shop.example.com/r.jpg' when 3 then 'https://www.shop.example.com/products/a/p.png' when 4 then 'https://c/a.jpg' else 'http://d/e.jpg' end as main_image from part""")
def absolutized_images(spark, d):
    k = F.col("p_partkey")
    plan = Plan({"extraction": {"images": {"sources": [{"type": "css", "selector": "img", "get": "attr:src"}], "post_process": ["absolutize"]}}})
    src = F.element_at(F.array(*map(F.lit, ("../x.jpg", "?q=1", "/r.jpg", "p.png", "//c/a.jpg", "http://d/e.jpg"))), (k % 6 + 1).cast("int"))
    pages = _spread(spark, d, "part").select("p_partkey", F.concat(F.lit(SITE + "/products/a/p"), k, F.lit("?v=1")).alias("url"), F.concat(F.lit('<p><img src="'), src, F.lit('">')).alias("html"))
    return plan.apply(pages).select("p_partkey", "main_image")


@query("""select n_nationkey, '/x' || n_nationkey as href, 'end ' || n_name as heading from nation""")
def deep_page(spark, d):
    """Pages of five thousand tags inside one another."""
    html = F.concat(F.repeat(F.lit("<b>"), F.lit(5000)), F.lit('<a href="/x'), "n_nationkey", F.lit('">a</a><h1>end <i>'), "n_name", F.lit("</i></h1>"))
    got = t(spark, d, "nation").select("n_nationkey", H.html_extract({"a": "b a::attr(href)", "h": "h1"})(html).alias("e"))
    return got.select("n_nationkey", F.get("e.a", F.lit(0)).alias("href"), F.get("e.h", F.lit(0)).alias("heading"))


@query(_URL_SQL + r""", r as (select p_partkey, url, case when p_partkey % 8 = 2 then regexp_extract(url, '/p/([a-z0-9-]+)/', 1) when contains(url, '/g/') then coalesce(nullif(regexp_extract(url, '[?;&]brand=([^&#]+)', 1), ''), regexp_extract(url, '/g/(?:[a-z0-9-]+/)*([a-z0-9-]+)\?', 1)) end as raw from u) select p_partkey, case p_partkey % 8 when 0 then 'catalog, titles' when 1 then 'catalog, titles' when 2 then 'product, titles' when 3 then 'search' when 4 then 'images' when 5 then 'videos' when 6 then 'catalog, titles' else '(no match)' end as matched, coalesce(list_aggregate(list_transform(regexp_extract_all(replace(replace(raw, '-', ' '), '+', ' '), '[a-zA-Z]+|[^a-zA-Z]+'), lambda x: upper(x[1]) || lower(x[2:])), 'string_agg', ''), case when p_partkey % 8 = 3 then replace(split_part(split_part(url, '=', 2), '%', 1), '+', ' ') || '=' end) as title from r""")
def url_report(spark, d):
    return _urls(spark, d).select("p_partkey", RULES.report("url").alias("r")).select("p_partkey", "r.matched", "r.title")


@query(_URL_SQL + r"""select p_partkey, case p_partkey % 8 when 0 then 'cat' || p_size when 1 then 'dept' || p_size when 2 then 'ppr' || p_partkey when 3 then replace(p_name, ' ', '+') || '%3D' when 4 then 'DP' || p_partkey || 'M' when 5 then '91A_V-' || p_partkey when 6 then 'cat' || p_size end as id from u join part using (p_partkey)""")
def url_primary(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("catalog", "catalog", "product", "search", "images", "videos", "catalog", "search"))), (F.col("p_partkey") % 8 + 1).cast("int"))
    return _urls(spark, d).select("p_partkey", RULES.primary(kind, "url").alias("id"))


@query("""select p_partkey, p_partkey % 3 = 0 as unknown from part""")
def unknown_kind(spark, d):
    kind = F.when(F.col("p_partkey") % 3 == 0, "basket").when(F.col("p_partkey") % 3 == 1, "any").otherwise("titles")
    return t(spark, d, "part").select("p_partkey", U.unknown_kinds(kind).alias("unknown"))


@query("""select p_partkey, case when p_partkey % 2 = 0 then p_name when p_partkey % 3 > 0 then p_type end as expected from part""")
def expected_title(spark, d):
    p, k = t(spark, d, "part"), F.col("p_partkey")
    url = F.concat(F.lit("https://h/"), k).alias("url")
    links = p.select("p_partkey", url, F.when(k % 3 > 0, F.col("p_type")).alias("annotation"))
    listed = p.where(k % 2 == 0)
    listed = listed.select(url, F.col("p_name").alias("title")).unionByName(listed.select(url, F.concat("p_name", F.lit(" (2)")).alias("title")))
    return U.expected_titles(links, listed).select("p_partkey", "expected")


@query("""with r as (select p_partkey % 10 > 1 and p_retailprice <= 1500 as price, p_partkey % 4 > 0 as absolute, p_partkey % 7 > 0 as domain from part) select 'price' as rule, count(*) filter (where not price) as violations, count(*) as items, violations > 0 as failed from r union all select 'absolute', count(*) filter (where not absolute) as v, count(*), v > 0 from r union all select 'domain', count(*) filter (where not domain) as v, count(*), v > 0 from r union all select 'positive', 0, count(*), false from r""")
def value_rules(spark, d):
    k = F.col("p_partkey")
    price = F.when(k % 10 == 0, F.lit(None)).when(k % 10 == 1, -F.col("p_retailprice")).otherwise(F.col("p_retailprice")).cast("double")
    url = F.concat(F.when(k % 4 == 0, "http://").otherwise("https://"), F.when(k % 7 == 0, "shop.example.com.evil.example").otherwise("www.shop.example.com"), F.lit("/p/"), k)
    p = t(spark, d, "part").select(price.alias("price"), url.alias("url"), F.col("p_size"))
    return quality.violations(p, {"price": quality.plausible_price("price", 0, 1500), "absolute": U.absolute("url"), "domain": U.allowed("url", "shop.example.com"), "positive": F.col("p_size") > 0})


@query("""select 'absolute' as rule, count(*) filter (where not starts_with(url, 'https://')) as violations, count(*) as items, violations > 0 as failed from pages""")
def absolute_urls(spark, d):
    return quality.violations(t(spark, d, "pages"), {"absolute": U.absolute("url")})


@query("""select 'title' as rule, count(*) filter (where p_partkey % 4 = 0) as violations, count(*) as items, violations > 0 as failed from part union all select 'images', count(*) filter (where p_partkey % 3 < 2) as v, count(*), v > 0 from part""")
def config_expectations(spark, d):
    k = F.col("p_partkey")
    source = [{"type": "css", "selector": "h1", "get": "text"}]
    plan = Plan({"extraction": {"title": {"sources": source, "required": True}, "images": {"sources": source, "min_expected": 2}, "price": {"sources": source}}})
    items = t(spark, d, "part").select(F.when(k % 4 > 0, F.col("p_name")).otherwise("").alias("title"), F.slice(F.array(F.lit("a"), F.lit("b")), F.lit(1), (k % 3).cast("int")).alias("images"), F.lit(1.0).alias("price"))
    return plan.expectations(items)


@query("""select p_partkey, p_partkey % 3 = 1 as redirected, p_partkey % 4 > 0 as valid from part""")
def redirects(spark, d):
    k = F.col("p_partkey")
    plan = Plan({"extraction": {}, "validation": {"response": {"expect_status": [200], "reject_if_redirected_to": "^https://www.shop.example.com/collections/"}}})
    history = F.when(k % 3 == 1, F.array(F.lit(SITE + "/old"))).when(k % 3 == 0, F.array().cast("array<string>"))
    url = F.concat(F.lit(SITE + "/products/"), k)
    pages = t(spark, d, "part").select("p_partkey", url.alias("url"), F.when(k % 4 == 0, SITE + "/collections/all").otherwise(url).alias("final_url"), F.lit(200).alias("status"), F.lit("<h1>x").alias("html"), history.alias("history"))
    return plan.valid_response(pages).select("p_partkey", H.redirected("history").alias("redirected"), "valid")


@query("""select p_partkey, p_partkey % 4 in (1, 2) and p_partkey % 5 < 2 as again from part""")
def retry_again(spark, d):
    k = F.col("p_partkey")
    status = F.element_at(F.array(*map(F.lit, (200, 429, 503, 404))), (k % 4 + 1).cast("int"))
    return t(spark, d, "part").select("p_partkey", io.FetchSettings.of({"retries": 2, "timeout": 5.0}).again(status, k % 5 + 1).alias("again"))


@query("""select least(count(*), 100)::bigint as items from part""")
def limited_run(spark, d):
    return io.limited(t(spark, d, "part"), 100).agg(F.count("*").alias("items"))


@query("""select p_partkey, case when p_partkey % 2 = 0 then 'product' || p_size end as page_type, left(p_name, 66) as server, case when p_partkey % 3 = 0 then 's' || p_partkey end as shop from part""")
def response_headers(spark, d):
    k = F.col("p_partkey")
    timing = F.when(k % 2 == 0, F.concat(F.lit('db;dur=3, pageType;desc="product'), "p_size", F.lit('"'))).otherwise("db;dur=3")
    headers = F.map_filter(F.create_map(F.lit("server-timing"), timing, F.lit("server"), F.col("p_name"), F.lit("x-shopid"), F.when(k % 3 == 0, F.concat(F.lit("s"), k))), lambda _, v: v.isNotNull())
    h = t(spark, d, "part").select("p_partkey", headers.alias("h")).select("p_partkey", H.server_page_type("h").alias("page_type"), H.fingerprint("h").alias("f"))
    return h.select("p_partkey", "page_type", "f.server", F.col("f.x_shopid").alias("shop"))


@query("""select p_partkey, case p_partkey % 3 when 0 then 'l' || p_partkey || '.jpg' when 1 then 's.jpg' end as source, p_partkey % 4 < 2 as hydration from part""")
def page_guards(spark, d):
    k = F.col("p_partkey")
    html = F.when(k % 3 == 0, F.concat(F.lit('<img src="blank.gif" data-src="l'), k, F.lit('.jpg">'))).when(k % 3 == 1, "<img src='s.jpg'>").otherwise("<img>")
    anchors = F.slice(F.array(*map(F.lit, "abc")), F.lit(1), (k % 4).cast("int"))
    return t(spark, d, "part").select("p_partkey", H.sources_of_images(html).alias("source"), H.hydration_suspected(anchors, F.array(*map(F.lit, "wxyz"))).alias("hydration"))


@query("""select p_partkey, case when p_partkey % 3 = 0 then p_name end as title from part""")
def product_response(spark, d):
    k = F.col("p_partkey")
    body = F.when(k % 3 == 2, "{}").otherwise(F.concat(F.lit('{"product":{"title":"'), "p_name", F.lit('"}}')))
    return t(spark, d, "part").select("p_partkey", J.scalar_at(J.product_of(body, F.when(k % 3 == 1, 404).otherwise(200)), "$.title").alias("title"))


@query("""select p_partkey, case when p_partkey % 3 < 2 then '{"a":{"b":"}\\\\""},' || p_size || '}' end as object from part""".replace("\\\\", "\\"))
def balanced_objects(spark, d):
    k = F.col("p_partkey")
    text = F.concat("p_name", F.lit('{"a":{"b":"}\\""},'), F.col("p_size"), F.when(k % 3 < 2, "} } rest {").otherwise(" never"))
    return _spread(spark, d, "part").select("p_partkey", J.balanced_object(text, F.length("p_name")).alias("object"))


@query("""select p_partkey, case when p_partkey % 4 = 0 then 'a' || p_partkey end as body from part""")
def companion_body(spark, d):
    p, k = t(spark, d, "part"), F.col("p_partkey")
    plan = Plan({"url_patterns": {"product": [r"^https://h/products/(?P<handle>[a-z0-9-]+)$"]}, "extraction": {}})
    pages = p.select("p_partkey", F.concat(F.lit("https://h/products/p"), k).alias("url"))
    answers = p.where(k % 2 == 0).select(F.concat(F.lit("p"), k).alias("handle"), F.when(k % 4 == 0, 200).otherwise(500).alias("status"), F.explode(F.array(F.concat(F.lit("b"), k), F.concat(F.lit("a"), k))).alias("body"))
    return with_companion(pages, answers, "body", plan).select("p_partkey", "body")


@query("""select p_name as title, p_retailprice as price, 'u' || p_partkey as upc from part""")
def csv_export(spark, d):
    return _exported(spark, t(spark, d, "part"), "csv").select("title", "price", "upc")


@query("""select p_name as title, p_retailprice as price, 'u' || p_partkey as upc from part""")
def gated_items(spark, d):
    return _exported(spark, t(spark, d, "part"), "parquet").select("title", "price", "upc")


def _exported(spark, part, kind):
    import uuid

    path = f"{io.shared(spark)}/export-{uuid.uuid4().hex}"
    items = part.select(F.col("p_name").alias("title"), F.col("p_retailprice").alias("price"), F.concat(F.lit("u"), "p_partkey").alias("upc"))
    if not io.gated_export(items, path, lambda got: [quality.run_gate(got, 1)], kind):
        raise ValueError("the gate failed")
    return spark.read.parquet(path) if kind == "parquet" else spark.read.schema(io.ITEM).option("header", "true").option("escape", '"').csv(path)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The per-page report: title, heading, links, challenge flag, class."""
    p = t(spark, d, "pages")
    return p.select("page_id", H.title("html").alias("title"), H.h1("html").alias("h1"), F.size(H.distinct_matches("html", 'href="(/[^"]*)"', 1)).alias("anchors"), H.challenged("html").alias("blocked"), U.page_class("url", CLASSES["search"], CLASSES["product"], CLASSES["exclude"]).alias("class"), F.length(X.clean_one(X.without_tags("html"))).alias("text_chars"))
