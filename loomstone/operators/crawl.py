"""Traversal of stored pages, and the merge of listing and detail pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions import html as H
from loomstone.functions import text as X
from loomstone.functions.urls import url_join, url_joins
from loomstone.sources.io import ITEM, Dealt, written

# The selectors of the shop's listing and detail pages.
LISTING_POD = "article.product_pod"
LISTING = {"href": "h3 a::attr(href)", "name": "h3 a::attr(title)", "anchor": "h3 a::text", "price": ".price_color::text", "availability": ".availability::text", "img": "img::attr(src)"}
DETAIL = {
    "crumbs": "ul.breadcrumb li a::text", "availability": ".product_main p.availability::text", "image": "#product_gallery img::attr(src)", "price": ".price_color::text",
    "h1": "div.product_main h1::text", "after": "#product_description ~ p::text",
}
INFO = ("table.table-striped tr", {"k": "th::text", "v": "td::text"})


#: Rounds after which the tables of the nodes seen are made one.
FOLD = 8


def reach(edges: DataFrame, seeds: DataFrame, most: int = 1_000_000) -> DataFrame:
    """node, depth of all nodes that links lead to from the seeds; each is visited once, so cycles end.

    edges: src, dst. The links are dealt by src once, and each round's nodes by
    node in the same way, so that a round only shuffles what its newest nodes
    lead to. Those already seen are dropped. Rounds are written, which keeps the
    lineage short, and every FOLD rounds what was seen becomes one table, which
    keeps the plan short.
    """
    spark = edges.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    links = Dealt(edges.select("src", "dst").where("src is not null and dst is not null").repartition(n, "src"), "links", "src")
    first = seeds.select("node").where("node is not null").distinct().withColumn("depth", F.lit(0))
    seen, depth = [Dealt(first.repartition(n, "node"), "frontier", "node")], 0
    made = [links, *seen]
    try:
        new = seen[0]
        while depth < most:
            depth += 1
            # The side held in memory has each node once.
            nxt = links.table.join(new.table.select("node").hint("shuffle_hash"), F.col("src") == F.col("node")).select(F.col("dst").alias("node")).distinct()
            for s in seen:
                nxt = nxt.join(s.table.select("node").hint("shuffle_hash"), "node", "left_anti")
            new = Dealt(nxt.withColumn("depth", F.lit(depth)), "frontier", "node")
            made.append(new)
            if new.table.isEmpty():
                break
            seen.append(new)
            if depth % FOLD == 0:
                seen = [Dealt(_rows(seen).repartition(n, "node"), "frontier", "node")]
                made += seen
        return _rows(seen)
    finally:
        for x in made:
            x.forget()


def _rows(tables: list[Dealt]) -> DataFrame:
    """All rows of tables of one schema, read by their paths."""
    return tables[0].spark.read.schema(tables[0].schema).parquet(*(x.path for x in tables))


def chain(pages: DataFrame, start: str, selector: str = "li.next a::attr(href)") -> DataFrame:
    """url, depth of the listing pages that the next links lead to from the first."""
    links = pages.select("url", F.explode(H.html_select("html", selector)).alias("href"))
    edges = written(links.select(F.col("url").alias("src"), url_join("url", "href").alias("dst")), "links")
    return reach(edges, pages.sparkSession.createDataFrame([(start,)], "node string")).withColumnRenamed("node", "url")


def _one(c: Column) -> Column:
    return F.get(c, F.lit(0))


def listing(pages: DataFrame) -> DataFrame:
    """A row per product pod: page_url, pos, detail_url and the listing's fields. Pods without a link stay, with a null detail_url."""
    pod = pages.select("url", F.posexplode(H.pods("html", LISTING_POD, LISTING)).alias("pos", "p"))
    price = X.parse_price(_one(F.col("p.price")))
    title = F.coalesce(X.present(_one(F.col("p.name"))), X.clean_text("p.anchor"))
    pod = pod.withColumn("at", url_joins("url", X.present(_one(F.col("p.href"))), F.coalesce(_one(F.col("p.img")), F.lit(""))))
    return pod.select(
        F.col("url").alias("page_url"), "pos", F.get("at", F.lit(0)).alias("detail_url"), X.clean_one(title).alias("title"), price["price"].alias("price"), price["currency"].alias("currency"),
        X.clean_text("p.availability").alias("availability"), F.get("at", F.lit(1)).alias("image_url"),
    )


def detail(pages: DataFrame) -> DataFrame:
    """A row per page: url and the detail page's fields, null where absent."""
    got = pages.select("url", H.html_extract({**DETAIL, "rows": INFO})("html").alias("d"))
    info = F.filter(F.transform("d.rows", lambda r: F.struct(X.clean_text(r["k"]).alias("k"), X.clean_text(r["v"]).alias("v"))), lambda r: r["k"].isNotNull())
    got = got.withColumn("info", info)
    # The last row of a header counts.
    at = lambda name: F.try_element_at(F.filter("info", lambda r: r["k"] == name), F.lit(-1))["v"]
    price = X.parse_price(F.coalesce(X.present(_one(F.col("d.price"))), at("Price (incl. tax)")))
    crumbs = F.col("d.crumbs")
    return got.select(
        "url", at("UPC").alias("upc"), F.when(F.size(crumbs) >= 3, X.clean_one(F.element_at(crumbs, -1))).alias("category"), X.strip_preview(X.clean_one(_one(F.col("d.after")))).alias("description"),
        X.clean_text("d.availability").alias("d_availability"), F.when(X.present(_one(F.col("d.image"))).isNotNull(), url_join("url", _one(F.col("d.image")))).alias("d_image"),
        price["price"].alias("d_price"), price["currency"].alias("d_currency"), X.clean_text("d.h1").alias("d_title"),
    )


def merged(listed: DataFrame, details: DataFrame) -> DataFrame:
    """Listing rows with their detail page's fields, in the item's fixed order, and the page and place of the pod.

    The detail page's availability and gallery image win if it has them; its
    price and currency stand in together where the listing has no price, its
    heading where there is no title.
    """
    both = listed.where("detail_url is not null").join(details, F.col("detail_url") == F.col("url"))
    no_price = F.col("price").isNull()
    cols = {
        "title": F.coalesce("title", "d_title"), "price": F.coalesce("price", "d_price"), "currency": F.when(no_price, F.col("d_currency")).otherwise(F.col("currency")),
        "availability": F.coalesce("d_availability", "availability"), "category": F.col("category"), "upc": F.col("upc"), "description": F.col("description"), "product_url": F.col("url"),
        "image_url": F.coalesce("d_image", "image_url"),
    }
    return both.select(*(cols[f.name].alias(f.name) for f in ITEM.fields), "page_url", "pos")


def rejected_pods(listed: DataFrame) -> DataFrame:
    return listed.where("detail_url is null").groupBy("page_url").agg(F.count("*").alias("pods"))
