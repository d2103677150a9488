"""Facts of a page: native expressions, and one Arrow function for selectors."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from loomstone.functions import dom
from loomstone.functions.text import _col, present, stripped, without_tags

#: Words of a challenge page, looked for in its first characters.
CHALLENGE = ("just a moment", "access denied", "checking your browser", "attention required", "enable javascript and cookies")
CHALLENGE_CHARS = 5000
#: Status codes worth another try.
RETRY = (408, 429, 500, 502, 503, 504)
#: What the image, video and page patterns must match.
SRCSET = r"""(?s)srcset\s*=\s*(["'])(.*?)\1"""
SRC = r"""(?s)\bsrc\s*=\s*(["'])(.*?)\1"""
VIDEO = r"""(?i)[\w:-]+\s*=\s*(["'])([^"']*?\.mp4(?:\?[^"']*)?)\1"""
PAGES = r"(?iU)Page\s+(\d+)\s+of\s+(\d+)"


def largest_image(html) -> Column:
    """The URL of the largest srcset candidate, the first of equals; src where there is no srcset."""
    html = _col(html)
    items = F.filter(F.transform(F.split(F.regexp_extract(html, SRCSET, 2), ","), lambda x: stripped(x)), lambda x: x != "")
    sized = F.transform(items, lambda x: F.struct(F.coalesce(F.regexp_extract(x, r"(?U)^\S+\s+(\d+(?:\.\d+)?)[wx]", 1).try_cast("double"), F.lit(0.0)).alias("size"), F.regexp_extract(x, r"(?U)^(\S+)", 1).alias("url")))
    none = F.struct(F.lit(-1.0).alias("size"), F.lit(None).cast("string").alias("url"))
    best = F.reduce(sized, none, lambda acc, x: F.when(x["size"] > acc["size"], x).otherwise(acc))["url"]
    return F.when(html.rlike(SRCSET), best).when(html.rlike(SRC), stripped(F.regexp_extract(html, SRC, 2)))


def video_url(html) -> Column:
    """The first attribute value that ends in .mp4, with its query."""
    return present(F.regexp_extract(_col(html), VIDEO, 2))


def pagination(html) -> Column:
    """STRUCT<current_page, total_pages>, NULL as a whole where the page has none."""
    html = _col(html)
    part = [F.regexp_extract(html, PAGES, n).try_cast("int") for n in (1, 2)]
    return F.when(html.rlike(PAGES), F.struct(part[0].alias("current_page"), part[1].alias("total_pages")))


def title(html, chars: int = 58) -> Column:
    html = _col(html)
    return F.when(html.rlike("(?is)<title>.*?</title>"), F.left(stripped(F.regexp_extract(html, "(?is)<title>(.*?)</title>", 1)), F.lit(chars)))


def h1(html, chars: int = 58) -> Column:
    html = _col(html)
    inner = F.regexp_extract(html, "(?is)<h1[^>]*>(.*?)</h1>", 1)
    return F.when(html.rlike("(?is)<h1[^>]*>.*?</h1>"), F.left(stripped(without_tags(inner)), F.lit(chars)))


def challenged(html) -> Column:
    """Is the page a bot check? Only its beginning counts."""
    return F.coalesce(F.lower(F.left(_col(html), F.lit(CHALLENGE_CHARS))).rlike("|".join(CHALLENGE)), F.lit(False))


def meaningful(html) -> Column:
    return F.coalesce(_col(html).contains("<h1") & _col(html).contains("application/ld+json"), F.lit(False))


def rejected(html, rules: tuple[str, ...] = ("(?i)just a moment", "(?i)access denied")) -> Column:
    """Does the whole body match a rule?"""
    out = F.lit(False)
    for r in rules:
        out = out | _col(html).rlike(r)
    return F.coalesce(out, F.lit(False))


def marker(html, part: str) -> Column:
    return F.when(_col(html).contains(part), "present").otherwise("absent")


def has_attribute(html, name: str, value: str) -> Column:
    return F.coalesce(_col(html).rlike(rf"(?i){name}=['\"]{value}['\"]"), F.lit(False))


def occurrences(html, pattern: str) -> Column:
    return F.regexp_count(_col(html), F.lit(pattern)).cast("long")


def distinct_matches(html, pattern: str, group: int = 0) -> Column:
    return F.array_distinct(F.regexp_extract_all(_col(html), F.lit(pattern), F.lit(group)))


def listed(items, none: str = "none") -> Column:
    """Sorted distinct items in one string."""
    return F.coalesce(present(F.array_join(F.array_sort(F.array_distinct(_col(items))), ", ")), F.lit(none))


def hydration_suspected(anchors, handles) -> Column:
    """Does the page's data name more than twice the products that its links do?"""
    return (F.size(handles) > 0) & (F.size(anchors) < F.size(handles) / 2.0)


def sources_of_images(html) -> Column:
    """Image sources with lazy loading: data-src before src."""
    return F.coalesce(present(F.regexp_extract(_col(html), r"""data-src\s*=\s*["']([^"']+)""", 1)), present(F.regexp_extract(_col(html), r"""(?<!-)\bsrc\s*=\s*["']([^"']+)""", 1)))


def retryable(status) -> Column:
    return _col(status).isin(*RETRY)


def server_page_type(headers) -> Column:
    """pageType of the server-timing header; header names in lower case."""
    return present(F.regexp_extract(F.try_element_at(_col(headers), F.lit("server-timing")), r'pageType;desc="(\w+)"', 1))


def fingerprint(headers, chars: int = 66) -> Column:
    names = ("powered-by", "server", "shopify-complexity-score", "x-shopid")
    return F.struct(*(F.left(F.try_element_at(_col(headers), F.lit(n)), F.lit(chars)).alias(n.replace("-", "_")) for n in names))


def redirected(history) -> Column:
    """Did a response come by way of others? history: the URLs or responses before it; none for a failed fetch."""
    return F.coalesce(F.size(_col(history)) > 0, F.lit(False))


def html_extract(spec: dict[str, str | tuple[str, dict[str, str]]]):
    """A column function: html to STRUCT with an ARRAY<STRING> for each selector of the spec; the page is parsed once.

    A value that is a pair (selector, spec) gives an ARRAY<STRUCT>: the inner
    selectors' values inside each element of the outer, in document order.
    """
    texts = T.ArrayType(T.StringType())
    kind = lambda v: texts if isinstance(v, str) else T.ArrayType(T.StructType([T.StructField(n, texts) for n in v[1]]))
    schema = T.StructType([T.StructField(n, kind(v)) for n, v in spec.items()])
    for v in spec.values():
        for s in (v,) if isinstance(v, str) else (v[0], *v[1].values()):
            dom.compiled(s)
    arrow = to_arrow_type(schema)

    def one(page: dom.Below, v):
        if isinstance(v, str):
            return page.select(v)
        return [{n: inner.select(s) for n, s in v[1].items()} for inner in map(dom.Below, page.nodes(v[0]))]

    @F.arrow_udf(schema)
    def extract(html: pa.Array) -> pa.Array:
        cols: list[list] = [[] for _ in spec]
        for h in html.to_pylist():
            page = dom.Below(dom.parse(h)) if h is not None else None
            for col, v in zip(cols, spec.values(), strict=True):
                col.append(one(page, v) if page is not None else None)
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], fields=list(arrow))

    return extract


def html_select(html, selector: str) -> Column:
    """All values of one selector; the first is get(…, 0)."""
    return html_extract({"v": selector})(_col(html))["v"]


def pods(html, pod: str, spec: dict[str, str]) -> Column:
    """ARRAY<STRUCT>: the selectors' values inside each element that pod selects, in document order."""
    return html_extract({"v": (pod, spec)})(_col(html))["v"]
