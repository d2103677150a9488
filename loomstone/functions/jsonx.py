"""JSON inside pages and responses: variants for plain paths, one Arrow function for descents and filters."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstone.functions.text import _col

LD_BLOCK = r"""(?is)<script[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""


def embedded(html, locator: str) -> Column:
    """VARIANT of the object whose first brace ends the locator; NULL if there is none or it isn't whole."""
    return F.try_parse_json(_null_if_empty(F.regexp_extract(_col(html), rf"(?s){locator}\s*(\{{.*)", 1)))


def string_at(v, path: str) -> Column:
    """The string at a path of a variant; NULL for anything else that stands there."""
    at = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(at) == "STRING", F.try_variant_get(v, path, "string"))


def primary_image(html, name: str = r"window\.PRODUCT_DATA", path: str = "$.media.primary.url") -> Column:
    """The string at a path of the object that the page assigns to a name."""
    return string_at(embedded(html, rf"{name}\s*=\s*"), path)


def scalar_at(v, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def product_of(body, status=None) -> Column:
    """VARIANT of a product response, NULL unless it came with status 200 and holds a product."""
    v = F.try_variant_get(F.try_parse_json(_col(body)), "$.product", "variant")
    return v if status is None else F.when(_col(status) == 200, v)


PRODUCT = (
    "struct<title:string,body_html:string,handle:string,product_type:string,vendor:string,options:array<struct<name:string,values:array<string>>>,"
    "variants:array<struct<id:bigint,sku:string,price:string,compare_at_price:string,available:boolean,inventory_quantity:int,barcode:string,option1:string,option2:string,option3:string,image_id:bigint>>,"
    "images:array<struct<id:bigint,src:string>>>"
)


def product(body) -> Column:
    """Typed product of a response; NULL for bodies without one."""
    return F.from_json(_col(body), f"struct<product:{PRODUCT}>")["product"]


def product_summary(p: Column) -> Column:
    """Title, type, options with their numbers of values, and numbers of variants and images."""
    return F.struct(
        F.coalesce(p["title"], F.lit("")).alias("title"),
        p["product_type"].alias("product_type"),
        F.transform(p["options"], lambda o: F.struct(o["name"].alias("name"), F.coalesce(F.size(o["values"]), F.lit(0)).alias("values"))).alias("options"),
        F.greatest(F.coalesce(F.size(p["variants"]), F.lit(0)), F.lit(0)).alias("variants"),
        F.greatest(F.coalesce(F.size(p["images"]), F.lit(0)), F.lit(0)).alias("images"),
    )


def variant_image(v: Column, images: Column) -> Column:
    """src of the image with the variant's image_id, else of the first image."""
    return F.coalesce(F.get(F.filter(images, lambda i: i["id"] == v["image_id"]), F.lit(0))["src"], F.get(images, F.lit(0))["src"])


def zipped(names: Column, values: Column) -> Column:
    """MAP of names to values at the same places; pairs with a null are dropped."""
    both = F.filter(F.arrays_zip(names.alias("k"), values.alias("v")), lambda x: x["k"].isNotNull() & x["v"].isNotNull())
    return F.map_from_entries(F.transform(both, lambda x: F.struct(x["k"], x["v"])))


def any_true(flags: Column) -> Column:
    return F.coalesce(F.exists(F.filter(flags, lambda x: x.isNotNull()), lambda x: x), F.lit(False))


def ld_blocks(html) -> Column:
    return F.regexp_extract_all(_col(html), F.lit(LD_BLOCK), F.lit(1))


# --- paths with descents and filters ---------------------------------------

_STEP = re.compile(r"\.\.([A-Za-z_][\w-]*)|\.([A-Za-z_@][\w-]*)|\[(\d+)\]|\[\*\]|\['([^']+)'\]|\[\?\(@(?:\.([\w@-]+)|\['([^']+)'\])\s*(==|in)\s*(.+?)\)\]")


@lru_cache(maxsize=256)
def steps(path: str) -> tuple:
    """The steps of a path: child, index, every, below, where."""
    if not path.startswith("$"):
        raise ValueError(f"unsupported path: {path}")
    out, at = [], 1
    while at < len(path):
        m = _STEP.match(path, at)
        if not m:
            raise ValueError(f"unsupported path: {path}")
        at = m.end()
        if m[1]:
            out.append(("below", m[1]))
        elif m[2] or m[4]:
            out.append(("child", m[2] or m[4]))
        elif m[3]:
            out.append(("index", int(m[3])))
        elif m[7]:
            wanted = json.loads(m[8].replace("'", '"'))
            out.append(("where", m[5] or m[6], tuple(wanted) if m[7] == "in" else (wanted,)))
        else:
            out.append(("every",))
    return tuple(out)


def walk(value, path: str) -> list:
    """All values at a path of parsed JSON."""
    now = [value]
    for step in steps(path):
        kind, nxt = step[0], []
        for v in now:
            if kind == "child" and isinstance(v, dict) and step[1] in v:
                nxt.append(v[step[1]])
            elif kind == "index" and isinstance(v, list) and step[1] < len(v):
                nxt.append(v[step[1]])
            elif kind == "every" and isinstance(v, (list, dict)):
                nxt += v if isinstance(v, list) else v.values()
            elif kind == "where":
                nxt += [x for x in (v if isinstance(v, list) else [v]) if isinstance(x, dict) and any(t in step[2] for t in _listed(x.get(step[1])) if isinstance(t, (str, int, float, bool)))]
            elif kind == "below":
                stack = [v]
                while stack:
                    x = stack.pop()
                    if isinstance(x, dict):
                        if step[1] in x:
                            nxt.append(x[step[1]])
                        stack += [y for k, y in reversed(x.items()) if k != step[1]]
                    elif isinstance(x, list):
                        stack += reversed(x)
        now = nxt
    return now


_LENGTH = re.compile(r"^(\$\S*)\s+length\s*==\s*(\d+)$")


def length_is(body, rule: str) -> Column:
    """Does the array at a plain path of a JSON text have the length that a rule like `$.products length == 0` names? False where there is no array."""
    m = _LENGTH.match(rule)
    if not m:
        raise ValueError(f"unsupported rule: {rule}")
    at = F.try_variant_get(F.try_parse_json(_col(body)), m[1], "array<variant>")
    return F.coalesce(F.size(at) == int(m[2]), F.lit(False))


def _listed(x) -> list:
    return x if isinstance(x, list) else [x]


def _shown(x) -> str | None:
    if x is None or isinstance(x, str):
        return x
    return json.dumps(x, ensure_ascii=False)


def _found(group: list | None, paths: list[str]) -> list[list | None]:
    """The shown values at each path over all JSON texts of a group, each text read once."""
    if group is None:
        return [None] * len(paths)
    docs = []
    for t in group:
        try:
            v = json.loads(t)
        except (TypeError, ValueError, RecursionError):  # nested deeper than the reader goes: no JSON to us
            continue
        docs += v if isinstance(v, list) else [v]
    out = []
    for path in paths:
        top = docs if path.startswith("$[") or path.startswith("$..") else (docs[0] if docs else None)
        got = walk(top, path) if top is not None else []
        out.append([_shown(x) for x in got if x is not None])
    return out


def json_paths(paths: dict[str, str]):
    """A column function: ARRAY<STRING> of JSON texts to STRUCT with an ARRAY<STRING> for each path, as json_path gives it; the texts are read once."""
    for path in paths.values():
        steps(path)
    texts = pa.list_(pa.string())

    @F.arrow_udf(T.StructType([T.StructField(n, T.ArrayType(T.StringType())) for n in paths]))
    def run(groups: pa.Array) -> pa.Array:
        rows = [_found(g, [*paths.values()]) for g in groups.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], texts) for k in range(len(paths))], names=[*paths])

    return run


def json_path(path: str):
    """A column function: ARRAY<STRING> of JSON texts to ARRAY<STRING> of the values at a path over all of them.

    Texts that are no JSON count as absent; a text that is an array counts as its elements' list.
    """
    steps(path)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([_found(group, [path])[0] for group in texts], dtype=object)

    return run


def _null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


@F.pandas_udf(T.StringType())
def balanced_object(text: pd.Series, start: pd.Series) -> pd.Series:
    """The brace-balanced object that begins at a 0-based place of the text; NULL if none begins there or it never ends.

    Braces inside double-quoted strings don't count, nor do escaped quotes end them.
    """

    def one(s, at):
        if s is None or at is None or at != at or not 0 <= at < len(s) or s[int(at)] != "{":
            return None
        depth = 0
        for m in _TOKEN.finditer(s, int(at)):
            depth += {"{": 1, "}": -1}.get(m[0], 0)
            if depth == 0 and m[0] == "}":
                return s[int(at) : m.end()]
        return None

    return pd.Series([one(s, at) for s, at in zip(text, start, strict=True)], dtype=object)


#: A whole string, an open one up to the end, or a brace.
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|"(?s:.*)|[{}]', re.S)
