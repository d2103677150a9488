"""A declarative extraction config (a mapping, as YAML gives it), compiled to columns.

Each field names sources in order; the first that yields something is taken.
All selectors of a page go into one parse, and so do all paths of a JSON text. The compiled plan adds one column a
field to pages with url, html, and optionally status, final_url and the bodies
of companion requests, each as a column named after the request.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions import html as H
from loomstone.functions import jsonx as J
from loomstone.functions import text as X
from loomstone.functions.urls import url_join_all
from loomstone.operators import quality

LISTS = frozenset({"images", "videos"})


def java(pattern: str) -> str:
    """A pattern with named groups as one with numbered groups."""
    return re.sub(r"\(\?P<\w+>", "(", pattern)


@dataclass
class Plan:
    """Compiled config: apply() to pages, then the gates."""

    config: dict

    def __post_init__(self):
        self.fields = [n for n in self.config["extraction"] if n not in ("companion_requests", "variants")]
        self.handle = next((java(p) for p in self.config.get("url_patterns", {}).get("product", []) if "?P<handle>" in p), None)
        self.css: dict[str, str] = {}
        self.paths: dict[str, object] = {}
        for name in self.fields:
            for i, s in enumerate(self._sources(name)):
                if s["type"] == "css":
                    get = s.get("get", "text")
                    self.css[f"{name}_{i}"] = s["selector"] + ("::text" if get == "text" else f"::attr({get.removeprefix('attr:')})")
                elif s["type"] == "xpath":
                    raise ValueError("xpath sources are not supported")
                elif s["type"] not in ("json_endpoint", "json_ld", "json_in_html", "regex", "template"):
                    raise ValueError(f"unknown source type: {s['type']}")

    def _sources(self, name: str) -> list[dict]:
        return self.config["extraction"][name]["sources"]

    # --- sources: each an ARRAY<STRING> column

    def _values(self, name: str, i: int, s: dict, have: set[str]) -> Column:
        kind, none = s["type"], F.lit(None).cast("array<string>")
        if kind == "css":
            return F.col("_css")[f"{name}_{i}"]
        if kind == "json_ld":
            return F.col("_ld_found")[f"{name}_{i}"]
        if kind == "json_endpoint":
            return F.col(f"_found_{s['request']}")[f"{name}_{i}"] if s["request"] in have else none
        if kind == "json_in_html":
            located = re.sub(r"\(\?P<\w+>\\\{\)$", "", s["locator"])
            body = F.regexp_extract("html", rf"(?s){java(located)}(\{{.*)", 1)
            return J.json_path(s["path"])(F.array(F.to_json(F.try_parse_json(X.present(body)))))
        if kind == "regex":
            return F.regexp_extract_all("html", F.lit(java(s["pattern"])), F.lit(0))
        return F.array(self.filled(s["value"]))

    def filled(self, template: str) -> Column:
        """A template with the handle of the page's URL; NULL where the URL has none."""
        head, mark, tail = template.partition("{handle}")
        if not mark:
            return F.lit(template)
        if self.handle is None:
            return F.lit(None).cast("string")
        return F.concat(F.lit(head), X.present(F.regexp_extract("url", self.handle, 1)), F.lit(tail))

    # --- post-processing

    def _processed(self, values: Column, rule: dict) -> Column:
        for step in rule.get("post_process", []):
            if step == "deduplicate":
                values = F.array_distinct(values)
            elif step == "absolutize":
                values = url_join_all("url", values)
            else:
                one = {"strip": X.stripped, "collapse_whitespace": X.collapsed, "strip_html_tags": X.without_tags, "strip_query_string": X.without_query}[step]
                values = _each(values, one)
        for pattern in rule.get("ignore_patterns", []):
            values = _unlike(values, pattern)
        if rule.get("prefer_format"):
            ext = f".{rule['prefer_format']}"
            values = F.concat(F.filter(values, lambda x: F.endswith(X.without_query(x), F.lit(ext))), F.filter(values, lambda x: ~F.endswith(X.without_query(x), F.lit(ext))))
        return F.filter(values, lambda x: x.isNotNull() & (x != ""))

    def _scalar(self, values: Column, s: dict, rule: dict) -> Column:
        if s.get("reduce") == "any":
            return F.when(F.size(values) > 0, J.any_true(F.transform(values, lambda x: x == "true")).cast("string"))
        one = F.get(F.filter(values, lambda x: x.isNotNull() & (x != "")), F.lit(0))
        if s.get("transform") == "divide_by_100":
            one = (one.try_cast("double") / 100).cast("string")
        elif s.get("transform"):
            raise ValueError(f"unknown transform: {s['transform']}")
        return one

    def _field(self, name: str, have: set[str]) -> Column:
        rule = self.config["extraction"][name]
        got = [(s, F.col(f"_{name}_{i}")) for i, s in enumerate(self._sources(name))]
        if name in LISTS:
            lists = [self._processed(F.coalesce(v, F.array().cast("array<string>")), rule) for _, v in got]
            return F.coalesce(*(F.when(F.size(v) > 0, v) for v in lists), F.array().cast("array<string>"))
        one = F.coalesce(*(X.present(self._scalar(v, s, rule)) for s, v in got))
        one = X.present(F.get(self._processed(F.array(one), rule), F.lit(0)))
        kind = rule.get("output_type")
        if kind == "float":
            return one.try_cast("double")
        if kind == "enum":
            return F.coalesce(*(F.when(one == (str(k).lower() if isinstance(k, bool) else k), F.lit(v)) for k, v in rule["map"].items()))
        return one

    def _variants(self, have: set[str]) -> Column:
        rule = self.config["extraction"]["variants"]
        body = rule["source"]["request"]
        p = J.product(F.col(body) if body in have else F.lit(None).cast("string"))

        def one(v: Column) -> Column:
            out = []
            for name, spec in rule["fields"].items():
                if isinstance(spec, str):
                    c = v[spec.removeprefix("$.")]
                    out.append((c.try_cast("double") if name.endswith("price") else c).alias(name))
                elif spec["strategy"] == "zip_positional":
                    c = J.zipped(F.transform(p["options"], lambda o: o["name"]), F.array(*(v[x.removeprefix("$.")] for x in spec["values_path"])))
                    out.append(c.alias(name))
                elif spec["strategy"] == "lookup":
                    out.append(J.variant_image(v, p["images"]).alias(name))
                else:
                    raise ValueError(f"unknown strategy: {spec['strategy']}")
            return F.struct(*out)

        return F.transform(p["variants"], one)

    def apply(self, pages: DataFrame) -> DataFrame:
        """pages with a column for each field."""
        have = set(pages.columns)
        out = pages.withColumn("_css", H.html_extract(self.css)("html")) if self.css else pages
        every = [(f"{n}_{i}", s) for n in self.fields for i, s in enumerate(self._sources(n))]
        if ld := {k: s["path"] for k, s in every if s["type"] == "json_ld"}:
            out = out.withColumn("_ld_found", J.json_paths(ld)(J.ld_blocks("html")))
        for r in {s["request"]: None for _, s in every if s["type"] == "json_endpoint" and s["request"] in have}:
            out = out.withColumn(f"_found_{r}", J.json_paths({k: s["path"] for k, s in every if s["type"] == "json_endpoint" and s["request"] == r})(F.array(r)))
        out = out.withColumns({f"_{n}_{i}": self._values(n, i, s, have) for n in self.fields for i, s in enumerate(self._sources(n))})
        cols = {n: self._field(n, have) for n in self.fields}
        if "variants" in self.config["extraction"]:
            cols["variants"] = self._variants(have)
        out = out.withColumns(cols)
        if "images" in cols:
            out = out.withColumn("main_image", F.get("images", F.lit(0)))
        return out.select(*pages.columns, *cols, *(["main_image"] if "images" in cols else []))

    # --- validation

    def valid_response(self, pages: DataFrame) -> DataFrame:
        """pages with valid: status, redirect, body and marker rules of the config."""
        rule = self.config.get("validation", {}).get("response", {})
        ok = F.lit(True)
        if "expect_status" in rule and "status" in pages.columns:
            ok = ok & F.coalesce(F.col("status").isin(*rule["expect_status"]), F.lit(False))
        if "reject_if_redirected_to" in rule and "final_url" in pages.columns:
            ok = ok & ~F.coalesce(F.col("final_url").rlike(java(rule["reject_if_redirected_to"])) & (F.col("final_url") != F.col("url")), F.lit(False))
        ok = ok & ~H.rejected("html", tuple(rule.get("reject_if_body_matches", ())))
        pages = pages.withColumn("_ld", J.ld_blocks("html"))
        some = F.lit(not rule.get("require_any"))
        for i, r in enumerate(rule.get("require_any", [])):
            if r["type"] == "regex":
                some = some | F.coalesce(F.col("html").rlike(java(r["pattern"])), F.lit(False))
            else:
                pages = pages.withColumn(f"_any_{i}", J.json_path(r["path"])("_ld"))
                some = some | (F.coalesce(F.size(f"_any_{i}"), F.lit(0)) > 0)
        return pages.withColumn("valid", ok & some).drop("_ld", *(c for c in pages.columns if c.startswith("_any_")))

    def item_gate(self, items: DataFrame) -> DataFrame:
        rule = self.config["validation"]["item"]
        fields = [f for f in rule["required_fields"] if f in items.columns]
        flat = items.withColumns({f: F.when(F.size(f) > 0, F.lit("x")) for f in fields if items.schema[f].dataType.typeName() == "array"})
        return quality.missing_gate(flat, fields, rule["fail_run_if_missing_ratio"])

    def warnings(self, items: DataFrame) -> DataFrame:
        fields = [f for f in self.config["validation"]["item"].get("warn_if_missing", []) if f in items.columns]
        flat = items.withColumns({f: F.when(F.size(f) > 0, F.lit("x")) for f in fields if items.schema[f].dataType.typeName() == "array"})
        return quality.coverage(flat, fields)

    def expectations(self, items: DataFrame) -> DataFrame:
        """rule, violations, items, failed for the fields that are `required` or have a `min_expected`."""
        return quality.expected_sizes(items, {n: r for n, r in self.config["extraction"].items() if n in items.columns and ("required" in r or "min_expected" in r)})

    def run_gate(self, items: DataFrame) -> DataFrame:
        rule = self.config["validation"]["run"]
        return quality.run_gate(items, rule["expected_item_count"], rule["fail_if_below_ratio"])


def _each(values: Column, f) -> Column:
    return F.transform(values, lambda x: f(x))


def _unlike(values: Column, pattern: str) -> Column:
    return F.filter(values, lambda x: ~x.rlike(pattern))


def load(path: str) -> Plan:
    import yaml

    with open(path, encoding="utf-8") as f:
        return Plan(yaml.safe_load(f))




def with_companion(pages: DataFrame, responses: DataFrame, name: str, plan: Plan) -> DataFrame:
    """pages with the body of the companion request of each page's handle in a column of that name; null where there is none.

    responses: handle, status, body. A handle with several good responses counts once.
    """
    good = responses.where("status = 200").groupBy("handle").agg(F.min("body").alias(name))
    keyed = pages.withColumn("_handle", X.present(F.regexp_extract("url", plan.handle or "(?!)()", 1)))
    return keyed.join(good, keyed["_handle"] == good["handle"], "left").drop("_handle", "handle")
