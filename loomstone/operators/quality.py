"""Run-level operators: first-wins dedup, coverage, gates, diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

REQUIRED = ("title", "price", "availability", "category", "upc", "description", "product_url", "image_url")


def item_key(first: str = "upc", other: str = "product_url") -> Column:
    """The first column if it says something, else the other."""
    return F.when(F.col(first).isNotNull() & (F.col(first) != ""), F.col(first)).otherwise(F.col(other))


def keep_first(df: DataFrame, key: Column, order: str) -> DataFrame:
    """Of the rows of a key the first in order; rows whose key is NULL all stay.

    The least row of each key is a plain aggregation, combined before the
    shuffle, so a key with most of the rows is no burden. Columns of any type
    pass through.
    """
    cols = df.columns
    marked = df.withColumn("_key", key)
    first = marked.where(F.col("_key").isNotNull()).groupBy("_key").agg(F.min_by(F.struct(*cols), F.col(order)).alias("_row")).select("_row.*")
    return first.unionByName(marked.where(F.col("_key").isNull()).select(*cols))


def duplicate_tally(df: DataFrame, key: Column) -> DataFrame:
    """unique_keys and dropped: rows with a key, less their distinct keys."""
    return df.select(key.alias("k")).groupBy("k").agg(F.count("*").alias("n")).where("k is not null").agg(F.count("*").alias("unique_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("dropped"))


def missing(field: T.StructField) -> Column:
    c = F.col(field.name)
    return c.isNull() | (c == "") if isinstance(field.dataType, T.StringType) else c.isNull()


def _fields(df: DataFrame, names) -> list[T.StructField]:
    return [df.schema[n] for n in names]


def coverage(df: DataFrame, fields=REQUIRED) -> DataFrame:
    """field, missing, items: the required fields that some item misses."""
    row = df.agg(F.count("*").alias("items"), *(F.count_if(missing(f)).alias(f.name) for f in _fields(df, fields)))
    return _tall(row, fields, "missing").where("missing > 0")


def _tall(row: DataFrame, fields, value: str, *keep: str) -> DataFrame:
    pairs = ", ".join(f"'{f}', `{f}`" for f in fields)
    return row.selectExpr(*keep, "items", f"stack({len(fields)}, {pairs}) as (field, {value})").select(*keep, "field", value, "items")


def plausible_price(price, low: float, high: float) -> Column:
    """Is a price a number above 0 and within the bounds?"""
    p = F.col(price) if isinstance(price, str) else price
    return F.coalesce(p.isNotNull() & ~F.isnan(p.cast("double")) & (p > 0) & p.between(low, high), F.lit(False))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, violations, items, failed: how many items break each rule; a rule that is NULL for an item is broken."""
    row = df.agg(F.count("*").alias("items"), *(F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()))
    return _tall(row, list(rules), "violations").select(F.col("field").alias("rule"), "violations", "items", (F.col("violations") > 0).alias("failed"))


def expected_sizes(df: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """rule, violations, items, failed for fields that a config calls `required` or of which it expects `min_expected` elements."""
    by = {}
    for name, rule in rules.items():
        many = df.schema[name].dataType.typeName() == "array"
        least = max(int(rule.get("min_expected", 0)), int(bool(rule.get("required"))))
        if least:
            by[name] = F.size(name) >= least if many else ~missing(df.schema[name])
    return violations(df, by)


def coverage_by(df: DataFrame, group: str, fields) -> DataFrame:
    """group, field, share: how much of each group has the field."""
    row = df.groupBy(group).agg(F.count("*").alias("items"), *(F.avg((~missing(f)).cast("double")).alias(f.name) for f in _fields(df, fields)))
    return _tall(row, fields, "share", group)


def missing_gate(df: DataFrame, fields, most: float = 0.10) -> DataFrame:
    """field, ratio, failed: does a required field miss in more than the allowed share of the items?"""
    row = df.agg(F.count("*").alias("items"), *(F.coalesce(F.avg(missing(f).cast("double")), F.lit(0.0)).alias(f.name) for f in _fields(df, fields)))
    return _tall(row, fields, "ratio").withColumn("failed", F.col("ratio") > most)


def run_gate(df: DataFrame, expected: int, least: float = 0.80) -> DataFrame:
    """items, ratio, failed: does the run fall below the expected count?"""
    row = df.agg(F.count("*").alias("items"))
    return row.withColumn("ratio", F.col("items") / F.lit(float(expected))).withColumn("failed", F.col("ratio") < least)


def run_stats(responses: DataFrame) -> DataFrame:
    """status, requests, mean_bytes, retryable."""
    from loomstone.functions.html import retryable

    return responses.groupBy("status").agg(F.count("*").alias("requests"), F.avg(F.octet_length("html")).alias("mean_bytes")).withColumn("retryable", retryable("status"))


def size_anomalies(responses: DataFrame, factor: float = 3.0) -> DataFrame:
    """Rows whose size is factor times above or below the run's mean; the mean is one row, joined to all."""
    mean = responses.agg(F.avg(F.octet_length("html")).alias("mean_bytes"))
    sized = responses.withColumn("bytes", F.octet_length("html").cast("long")).crossJoin(F.broadcast(mean))  # one row
    return sized.where((F.col("bytes") > F.col("mean_bytes") * factor) | (F.col("bytes") * factor < F.col("mean_bytes")))


def diff(old: DataFrame, new: DataFrame, key: str, fields) -> DataFrame:
    """key, change (added, removed, changed), fields: what differs between two runs; null equals null."""
    a, b = (df.select(F.col(key), *(F.col(f).alias(f"{p}_{f}") for f in fields), F.lit(True).alias(p)) for df, p in ((old, "old"), (new, "new")))
    both = a.join(b, key, "full_outer")
    differ = F.filter(F.array(*(F.when(~F.col(f"old_{f}").eqNullSafe(F.col(f"new_{f}")), F.lit(f)) for f in fields)), lambda x: x.isNotNull())
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.size(differ) > 0, "changed")
    return both.select(key, change.alias("change"), F.when(change == "changed", differ).alias("fields")).where("change is not null")


def agreement(left: DataFrame, right: DataFrame, key: str, field: str) -> DataFrame:
    """agree, n: how two sources of one field compare over all keys."""
    a, b = left.select(key, F.col(field).alias("a"), F.lit(1).alias("l")), right.select(key, F.col(field).alias("b"), F.lit(1).alias("r"))
    say = F.when(F.col("l").isNull(), "right only").when(F.col("r").isNull(), "left only").when(F.col("a").eqNullSafe(F.col("b")), "agree").otherwise("differ")
    return a.join(b, key, "full_outer").groupBy(say.alias("verdict")).agg(F.count("*").alias("n"))


def completeness(found: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """found, listed, missed, extra: distinct keys of a crawl against those of a sitemap."""
    both = found.select(key).distinct().withColumn("f", F.lit(1)).join(listed.select(key).distinct().withColumn("l", F.lit(1)), key, "full_outer")
    return both.agg(F.count("f").alias("found"), F.count("l").alias("listed"), F.count_if(F.col("f").isNull()).alias("missed"), F.count_if(F.col("l").isNull()).alias("extra"))


def passed_tally(results: DataFrame, passed: str = "passed") -> DataFrame:
    """passed, total, ok: ok only if every case passed."""
    return results.agg(F.count_if(F.col(passed)).alias("passed"), F.count("*").alias("total"), F.coalesce(F.every(F.col(passed)), F.lit(True)).alias("ok"))


def observed(df: DataFrame, fields=REQUIRED, name: str = "coverage") -> tuple[DataFrame, Observation]:
    """df, and an observation that holds the missing counts once df has been written."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("items"), *(F.count_if(missing(f)).alias(f.name) for f in _fields(df, fields))), seen


def same_size(honest: DataFrame, browser: DataFrame, key: str = "url", most: int = 5000) -> DataFrame:
    """Two fetches of each page under different user agents: are they served alike?"""
    a, b = honest.select(key, F.octet_length("html").alias("a")), browser.select(key, F.octet_length("html").alias("b"))
    gap = F.abs(F.col("a") - F.col("b"))
    return a.join(b, key).select(key, gap.cast("long").alias("gap"), F.when(gap < most, "no gating").otherwise("investigate").alias("verdict"))


def forward_fill(df: DataFrame, value: str, order: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """df with the value's last non-null so far, in order within by."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(f"{value}_filled", F.last(value, ignorenulls=True).over(w))


def ranked_sources(df: DataFrame, key: str, priority: str) -> DataFrame:
    """Of the discoveries of one URL the one of the best source."""
    return df.groupBy(key).agg(F.min_by(F.struct(*[c for c in df.columns if c != key]), F.col(priority)).alias("_r")).select(key, "_r.*")
