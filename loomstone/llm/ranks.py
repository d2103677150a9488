"""Running totals and row numbers over a global order, without one task for all rows.

Rows are dealt by ranges of their sort key, numbered inside each range, and
written; the totals of the ranges, one row each, give every range its offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm import store


def ordered(df: DataFrame, *keys: str, tag: str = "ordered") -> DataFrame:
    """df written in the order of the keys, with part (range number) and pos (ascending over all rows).

    The keys together must tell all rows apart, or rows that they don't tell
    apart must be the same.
    """
    n = store.partitions(df.sparkSession)
    put = df.repartitionByRange(n, *(F.col(k) for k in keys)).sortWithinPartitions(*keys)
    return store.written(put.withColumn("pos", F.monotonically_increasing_id()).withColumn("part", F.shiftrightunsigned("pos", 33)), tag)


def offsets(df: DataFrame, **sums: str) -> DataFrame:
    """part and, for each name=column, the column's total over all earlier parts; a row per part."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per = df.groupBy("part").agg(*(F.sum(c).alias(f"{k}_sum") for k, c in sums.items()))
    return per.select("part", *(F.coalesce(F.sum(f"{k}_sum").over(before), F.lit(0)).alias(k) for k in sums))


def running(df: DataFrame, **sums: str) -> DataFrame:
    """Adds, for each name=column, the column's inclusive running total in the order of pos."""
    inside = Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = df.join(F.broadcast(offsets(df, **{f"_{k}": c for k, c in sums.items()})), "part")  # a row per range
    return out.select(*df.columns, *((F.sum(c).over(inside) + F.col(f"_{k}")).alias(k) for k, c in sums.items()))


def numbered(df: DataFrame) -> DataFrame:
    """Adds rank, the gapless number from 0 in the order of pos."""
    low = (1 << 33) - 1
    out = df.withColumn("_one", F.lit(1))
    return df.join(F.broadcast(offsets(out, _before="_one")), "part").withColumn("rank", F.col("_before") + F.col("pos").bitwiseAND(F.lit(low))).drop("_before")
