"""Minimax contiguous partition of equal-text groups into shards.

Rows of one text form an atomic group. Groups stand in the order of their
smallest id; a shard is a run of groups. The smallest capacity C is searched
for which cutting greedily (fill a shard while the next group still fits) needs
no more than the wanted number of shards; the cuts of that C are used.

The search narrows the capacity range by a fixed factor each round: CANDIDATES
capacities are checked at once, each with one jump per shard. A jump asks for
the largest running total not above a limit; it lies less than the largest
group below the limit, so only that stretch of the written, ordered table is
read. The driver holds capacities and cuts only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm import ranks, store

SHARDS = 16
CANDIDATES = 100


def below(limits: list[int]):
    """How many of the ascending limits are smaller than end."""
    return F.size(F.filter(F.array(*(F.lit(x).cast("long") for x in limits)), lambda x: x < F.col("end")))


def jump(groups: DataFrame, limits: list[int], largest: int, total: int) -> list[int]:
    """The largest running total not above each limit; limits from 0 on, of which the smallest may reach no group."""
    asked = sorted({min(x, total) for x in limits})
    near = groups.where((F.col("end") > max(0, asked[0] - largest)) & (F.col("end") <= asked[-1]))
    found = {r["i"]: r["top"] for r in near.groupBy(below(asked).alias("i")).agg(F.max("end").alias("top")).collect()}
    best, at = 0, {}
    for i, x in enumerate(asked):
        best = max(best, found.get(i, 0))
        at[x] = best
    return [at[min(x, total)] for x in limits]


def greedy(groups: DataFrame, capacities: list[int], shards: int, largest: int, total: int) -> list[list[int]]:
    """For each capacity, the running totals at its cuts."""
    cuts: list[list[int]] = [[] for _ in capacities]
    for _ in range(shards):
        at = jump(groups, [(c[-1] if c else 0) + cap for c, cap in zip(cuts, capacities, strict=True)], largest, total)
        for c, x in zip(cuts, at, strict=True):
            c.append(x)
        if all(c[-1] == total for c in cuts):
            break
    return [c + [c[-1]] * (shards - len(c)) for c in cuts]


def minimax(groups: DataFrame, shards: int = SHARDS, candidates: int = CANDIDATES) -> list[int]:
    """Cuts of the smallest feasible capacity; groups has end (running total of the sizes) and bytes."""
    row = groups.agg(F.max("end").alias("total"), F.max("bytes").alias("largest")).first()
    if row is None or row["total"] is None:
        return [0] * shards
    total, largest = int(row["total"]), int(row["largest"])
    low = max(-(-total // shards), largest)  # nothing smaller can do
    high = low + largest  # always does: a shard is left only when less than the largest group is free
    cuts: list[int] | None = None
    while cuts is None or low < high:
        step = max(1, -(-(high - low) // candidates))
        tried = sorted({*range(low, high, step), high})
        got = greedy(groups, tried, shards, largest, total)
        k = next(i for i, c in enumerate(got) if c[-1] == total)
        high, cuts = tried[k], got[k]
        low = tried[k - 1] + 1 if k else high
    return cuts


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row.

    A null text has no bytes and is a group apart from the empty text; null ids
    come first. Rows that are equal in id and text get different slots. Slots
    follow group order, then id. An empty table gives no rows; with fewer groups
    than shards the last shards stay empty.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.when(F.col("text").isNull(), F.lit(b"\0")).otherwise(F.unhex(F.substring(F.sha2("text", 256), 1, 40)))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), key.alias("key"))
    rows = store.written(rows.withColumn("rid", F.monotonically_increasing_id()), "shard-rows")
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("doc_id").alias("lead"))
    groups = ranks.running(ranks.ordered(groups, "lead", "key", tag="shard-groups"), end="bytes", end_rows="n")
    groups = store.written(groups.select("key", F.col("pos").alias("place"), "bytes", "n", "end", "end_rows"), "shard-ends")
    cuts = minimax(groups, shards)
    groups = groups.withColumn("shard", below(cuts[:-1]))
    first = {r["shard"]: r["at"] for r in groups.groupBy("shard").agg(F.min(F.col("end_rows") - F.col("n")).alias("at")).collect()}  # a row per shard
    start = F.array(*(F.lit(first.get(k, 0)).cast("long") for k in range(shards)))
    placed = rows.join(groups.select("key", "place", "shard"), "key")
    placed = ranks.numbered(ranks.ordered(placed.drop("key"), "place", "doc_id", "rid", tag="shard-placed"))
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.get(start, F.col("shard"))).alias("slot"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharded(store.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
