"""Mixing sources to target weights with a low-discrepancy schedule.

Each source's documents, shuffled by a hash, form a stream of words that
repeats up to MAX_EPOCHS times. A mix is a row of slots of equal token counts.
Slot n belongs to the source in whose stretch of the cumulative target weights
the n-th golden-ratio point falls; the slots of a source are ranked, and its
rank r takes the r-th block of its stream. So any run of slots holds the sources
near their weights, and the blocks a source needs come to its target exactly:
points beyond a source's last block are unused, and blocks left without a point
follow in slots at the end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.llm import ranks, store

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
SLOTS = 1 << 16
GOLDEN = 0.6180339887498949
#: Slots that are ranked together.
CHUNK = 1 << 10
SEED = 20240917


@dataclass(frozen=True)
class Source:
    name: str | None
    size: int
    target: float
    taken: int
    start: int


def targets(sizes: list[int], weights: list[float], most: int = MAX_EPOCHS) -> list[float]:
    """Shares of the total by weight, none above most times its size; the excess goes to the others by weight."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        per = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if per * weights[i] > most * sizes[i]}
        for i in full or open_:
            out[i] = float(most * sizes[i]) if full else per * weights[i]
        if not full:
            break
        left -= sum(out[i] for i in full)
        open_ -= full
    return out


def plan(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> list[Source]:
    """Sources by code point, null last, with their targets; one row per source comes to the driver."""
    got = rows.groupBy("source").agg(F.sum("size").alias("size")).collect()
    got = sorted(got, key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["size"]) for r in got]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(got))])
    at = [sum(sizes[:i]) for i in range(len(sizes))]
    return [Source(r["source"], s, t, min(round(t), MAX_EPOCHS * s), a) for r, s, t, a in zip(got, sizes, goal, at, strict=True)]


def schedule(spark: SparkSession, sources: list[Source], block: int) -> DataFrame:
    """slot, src, r: the slots in order; at most one per block and so of bounded number.

    Ranks are counted inside chunks of slots, each offset by its source's slots
    in the chunks before.
    """
    total = sum(s.taken for s in sources)
    n = -(-total // block)
    ends, acc = [], 0.0
    for s in sources:
        acc += s.taken / max(1, total)
        ends.append(acc)
    point = F.pmod((F.col("id") + 0.5) * F.lit(GOLDEN), F.lit(1.0))
    need = F.array(*(F.lit(-(-s.taken // block)).cast("long") for s in sources))
    src = F.least(F.size(F.filter(F.array(*map(F.lit, ends)), lambda x: x <= F.col("u"))), F.lit(len(sources) - 1))
    slots = spark.range(n).withColumn("u", point).withColumn("src", src).withColumn("chunk", F.floor(F.col("id") / CHUNK))
    earlier = Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = slots.groupBy("src", "chunk").agg(F.count("*").alias("k")).select("src", "chunk", F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("before"))
    slots = slots.withColumn("r", F.row_number().over(Window.partitionBy("src", "chunk").orderBy("id")) - 1)
    slots = slots.join(F.broadcast(before), ["src", "chunk"]).withColumn("r", F.col("r") + F.col("before"))  # no more rows than slots
    hit = slots.where(F.col("r") < F.get(need, F.col("src"))).select(F.col("id").alias("slot"), "src", F.col("r").cast("long").alias("r"))
    every = store.local(spark, [(i, -(-s.taken // block)) for i, s in enumerate(sources) if s.taken], "src int, n long")
    every = every.select("src", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("r"))
    rest = every.join(hit, ["src", "r"], "left_anti").select((F.lit(n) + F.col("r") * len(sources) + F.col("src")).alias("slot"), "src", "r")
    return hit.unionByName(rest)


def words(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def measured(docs: DataFrame, *more) -> DataFrame:
    """Written rows of rid, doc_id, source, size and shuffle (a hash of id and text), and more columns; the texts are read once."""
    own = [F.monotonically_increasing_id().alias("rid"), F.col("doc_id"), F.col("source"), words().alias("size"), F.xxhash64(F.lit(SEED), F.col("doc_id"), F.col("text")).alias("shuffle")]
    return store.written(docs.select(*own, *more), "mix-sizes")


def streams(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> tuple[DataFrame, list[Source]]:
    """Measured rows in stream order with src, at (words of the source's stream before), and what is known of their source; and the sources."""
    rows = rows.select("*", F.col("source").isNull().alias("last"))
    rows = ranks.ordered(rows, "last", "source", "shuffle", "doc_id", "rid", tag="mix-rows")
    sources = plan(rows, weights)
    info = [(i, s.name, s.size, s.target, s.taken, s.start) for i, s in enumerate(sources)]
    info = store.local(rows.sparkSession, info, "src int, name string, source_size long, target double, goal long, src_start long")
    rows = ranks.running(rows, end="size").join(F.broadcast(info), F.col("source").eqNullSafe(F.col("name")))  # a row per source
    return rows.select("rid", "pos", "doc_id", "size", "source_size", "target", "goal", "src", (F.col("end") - F.col("size") - F.col("src_start")).alias("at")), sources


def epochs():
    """Where in the repeated stream of its source a row starts, for each time that the mix reaches it."""
    starts = F.transform(F.array(*(F.lit(e).cast("long") for e in range(MAX_EPOCHS))), lambda e: F.col("at") + e * F.col("source_size"))
    return F.filter(starts, lambda b: (b < F.col("goal")) & (F.col("size") > 0))


def block_words(sources: list[Source], slots: int) -> int:
    return max(1, -(-sum(s.taken for s in sources) // slots))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, source_size, target, taken and first_slot of every row of docs (doc_id, text, source).

    A null text has no words and is never taken; null sources form one source,
    the last; an id that repeats counts as so many documents. Ties cannot
    change the result: rows that id, source and text don't tell apart are the
    same. A text of any length is only counted where it is read. An empty table
    gives no rows. first_slot is the slot that first holds words of the row,
    null where none does.
    """
    rows, sources = streams(measured(docs), weights)
    if not sources:
        return rows.select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("first_slot"))
    block = block_words(sources, slots)
    uses = rows.select("*", F.explode_outer(epochs()).alias("lo")).withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("goal")))
    span = F.when(F.col("lo").isNotNull(), F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block)))
    cut = uses.select("*", F.explode_outer(span).alias("r"))
    cut = cut.join(F.broadcast(schedule(docs.sparkSession, sources, block)), ["src", "r"], "left")  # at most slots + sources rows
    part = F.when(F.col("slot").isNotNull(), F.least("hi", (F.col("r") + 1) * block) - F.greatest("lo", F.col("r") * block)).otherwise(0)
    out = cut.groupBy("pos", "doc_id", "size", "source_size", "target").agg(F.sum(part).alias("taken"), F.min("slot").alias("first_slot"))
    return out.drop("pos")


def remixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, slots: int = SLOTS) -> DataFrame:
    """docs itself, all columns, in mixed amounts and in the order of the schedule.

    A row stands once for each time that the mix reaches it, in the slot that
    holds its first word; the row in which a source's target ends is kept
    whole, so a source exceeds its target by less than one of its documents.
    Partitions and the rows in them follow the slots. A null or empty text has
    no words and is never taken, a null source is a source, rows that repeat
    are taken each for itself, and an empty table gives no rows. Texts are
    shuffled twice, to their places and to their slots; all that is computed
    before that is computed on sizes.
    """
    spark = docs.sparkSession
    base = measured(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    rows, sources = streams(base.drop("doc"), weights)
    if not sources:
        return base.select("doc.*")
    block, parts = block_words(sources, slots), store.partitions(spark)
    n = max(1, -(-sum(s.taken for s in sources) // block))
    uses = rows.select("rid", "src", F.explode(epochs()).alias("lo")).withColumn("r", F.floor(F.col("lo") / block))
    uses = uses.join(F.broadcast(schedule(spark, sources, block)), ["src", "r"]).select("rid", "slot", "src", "lo")  # at most slots + sources rows
    uses = uses.withColumn("part", F.least(F.floor(F.col("slot") * parts / n), F.lit(parts - 1)).cast("int"))  # slots hold equal amounts
    return base.select("rid", "doc").join(uses, "rid").repartitionById(parts, F.col("part")).sortWithinPartitions("slot", "src", "lo").select("doc.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(store.table(spark, sf_dir, "documents"))
