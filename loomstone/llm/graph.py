"""Connected components of a written edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm import store


#: Edges up to which one task (16 bytes an edge) finishes what rounds of joins would.
ONE_TASK = 1 << 20


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, roots) of all ids in the edges, by the smallest label of neighbours and by jumping to labels' labels."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        new = label.copy()
        np.minimum.at(new, label[a], label[b])  # a root learns of its members' neighbours
        np.minimum.at(new, label[b], label[a])
        new = new[label]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return ids, ids[label]
        label = new


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if got:
        ids, root = roots(*(np.concatenate(x) for x in zip(*got, strict=True)))
        away = ids != root
        yield pa.RecordBatch.from_arrays([pa.array(ids[away]), pa.array(root[away])], ["id", "root"])


def _large(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    hung = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.withColumnRenamed("m", "v"))


def components(edges: DataFrame, tag: str = "components", one_task: int = ONE_TASK) -> DataFrame:
    """id and root (the smallest id that can be reached) of every id in an edge (a, b) but the roots themselves.

    A small table is finished in one task; its size is checked. Ids that no edge names are not in the result; loops and repeated edges are
    harmless. Neighbour lists are never gathered: a vertex only learns its
    smallest neighbour, so a vertex of any degree is a plain aggregation.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = store.written(e, tag)
    if e.count() <= one_task:
        return store.written(e.coalesce(1).mapInArrow(_finish, "id long, root long"), tag)
    while True:
        # Done when all edges are stars: each child has one edge, and no root is a child.
        ends = e.select("u", F.lit(1).alias("child"), F.lit(0).alias("root")).unionByName(e.select(F.col("v").alias("u"), F.lit(0).alias("child"), F.lit(1).alias("root")))
        seen = ends.groupBy("u").agg(F.sum("child").alias("child"), F.max("root").alias("root"))
        if not seen.where("child > 1 or (child = 1 and root = 1)").agg(F.count("*")).first()[0]:
            return e.select(F.col("u").alias("id"), F.col("v").alias("root"))
        e = store.written(_small(_large(e).distinct()).distinct(), tag)
