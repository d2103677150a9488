"""A filter by ids of fixed size, so that texts nobody asks for aren't shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm import store

#: Cells of the filter, 2 MB in all, and of one of its rows.
SIEVE, SIEVE_ROW = 1 << 24, 1 << 14


def sifted(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id may be among the ids: none is lost, few others stay.

    A bit for each cell of the ids' hashes, SIEVE bits whatever their number, is
    sent to all tasks, so the texts of other rows aren't shuffled.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, np.ndarray] = {}
        for batch in batches:
            cell = batch.column(0).to_numpy()
            for r in np.unique(cell // SIEVE_ROW).tolist():
                low = cell[cell // SIEVE_ROW == r] % SIEVE_ROW
                np.bitwise_or.at(rows.setdefault(r, np.zeros(SIEVE_ROW // 8, np.uint8)), low >> 3, (1 << (low & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), pa.array([x.tobytes() for x in rows.values()], pa.binary())], ["row", "bits"])

    cell = F.pmod(F.xxhash64("doc_id"), F.lit(SIEVE))
    cells = ids.select(cell.alias("cell")).distinct()
    n = min(store.partitions(docs.sparkSession), SIEVE // SIEVE_ROW)
    sieve = cells.repartition(n, F.floor(F.col("cell") / SIEVE_ROW)).mapInArrow(build, "row long, bits binary")
    sieve = store.written(sieve.coalesce(4), "sieve")
    low = F.col("cell") % SIEVE_ROW
    byte = F.conv(F.hex(F.substr("bits", (F.floor(low / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    rows = docs.withColumn("cell", cell).withColumn("row", F.floor(F.col("cell") / SIEVE_ROW))
    return rows.join(F.broadcast(sieve), "row").where(F.getbit(byte, (low % 8).cast("int")) == 1).select(*docs.columns)  # SIEVE bits
