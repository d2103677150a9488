"""First-wins dedup and coverage over streams of items."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from loomstone.operators import quality

#: Rows that a task takes in before it drops all but one of a key.
BUFFERED = 100_000


def first_seen(stream: DataFrame, key: Column, row_id: str) -> DataFrame:
    """The first row of each key: of the earliest batch, and in it of the smallest id; rows with a null key all pass.

    Their stand-in key is made of the row's id, as dropDuplicates takes nulls for
    equal. Each task sends on one row of a key, so a frequent key gathers no more
    rows than there are tasks. State grows with the number of keys; see
    first_within for a bound.
    """
    whole = F.coalesce(key, F.concat(F.lit("\0"), F.col(row_id).cast("string")))
    rows = stream.withColumn("_null", key.isNull()).withColumn("_key", whole)

    def least(most: int | None):
        """The row of smallest id of each key in a task; beyond so many keys, those held go on early."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, new = [], 0
            for batch in batches:
                yield batch.filter(batch.column("_null"))
                held.append(batch.filter(pc.invert(batch.column("_null"))))
                new += held[-1].num_rows
                if new > max(BUFFERED, held[0].num_rows):
                    held, new = smallest(held), 0
                    if most and held[0].num_rows > most:
                        yield from held
                        held = []
            if held:
                yield from smallest(held)

        return run

    def smallest(batches: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        t = pa.Table.from_batches(batches).sort_by([("_key", "ascending"), (row_id, "ascending")])
        at = pa.table({"k": t["_key"], "at": pa.array(range(len(t)), pa.int64())}).group_by("k").aggregate([("at", "min")])["at_min"]
        return t.take(at).combine_chunks().to_batches() or batches[:1]

    one = rows.mapInArrow(least(BUFFERED), rows.schema).repartition("_key").mapInArrow(least(None), rows.schema)
    return one.dropDuplicates(["_key"]).drop("_key", "_null")


def first_within(stream: DataFrame, key: Column, row_id: str, time: str, delay: str) -> DataFrame:
    """As first_seen, with the state of keys older than the watermark dropped."""
    whole = F.coalesce(key, F.concat(F.lit("\0"), F.col(row_id).cast("string")))
    return stream.withColumn("_key", whole).withWatermark(time, delay).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


class Coverage(StreamingQueryListener):
    """Totals of the missing counts that the batches of a stream observe."""

    def __init__(self, name: str = "coverage"):
        self.name, self.totals = name, {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            for k, v in row.asDict().items():
                self.totals[k] = self.totals.get(k, 0) + (v or 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def with_coverage(stream: DataFrame, fields=quality.REQUIRED, name: str = "coverage") -> DataFrame:
    return stream.observe(name, F.count(F.lit(1)).alias("items"), *(F.count_if(quality.missing(stream.schema[f])).alias(f) for f in fields))


def run_once(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append all that has arrived to a Parquet table, then end."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return q
