"""Slices of time that close by event-time timers, with late rows told apart."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from archivolt.sources.shared import settings

#: The state store that timers need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Parts that a slice's rows are dealt to, so that a slice with very many rows is no single task's.
SHARDS = 16


class ClosingSlices(StatefulProcessor):
    """Counts a slice's rows until its timer: then the count is given once and the state goes. Rows that arrive at or after
    the slice's closing make a `refetch` record of their number, and no state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = late = 0
        closes = None
        for part in rows:
            closes = int(part.closes.iloc[0])
            behind = int((part.arrived_ms >= closes).sum())
            late += behind
            n += len(part) - behind
        if n:
            if self.count.exists():
                n += self.count.get()[0]
            else:
                self.handle.registerTimer(closes)
            self.count.update((n,))
        if late:
            yield pd.DataFrame({"slice": [key[0]], "kind": ["refetch"], "n": [late]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n = self.count.get()[0]
        self.count.clear()
        yield pd.DataFrame({"slice": [key[0]], "kind": ["closed"], "n": [n]})

    def close(self) -> None:
        pass


def closing_days(events: DataFrame, time: str, arrived: str, spread: Column, lateness: str = "6 hours", disorder: str = "0 seconds") -> DataFrame:
    """(slice DATE, kind, n) of a stream of rows that happen at `time` and arrive at `arrived`, in append mode.

    A day stays open for `lateness` after its end, in time of arrival. Its `closed` counts come once, when that has passed;
    rows that arrive later come as `refetch` records, for days that must be fetched again. The watermark follows the arrivals:
    rows of later batches may come up to `disorder` before those already there. `spread`: what deals a day's rows to SHARDS parts;
    each part gives its own rows of the result, to be added up. Rows without either time belong to no day and are left out.
    The state holds one number for each part of an open day.
    """
    at, now = F.col(time), F.col(arrived).cast("timestamp")
    closes = F.unix_millis((F.date_trunc("day", at.cast("timestamp_ntz")) + F.expr(f"interval 1 day + interval {lateness}")).cast("timestamp"))
    rows = events.where(at.isNotNull() & F.col(arrived).isNotNull()).select(
        F.date_format(at, "yyyy-MM-dd").alias("slice"), F.pmod(F.xxhash64(spread), F.lit(SHARDS)).alias("shard"),
        now.alias("arrived"), F.unix_millis(now).alias("arrived_ms"), closes.alias("closes"),
    )
    kept = rows.withWatermark("arrived", disorder).groupBy("slice", "shard").transformWithStateInPandas(
        ClosingSlices(), "slice string, kind string, n long", "Append", "EventTime"
    )
    return kept.select(F.to_date("slice").alias("slice"), "kind", "n")


def resume(stream: DataFrame, out: str, checkpoint: str) -> list[dict]:
    """Runs a stream from its checkpoint over what has come since, each batch into a folder of `out` that running it again
    replaces. Gives the progress of the run's batches."""
    def put(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={k}")

    with settings(stream.sparkSession, **{"spark.sql.streaming.stateStore.providerClass": ROCKS}):
        query = stream.writeStream.foreachBatch(put).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    return query.recentProgress
