"""Results of a stream delivered in batches: when so many have come, or when the first of them has waited long enough."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Rows of a full batch, and the milliseconds after which a smaller one goes.
ROWS, WAIT_MS = 500, 2000

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Batches(StatefulProcessor):
    """Holds a run's results until `rows` of them have come or the oldest has waited `wait_ms`; then they leave as one batch, in order.

    State, by run: what is held, the number of the next batch, the results delivered so
    far, and when the timer is due.  It lives in the state store, so a batch that is
    open survives the loss of an executor, and none is delivered twice by a query
    that writes its batches once.
    """

    def __init__(self, rows: int, wait_ms: int) -> None:
        self.rows, self.wait_ms = rows, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "item long")
        self.at = handle.getValueState("at", "batch long, done long, due long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch, done, due = self.at.get() if self.at.exists() else (0, 0, 0)
        held = [r[0] for r in self.held.get()] if self.held.exists() else []
        # rows of a micro-batch come in any order
        held += sorted(x for part in rows for x in part["item"].tolist())
        full = len(held) // self.rows * self.rows
        for a in range(0, full, self.rows):
            done += self.rows
            yield self._delivered(key, batch, held[a : a + self.rows], done, "count")
            batch += 1
        now = timerValues.getCurrentProcessingTimeInMs()
        rest = held[full:]
        if due and (full or not rest):
            self.handle.deleteTimer(due)
            due = 0
        if rest and not due:
            due = now + self.wait_ms
            self.handle.registerTimer(due)
        self._keep(rest, batch, done, due)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        batch, done, due = self.at.get()
        held = [r[0] for r in self.held.get()] if self.held.exists() else []
        if held and due and expiredTimerInfo.getExpiryTimeInMs() >= due:
            done += len(held)
            yield self._delivered(key, batch, held, done, "time")
            self._keep([], batch + 1, done, 0)

    def _keep(self, held: list[int], batch: int, done: int, due: int) -> None:
        if held:
            self.held.put([(x,) for x in held])
        else:
            self.held.clear()
        self.at.update((batch, done, due))

    @staticmethod
    def _delivered(key: Any, batch: int, items: list[int], done: int, reason: str) -> pd.DataFrame:
        return pd.DataFrame({"run": [key[0]], "batch": [batch], "items": [items], "done": [done], "reason": [reason]})

    def close(self) -> None:
        pass


def delivered(results: DataFrame, run: str, item: str, *, rows: int = ROWS, wait_ms: int = WAIT_MS) -> DataFrame:
    """(run, batch, items, done, reason) of a stream of results: batches of `rows`, or of what has come `wait_ms` after the first of them.

    reason: count or time; done: a run's results up to and with the batch.  Results
    of a run are one key of the state.  A null run or item isn't delivered.  The
    session's state store must be RocksDB (see STORE).
    """
    kept = results.select(F.col(run).cast("string").alias("run"), F.col(item).cast("long").alias("item")).where("run is not null and item is not null")
    return kept.groupBy("run").transformWithStateInPandas(Batches(rows, wait_ms), "run string, batch long, items array<long>, done long, reason string", "Append", "ProcessingTime")


def with_store(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep their state in RocksDB."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    return own


def drained(batches: DataFrame, path: str, checkpoint: str, total: int, *, every: str = "200 milliseconds", most_s: float = 300.0) -> None:
    """Write delivered batches to `path` until `total` results have left, or raise."""
    import time

    query = batches.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime=every).start()
    spark, began = batches.sparkSession, time.monotonic()
    try:
        while True:
            if query.exception() is not None:
                raise query.exception()
            if total <= _count(spark, path):
                return
            if time.monotonic() - began > most_s:
                raise TimeoutError(f"not delivered within {most_s} s")
            time.sleep(0.3)
    finally:
        query.stop()


def _count(spark: SparkSession, path: str) -> int:
    """Results in the batches that are committed."""
    from nearfield import files

    if "_spark_metadata" not in files.names(spark, path) or not files.names(spark, f"{path}/_spark_metadata"):
        return 0
    return spark.read.schema("items array<long>").parquet(path).agg(F.coalesce(F.sum(F.size("items")), F.lit(0))).first()[0]
