"""Interactive queries beside batch work: pools, stale results, and the newest query winning."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession


@contextmanager
def pool(spark: SparkSession, name: str) -> Iterator[None]:
    """Jobs of this thread run in a FAIR pool, so that a short query needn't wait for a batch (spark.scheduler.mode=FAIR)."""
    sc = spark.sparkContext
    before = sc.getLocalProperty("spark.scheduler.pool")
    sc.setLocalProperty("spark.scheduler.pool", name)
    try:
        yield
    finally:
        sc.setLocalProperty("spark.scheduler.pool", before)


class OneWriter:
    """Batch stages run one at a time and in order; `stop` takes effect between stages' units of work."""

    def __init__(self) -> None:
        self._lock, self._stopped = threading.Lock(), threading.Event()

    def stop(self) -> None:
        self._stopped.set()

    def run(self, units: list[Callable[[], Any]]) -> list[Any]:
        with self._lock:
            self._stopped.clear()
            out = []
            for unit in units:
                if self._stopped.is_set():
                    break
                out.append(unit())
            return out


class Versioned:
    """Frames that are kept for one version of the index; a result of an older version is dropped."""

    def __init__(self) -> None:
        self.version, self._kept, self._lock = 0, {}, threading.Lock()

    def changed(self) -> None:
        """The index is another one: what is kept is let go."""
        with self._lock:
            self.version += 1
            for df in self._kept.values():
                df.unpersist()
            self._kept = {}

    def get(self, key: Any, make: Callable[[], DataFrame]) -> DataFrame | None:
        """The kept frame of a key, made and persisted at first; None if the index changed while it was made."""
        with self._lock:
            version = self.version
            if key in self._kept:
                return self._kept[key]
        df = make().persist()
        with self._lock:
            if version != self.version:
                df.unpersist()
                return None
            self._kept[key] = df
            return df


class NewestWins:
    """One query at a time: a newer one interrupts the running one, whose result is None."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self._n, self._lock, self._last = spark, 0, threading.Lock(), None
        self._threads = ThreadPoolExecutor(max_workers=4)

    def submit(self, query: Callable[[], Any]) -> Future:
        with self._lock:
            self._n += 1
            mine, last = self._n, self._last

        sc = self.spark.sparkContext

        def work() -> Any:
            sc.addJobTag(f"query-{mine}")
            sc.setInterruptOnCancel(True)
            try:
                # again and again, as a job that hasn't begun can't be interrupted
                while last is not None and not last.done():
                    self.spark.sparkContext.cancelJobsWithTag(f"query-{mine - 1}")
                    time.sleep(0.05)
                if mine != self._n:
                    return None
                out = query()
                return out if mine == self._n else None
            except Exception:
                if mine != self._n:
                    return None
                raise
            finally:
                sc.removeJobTag(f"query-{mine}")

        with self._lock:
            future = self._last = self._threads.submit(work)
        return future
