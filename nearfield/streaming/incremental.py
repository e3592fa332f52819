"""Incremental work on files, and live segmentation of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def new_files(spark: SparkSession, folder: str, schema: T.StructType, checkpoint: str, apply: Callable[[DataFrame, int], None], *, most: int = 500, glob: str | None = None, every: str | None = None) -> int:
    """Apply a function to batches of files that no earlier run has seen; the number of batches. What is seen is kept in the checkpoint.

    A batch has `most` files at most, each of which gives a row of results.  every:
    an interval, such as "2 seconds", at which what has come is delivered until
    nothing is left; without one, batches follow each other at once.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", most)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    count = 0

    def each(df: DataFrame, batch: int) -> None:
        nonlocal count
        count += 1
        apply(df, batch)

    writer = reader.parquet(folder).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    if every is None:
        writer.trigger(availableNow=True).start().awaitTermination()
        return count
    query = writer.trigger(processingTime=every).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return count


def live_counts(events: DataFrame, time: str, key: str, value: str, *, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by key and tumbling window, final once the watermark has passed."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def live_sessions(events: DataFrame, time: str, key: str, *, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Intervals of events of a key with no gap as long as `gap`."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
