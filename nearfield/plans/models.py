"""Queries over pluggable models, signals and streams, whose rows alone are checked."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield import working
from nearfield.functions import encoders, signal
from nearfield.io import Tables
from nearfield.plans._registry import query
from nearfield.sources import ingest
from nearfield.streaming import delivery, incremental


@query("encoded_texts", "J1")
def encoded_texts(t: Tables) -> DataFrame:
    return encoders.embedded_texts(t.part, encoders.HashingEncoder, "p_partkey", "p_name")


@query("prompt_table", "J3", "SELECT class || ' ' || CAST(n AS VARCHAR) AS prompt, class FROM (SELECT unnest(['rhythmic', 'melodic', 'vocal', 'other']) AS class), (SELECT unnest(range(0, 3)) AS n)", fixed=True)
def prompt_table(t: Tables) -> DataFrame:
    """Each class has the same number of prompts."""
    classes = t.spark.createDataFrame([(c,) for c in ("rhythmic", "melodic", "vocal", "other")], "class string")
    return classes.select("class", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("n")).select(F.concat_ws(" ", "class", F.col("n").cast("string")).alias("prompt"), "class")


@query("latent_variants", "M11", "SELECT layer, pooling FROM (SELECT unnest([8, 16, 24]) AS layer), (SELECT unnest(['mean', 'mean-std']) AS pooling)", fixed=True)
def latent_variants(t: Tables) -> DataFrame:
    layers = t.spark.createDataFrame([(8,), (16,), (24,)], "layer int")
    return layers.select("layer", F.explode(F.array(F.lit("mean"), F.lit("mean-std"))).alias("pooling"))


#: Files in a batch of rows, at most.
_FILES = 64


def _tones(suppliers: DataFrame) -> DataFrame:
    """A second of a tone for each supplier, as a WAVE file; pitch by key."""

    def make(batches):
        for b in batches:
            time = np.arange(signal.RATE) / signal.RATE
            for i in range(0, len(b), _FILES):
                part = b[i : i + _FILES].copy()
                part["content"] = [signal.wave_bytes(0.5 * np.sin(2 * np.pi * (220 + 10 * (k % 20)) * time), signal.RATE) for k in part["k"]]
                part["path"] = [f"/tones/{k}.wav" for k in part["k"]]
                yield part[["path", "content"]]

    # keys are few bytes and files are not: as many tasks as a shuffle has, and not those of the keys' one small file
    tasks = int(suppliers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return suppliers.select(F.col("s_suppkey").alias("k")).repartition(tasks).mapInPandas(make, "path string, content binary")


@query("described_tones", "I1 I3 I5 I7 I9")
def described_tones(t: Tables) -> DataFrame:
    d = signal.described_files(_tones(t.supplier))
    return d.select("path", "duration_s", "sample_rate", "channels", F.round("d.f0_hz", 1).alias("f0_hz"), F.round("d.harmonic_ratio", 3).alias("harmonic_ratio"), "error")


@query("described_changes", "A4")
def described_changes(t: Tables) -> DataFrame:
    """Of the tones, those that a walk found new or changed; others, touched ones too, aren't read."""
    k = F.col("s_suppkey")
    rows = t.supplier.select(k, F.concat(F.lit("/tones/"), k.cast("string"), F.lit(".wav")).alias("path"))
    found = rows.select("path", F.lit(1).alias("size"), F.when((k % 10).isin(4, 5), 2).otherwise(1).alias("mtime"), F.when(k % 10 == 4, "new").otherwise("old").alias("hash"))
    known = rows.where(k % 10 != 1).select(k.alias("id"), "path", F.lit(1).alias("size"), F.lit(1).alias("mtime"), F.lit("old").alias("hash"))
    due = ingest.compared(found, known).where("change in ('added', 'changed')").select("path", "change")
    d = signal.described_files(_tones(rows.join(due, "path", "left_semi")))
    return d.join(due, "path").select("path", "change", F.round("d.f0_hz", 1).alias("f0_hz"), "error")


@query("rendered_cuts", "A15")
def rendered_cuts(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    path = F.concat(F.lit("/tones/"), k.cast("string"), F.lit(".wav"))
    segments = t.supplier.select(k.alias("id"), path.alias("path"), F.lit(100).alias("start_ms"), F.lit(300).alias("end_ms"))
    return signal.rendered_segments(segments, _tones(t.supplier)).select("id", F.length("wave").alias("bytes"), "error")


@query("stream_ingest", "L1 L2")
def stream_ingest(t: Tables) -> DataFrame:
    """Event files in micro-batches; each batch is counted once."""
    rows: list[tuple[int, int]] = []
    schema = t.events.schema
    checkpoint = working.fresh(t.spark, "stream")
    incremental.new_files(t.spark, t.folder, schema, checkpoint, lambda df, n: rows.append((n, df.count())), glob="events.parquet")
    return t.spark.createDataFrame(rows, "batch long, n long")


@query("delivered_in_time", "L2", """WITH o AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events WHERE event_type IS NOT NULL AND event_id IS NOT NULL)
SELECT event_type AS run, (n - 1) // 500 AS batch, count(*) AS n, min(event_id) AS first, max(event_id) AS last, max(n) AS done, CASE WHEN count(*) = 500 THEN 'count' ELSE 'time' END AS reason FROM o GROUP BY 1, 2""")
def delivered_in_time(t: Tables) -> DataFrame:
    """All events as a stream of results, a run for each type: batches of 500, and the rest of each run after two seconds."""
    own = Tables(delivery.with_store(t.spark), t.folder)
    events = own.events
    # the table's own files, in whatever folder they lie
    stream = own.spark.readStream.schema(events.schema).parquet(f"{t.folder}/events.parquet*")
    path = working.fresh(t.spark, "delivered")
    delivery.drained(delivery.delivered(stream, "event_type", "event_id"), path, working.fresh(t.spark, "delivery"), events.where("event_type is not null and event_id is not null").count())
    out = t.spark.read.parquet(path)
    return out.select("run", "batch", F.size("items").cast("long").alias("n"), F.array_min("items").alias("first"), F.array_max("items").alias("last"), "done", "reason")
