"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

A record's slot is a hash of its id modulo SLOTS, and never changes.  Bytes and
rows are summed by slot (a table of SLOTS rows at most, whatever the corpus), and
a map gives each slot a shard: slots in order of falling bytes, each to the
lightest shard so far.  The map is a small table with a version.  Rebalancing
edits it: slots leave the heaviest shard for the lightest while that narrows the
gap, and the result is the next version; growing adds an empty shard that
only receives.  Old versions stay readable.

The law that holds is `bytes`: shards' sizes are near equal.

Defined cases: a null text has no bytes (a row's size is 8 then, its checksum
0); rows without an id have the slot of a hash of their text; rows that repeat an
id share its slot; an empty table gives an empty map with all slots on shard 0 ..,
in turn; one record of more bytes than a shard's share makes its shard the
heaviest, as records aren't cut; further columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Virtual slots; fixed for the life of a data set.
SLOTS = 8192
#: Bytes that a row costs besides its text.
ROW_BYTES = 8


def slot_of(doc: Column, text: Column, slots: int = SLOTS) -> Column:
    """By the id; rows without one are dealt by their texts."""
    return F.pmod(F.when(doc.isNull(), F.xxhash64(F.lit(1), text)).otherwise(F.xxhash64(doc)), F.lit(slots)).cast("int")


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


@dataclass(frozen=True)
class SlotMap:
    """One version of the map: shard_of[slot]."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    @classmethod
    def balanced(cls, sizes: list[int], shards: int) -> SlotMap:
        """Version 1: heaviest slots first, each to the lightest shard; ties to the smaller number."""
        loads = [(0, s) for s in range(shards)]
        out = [0] * len(sizes)
        for slot in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            load, shard = loads[0]
            out[slot] = shard
            # an empty slot counts a little, so that empty ones are dealt in turn
            heapq.heapreplace(loads, (load + max(sizes[slot], 1), shard))
        return cls(1, shards, tuple(out))

    def loads(self, sizes: list[int]) -> list[int]:
        out = [0] * self.shards
        for slot, shard in enumerate(self.shard_of):
            out[shard] += sizes[slot]
        return out

    def rebalanced(self, sizes: list[int], tolerance: float = 0.01) -> SlotMap:
        """The next version: as few slots as needed leave heavy shards, until none is above the mean by more than `tolerance`, or no move helps."""
        out, loads = list(self.shard_of), self.loads(sizes)
        mean = sum(loads) / self.shards
        of = {s: [] for s in range(self.shards)}
        for slot, shard in enumerate(out):
            of[shard].append(slot)
        while True:
            heavy, light = max(range(self.shards), key=lambda s: (loads[s], -s)), min(range(self.shards), key=lambda s: (loads[s], s))
            gap = loads[heavy] - loads[light]
            if loads[heavy] <= mean * (1 + tolerance) and loads[light] >= mean * (1 - tolerance):
                break
            fits = [s for s in of[heavy] if 0 < sizes[s] < gap]
            if not fits:
                break
            slot = min(fits, key=lambda s: (abs(gap / 2 - sizes[s]), s))
            of[heavy].remove(slot)
            of[light].append(slot)
            out[slot] = light
            loads[heavy] -= sizes[slot]
            loads[light] += sizes[slot]
        return SlotMap(self.version + 1, self.shards, tuple(out))

    def grown(self, sizes: list[int], shards: int) -> SlotMap:
        """The next version with more shards: slots move to new shards only, from the heaviest ones, until each has its share."""
        if shards < self.shards:
            raise ValueError("shards can't be taken away by growing")
        out, loads = list(self.shard_of), [*self.loads(sizes), *[0] * (shards - self.shards)]
        mean = sum(loads) / shards
        for new in range(self.shards, shards):
            for slot in sorted(range(len(out)), key=lambda s: (-sizes[s], s)):
                old = out[slot]
                if old < self.shards and loads[old] - sizes[slot] >= mean * 0.98 and loads[new] + sizes[slot] <= mean * 1.02:
                    out[slot] = new
                    loads[old] -= sizes[slot]
                    loads[new] += sizes[slot]
        return SlotMap(self.version + 1, shards, tuple(out))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.version, slot, shard) for slot, shard in enumerate(self.shard_of)], "version int, slot int, shard int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Add this version to the table at `path`; a version that is there already is refused."""
        if self.version in versions(spark, path):
            raise ValueError(f"version {self.version} is stored already")
        self.table(spark).coalesce(1).write.partitionBy("version").mode("append").parquet(path)


def versions(spark: SparkSession, path: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return []
    return sorted(r[0] for r in spark.read.parquet(path).select("version").distinct().collect())


def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """A stored version, the latest unless one is named."""
    version = max(versions(spark, path)) if version is None else version
    rows = spark.read.parquet(path).where(F.col("version") == version).orderBy("slot").collect()
    return SlotMap(version, max(r["shard"] for r in rows) + 1, tuple(r["shard"] for r in rows))


def slot_totals(df: DataFrame, doc: str = "doc_id", text: str = "text", slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows by slot: SLOTS pairs of numbers."""
    totals = df.select(slot_of(df[doc], df[text], slots).alias("s"), size_of(df[text]).alias("b")).groupBy("s").agg(F.sum("b").alias("b"), F.count("*").alias("n")).collect()
    sizes, rows = [0] * slots, [0] * slots
    for r in totals:
        sizes[r["s"]], rows[r["s"]] = r["b"], r["n"]
    return sizes, rows


def sharded(df: DataFrame, shards: int, doc: str = "doc_id", text: str = "text", slots: int = SLOTS, slot_map: SlotMap | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, virtual_slot, map_version) of every row.

    slot is the row's place in its shard, without gaps from 0: shards hold their
    virtual slots in order, and these hold their rows by id.  Rows are numbered
    within virtual slots, each a thousandth of a shard or so, never within a shard.
    """
    spark = df.sparkSession
    sizes, rows = slot_totals(df, doc, text, slots)
    slot_map = slot_map or SlotMap.balanced(sizes, shards)
    begin, seen = [], [0] * slot_map.shards
    for slot, shard in enumerate(slot_map.shard_of):
        begin.append(seen[shard])
        seen[shard] += rows[slot]
    # `slots` rows of three numbers, whatever the corpus
    places = F.broadcast(spark.createDataFrame(list(zip(range(slots), slot_map.shard_of, begin, strict=True)), "virtual_slot int, shard int, begin long"))
    out = df.select(df[doc].alias("doc_id"), size_of(df[text]).alias("size"), F.crc32(F.coalesce(df[text], F.lit("")).cast("binary")).alias("text_crc32"), slot_of(df[doc], df[text], slots).alias("virtual_slot"))
    at = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")) - 1
    out = out.withColumn("at", at).join(places, "virtual_slot")
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("begin") + F.col("at")).alias("slot"), "virtual_slot", F.lit(slot_map.version).alias("map_version"))
