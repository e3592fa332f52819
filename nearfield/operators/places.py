"""Places in a whole ordered list, without one task that sorts it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.working import dropped, stored

#: monotonically_increasing_id keeps a partition's rows in its lower bits.
_BITS = 33


def in_order(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """`df` with the place of each row, from 1, in this order; rows that are equal in it come in any.

    Rows are dealt into ranges of the order, whose bounds Spark samples, and sorted
    within them; a range's places begin after the rows of those before it, whose
    counts are as many numbers as there are ranges.  Equal rows may part, so a value
    that much of the list has isn't one task.  The result is a stored table.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # ties are dealt by where they were read
    rows = df.withColumn("_tie", F.monotonically_increasing_id())
    ranged = rows.repartitionByRange(parts, *order, "_tie").sortWithinPartitions(*order, "_tie")
    numbered = stored(ranged.withColumn("_at", F.monotonically_increasing_id()).drop("_tie"))
    part = F.shiftright("_at", _BITS)
    counts = numbered.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).orderBy("_part").collect()
    before, total = [], 0
    for r in counts:
        before.append((r["_part"], total))
        total += r.n
    offsets = F.broadcast(spark.createDataFrame(before, "_part long, _before long"))
    placed = numbered.withColumn("_part", part).join(offsets, "_part")
    out = stored(placed.select(*df.columns, (F.col("_at") - F.shiftleft(F.col("_part"), _BITS) + F.col("_before") + 1).alias(name)))
    dropped(numbered)
    return out
