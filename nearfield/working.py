"""The shared working folder, and tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from nearfield import files


def folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; where that is unset a temporary folder, in local mode only (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.nearfield.working", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="nearfield-")
        spark.conf.set("spark.nearfield.working", path)
    return path.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in it that nothing uses yet."""
    return f"{folder(spark)}/nearfield/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """`df`, written and read back: what reads it doesn't compute it again, and a lost executor loses none of it."""
    path = fresh(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.nearfield_path = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete what stored() wrote for frames that nothing reads any more."""
    for df in frames:
        files.delete(df.sparkSession, df.nearfield_path)
