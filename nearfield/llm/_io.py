"""Tables, the shared working folder, and cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset a temporary one, in local mode only (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.nearfield.shared", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="nearfield-")
        spark.conf.set("spark.nearfield.shared", folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back: its lineage is cut, and a lost executor loses none of it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/nearfield/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.nearfield_path = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete what stored() wrote for frames that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.nearfield_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
