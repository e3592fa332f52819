"""Sessions, tables of a folder, and keyed writes on plain Parquet."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield import files


def session(name: str = "nearfield", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that results depend on: UTC, AQE with skew joins, Arrow."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true").config("spark.executorEnv.OMP_NUM_THREADS", "1")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


class Tables:
    """Parquet tables of a folder as attributes: ``Tables(spark, dir).orders``."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`stored` with rows of `new` in place of those of the same keys, and the rest of `new` added."""
    return stored.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_ignore(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`stored` and those rows of `new` whose keys it hasn't; of equal new keys one row stays, the least."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*new.columns))
    fresh = new.join(stored.select(*keys).distinct(), keys, "left_anti").withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    return stored.unionByName(fresh.select(*stored.columns))


def latest(rows: DataFrame, keys: list[str], order: str, tie: str) -> DataFrame:
    """The row of greatest (order, tie) of each key."""
    others = [c for c in rows.columns if c not in keys]
    best = F.max(F.struct(order, tie, *(c for c in others if c not in (order, tie)))).alias("_m")
    return rows.groupBy(*keys).agg(best).select(*keys, *(F.col(f"_m.{c}").alias(c) for c in others))


def overwrite_partition(df: DataFrame, path: str, column: str) -> None:
    """Write `df` by `column`, replacing only the partitions that it has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def publish(df: DataFrame, path: str) -> None:
    """Replace a published table, which `df` may itself read: a new version is written, and then one pointer moved.

    Readers have the old version or the new one at any time, also if the writer is
    lost between the two steps.  Older versions stay for those who read them, until
    retired() deletes them.
    """
    spark, version = df.sparkSession, uuid.uuid4().hex
    df.write.parquet(f"{path}/versions/{version}")
    files.write_text(spark, f"{path}/current", version)


def published(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a published table."""
    version = files.read_text(spark, f"{path}/current")
    if version is None:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/versions/{version}")


def retired(spark: SparkSession, path: str) -> list[str]:
    """Delete all versions of a published table but the current one; their names."""
    current = files.read_text(spark, f"{path}/current")
    old = [v for v in files.names(spark, f"{path}/versions") if v != current]
    for v in old:
        files.delete(spark, f"{path}/versions/{v}")
    return old
