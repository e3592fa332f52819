"""Small files and folders in any store that Spark reads."""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside its place and rename it over; readers see the old one or the new one."""
    fs, place = _at(spark, path)
    _, beside = _at(spark, f"{path}.new")
    fs.mkdirs(place.getParent())
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    context = spark.sparkContext._jvm.org.apache.hadoop.fs
    context.FileContext.getFileContext(place.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(beside, place, _overwrite(spark))


def _overwrite(spark: SparkSession):
    option = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
    several = spark.sparkContext._gateway.new_array(option, 1)
    several[0] = option.OVERWRITE
    return several


def read_text(spark: SparkSession, path: str) -> str | None:
    """What write_text wrote; None if there is no such file."""
    fs, place = _at(spark, path)
    if not fs.exists(place):
        return None
    source = fs.open(place)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    fs, place = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, place = _at(spark, path)
    fs.delete(place, True)


def version(spark: SparkSession, *paths: str) -> str:
    """A digest of the names, sizes and times of all files under the paths: it changes when any of them does."""
    found = []
    for path in paths:
        fs, place = _at(spark, path)
        under = fs.listFiles(place, True)
        while under.hasNext():
            s = under.next()
            found.append(f"{s.getPath()}:{s.getLen()}:{s.getModificationTime()}")
    return hashlib.blake2b("\n".join(sorted(found)).encode(), digest_size=16).hexdigest()
