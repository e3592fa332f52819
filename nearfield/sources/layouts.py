"""2-D layouts that are kept with what placed them, so that further items can be placed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.io import upsert
from nearfield.operators.vectors import placed, principal_plane

#: Items that a plane takes at least.
LEAST = 3


def fitted(items: DataFrame, folder: str, layout: int, weights: dict[str, float], id_: str = "id", vector: str = "vector") -> DataFrame:
    """(id, x, y) of items in a plane fitted to them, which is saved under its number with the weights that made their vectors."""
    if not any(w > 0 for w in weights.values()):
        raise ValueError("all weights are zero")
    if items.limit(LEAST).count() < LEAST:
        raise ValueError(f"a layout takes {LEAST} items at least")
    out, mean, axes = principal_plane(items, id_, vector)
    spark = items.sparkSession
    row = [(layout, {k: float(w) for k, w in weights.items()}, mean.tolist(), axes.tolist())]
    spark.createDataFrame(row, "layout long, weights map<string,double>, mean array<double>, axes array<array<double>>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/layout={layout}")
    return out


def loaded(spark: SparkSession, folder: str, layout: int) -> tuple[dict[str, float], np.ndarray, np.ndarray]:
    row = spark.read.parquet(f"{folder}/layout={layout}").first()
    return row["weights"], np.array(row["mean"]), np.array(row["axes"])


def place(positions: DataFrame, items: DataFrame, segments: DataFrame, folder: str, layout: int, kind: str, item: int, id_: str = "id", vector: str = "vector") -> DataFrame:
    """positions (id, x, y) with one item put where the saved plane has it now; a segment stands for its parent. segments: id, parent."""
    spark = items.sparkSession
    if kind == "segment":
        row = segments.where(F.col("id") == item).select("parent").first()
        if row is None:
            raise ValueError(f"no segment {item}")
        item = row["parent"]
    own = items.where(F.col(id_) == item)
    if not own.limit(1).count():
        raise ValueError(f"item {item} has no vector")
    _, mean, axes = loaded(spark, folder, layout)
    return upsert(positions, placed(own, id_, vector, mean, axes), [id_])
