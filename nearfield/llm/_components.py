"""Connected components of an edge table, without collecting it anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm._io import dropped, stored

#: Edges that one task may hold: about 200 MB while it contracts them.
ONE_TASK = 1 << 21


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges' components as stars: every node but the least of its component, and that least node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    low = np.arange(len(nodes))
    while True:
        x, y = low[u], low[v]
        least = np.minimum(x, y)
        if (x == y).all():
            break
        np.minimum.at(low, x, least)
        np.minimum.at(low, y, least)
        while not np.array_equal(low, low[low]):
            low = low[low]
    keep = low != np.arange(len(nodes))
    return nodes[keep], nodes[low[keep]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of a partition's edges; what is held is contracted whenever it has doubled."""
    u, v, limit = np.zeros(0, np.int64), np.zeros(0, np.int64), 1 << 18
    for batch in batches:
        u = np.concatenate([u, batch.column(0).to_numpy(zero_copy_only=False)])
        v = np.concatenate([v, batch.column(1).to_numpy(zero_copy_only=False)])
        if len(u) > limit:
            u, v = contracted(u, v)
            limit = max(limit, 2 * len(u))
    if len(u):
        u, v = contracted(u, v)
    for at in range(0, len(u), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(u[at : at + (1 << 16)]), pa.array(v[at : at + (1 << 16)])], ["u", "v"])


def _large_star(e: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the least of it and its neighbours."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the least of these."""
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return low.select("u", F.col("m").alias("v")).unionByName(moved).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges, two long columns; a component is named by its least node.

    Partitions first contract their own edges to stars.  If a count shows that
    what is left fits one task, that task contracts it; else large-star and
    small-star rounds follow, whose number grows with the logarithm of the longest
    path, until it fits or is done.  A hub's edges are never gathered: minima are
    pre-aggregated and the join that follows them may be split.  Self-loops keep
    their node; repeated edges change nothing; no edges give no rows.  The result is
    a stored table, which the caller drops.
    """
    a, b = edges.columns
    edges = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null")
    loops = edges.where("u = v").select("u")
    e = stored(edges.where("u <> v").mapInArrow(_local, "u long, v long"))
    while True:
        if e.count() <= ONE_TASK:
            before, e = e, stored(e.coalesce(1).mapInArrow(_local, "u long, v long"))
            dropped(before)
            break
        tail = e.select(F.col("v").alias("u"))
        unfinished = e.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u").unionByName(e.select("u").join(tail, "u", "left_semi")).limit(1)
        if not unfinished.count():
            break
        before, e = e, stored(_small_star(_large_star(e.repartition("u").mapInArrow(_local, "u long, v long"))))
        dropped(before)
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    alone = e.select(F.col("v").alias("node"), F.col("v").alias("component")).unionByName(loops.select(F.col("u").alias("node"), F.col("u").alias("component")).join(stars, "node", "left_anti"))
    out = stored(stars.unionByName(alone.distinct()))
    dropped(e)
    return out
