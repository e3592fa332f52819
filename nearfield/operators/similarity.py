"""Ranking a parent/child population against an anchor, and vector search.

Statistics of the whole population (medians, spreads, 95th percentiles) are a
handful of numbers; each kind is computed in two passes for all columns and put
into later plans as literals, so that ranking itself is one scan without a
shuffle before the fold.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions.arrays import dot
from nearfield.functions.scalars import clip, known
from nearfield.operators.quantiles import quantiles
from nearfield.working import stored

MAD_FACTOR, Z_LIMIT, SPREAD_FLOOR, SCALE_SHARE = 1.4826, 4.0, 1e-9, 0.95


def population(parents: DataFrame, children: DataFrame, features: list[str]) -> DataFrame:
    """One table of items: kind, id, parent, start, end, window and features. parents: id; children: id, parent, start, end, window."""
    none = lambda kind: F.lit(None).cast(kind)
    own = {c for c in parents.columns}
    p = parents.select(F.lit("sample").alias("kind"), "id", F.col("id").alias("parent"), none("long").alias("start"), none("long").alias("end"), F.lit(False).alias("window"), *(F.col(f) if f in own else none("double").alias(f) for f in features))
    c = children.select(F.lit("segment").alias("kind"), "id", "parent", F.col("start").cast("long"), F.col("end").cast("long"), "window", *features)
    return p.unionByName(c)


@dataclass(frozen=True)
class Axes:
    """Named axes of feature columns, with the population's centres, spreads and scales."""

    columns: dict[str, list[str]]
    centre: dict[str, float | None] = field(default_factory=dict)
    spread: dict[str, float] = field(default_factory=dict)

    @property
    def features(self) -> list[str]:
        return [c for cols in self.columns.values() for c in cols]

    def fitted(self, items: DataFrame) -> Axes:
        """Medians, then median absolute deviations times 1.4826 (1 where that is nothing), over all items."""
        value = {c: known(F.col(c).cast("double")) for c in self.features}
        first = quantiles(items, value, 0.5)
        second = quantiles(items, {c: F.abs(v - F.lit(first[c]).cast("double")) for c, v in value.items()}, 0.5)
        spread = {c: second[c] * MAD_FACTOR if second[c] is not None and second[c] * MAD_FACTOR > SPREAD_FLOOR else 1.0 for c in self.features}
        return Axes(self.columns, first, spread)

    def z(self, column: str) -> Column:
        """A feature in robust units, clipped; missing stays missing."""
        if self.centre.get(column) is None:
            return F.lit(None).cast("double")
        return clip((known(F.col(column).cast("double")) - self.centre[column]) / self.spread[column], -Z_LIMIT, Z_LIMIT)

    def standardised(self, items: DataFrame) -> DataFrame:
        return items.withColumns({c: self.z(c) for c in self.features})

    def distances(self, z: DataFrame, anchor: dict[str, float | None]) -> DataFrame:
        """d_<axis>: root mean square difference over the columns that both have; missing if none."""
        out = {}
        for axis, cols in self.columns.items():
            squares = [F.pow(F.col(c) - anchor[c], F.lit(2)) for c in cols if anchor[c] is not None]
            count = sum((s.isNotNull().cast("int") for s in squares), F.lit(0))
            total = sum((F.coalesce(s, F.lit(0.0)) for s in squares), F.lit(0.0))
            out[f"d_{axis}"] = F.when(count > 0, F.sqrt(total / count))
        return z.withColumns(out)


def vector_distance(vector: Column, anchor: Column) -> Column:
    """1 - cosine of two unit vectors, which are taken as they are; missing if either is, or if widths differ."""
    return 1 - dot(vector, anchor)


def scaled(distances: DataFrame, axes: list[str], within: dict[str, tuple[float, float, int]] | None = None) -> DataFrame:
    """Each axis over its 95th percentile over all items, within 0..1; as it is where that is 0.  within: as in quantiles."""
    p = quantiles(distances, {a: F.col(f"d_{a}") for a in axes}, SCALE_SHARE, within=within)
    return distances.withColumns({f"d_{a}": clip(F.col(f"d_{a}") / p[a], 0.0, 1.0) if p[a] is not None and p[a] > 0 else F.col(f"d_{a}") for a in axes})


def blend(weights: dict[str, float]) -> Column:
    """The weighted mean of the axes that are there; negative weights count as 0; missing without any weight."""
    total, over = F.lit(0.0), F.lit(0.0)
    for axis, w in weights.items():
        w, d = max(0.0, w), F.col(f"d_{axis}")
        total = total + F.coalesce(d * w, F.lit(0.0))
        over = over + F.when(d.isNotNull(), F.lit(w)).otherwise(F.lit(0.0))
    return F.when(over > 0, total / over)


def fold(scores: DataFrame) -> DataFrame:
    """(sample_id, score, hit_id, hit_start, hit_end, hit_window): the parent's own score unless a child's is greater; of equal children the least id.

    scores: kind, id, parent, start, end, window, score. One pass, aggregated before the shuffle.
    """
    own = F.max(F.when(F.col("kind") == "sample", F.col("score"))).alias("own")
    child = F.when((F.col("kind") == "segment") & F.col("score").isNotNull(), F.struct("score", (-F.col("id")).alias("rank"), "id", "start", "end", "window"))
    both = scores.groupBy(F.col("parent").alias("sample_id")).agg(own, F.max(child).alias("best"))
    wins = F.col("best").isNotNull() & (F.col("own").isNull() | (F.col("best.score") > F.col("own")))
    out = both.select("sample_id", F.when(wins, F.col("best.score")).otherwise(F.col("own")).alias("score"), *(F.when(wins, F.col(f"best.{c}")).alias(f"hit_{c}") for c in ("id", "start", "end", "window")))
    return out.where("score is not null")


@dataclass
class Ranker:
    """A population with its statistics; distances from an anchor are computed once and re-blended for any weights."""

    items: DataFrame
    axes: Axes
    #: Where a kept index puts the scales of distances from an anchor (see quantiles).
    near: Callable[[dict[str, float | None]], dict[str, tuple[float, float, int]]] | None = None

    def __post_init__(self) -> None:
        if not self.axes.centre:
            # every pass over statistics and every ranking reads it
            self.items = stored(self.items)
            self.axes = self.axes.fitted(self.items)
        self.z = self.axes.standardised(self.items)
        self._anchor: tuple[tuple[str, int], DataFrame] | None = None

    def distances(self, kind: str, item: int) -> DataFrame:
        """All items with their distances from an anchor; those of the last anchor are kept, so that other weights only blend anew."""
        if self._anchor is None or self._anchor[0] != (kind, item):
            self._anchor = (kind, item), self._distances(kind, item)
        return self._anchor[1]

    def _distances(self, kind: str, item: int) -> DataFrame:
        row = self.z.where((F.col("kind") == kind) & (F.col("id") == item)).select(*self.axes.features).first()
        if row is None:
            raise ValueError(f"no {kind} {item}")
        anchor = row.asDict()
        return scaled(self.axes.distances(self.z, anchor), list(self.axes.columns), self.near(anchor) if self.near else None)

    def ranked(self, kind: str, item: int, weights: dict[str, float], scope: DataFrame | None = None) -> DataFrame:
        """Parents by similarity, folded; scope: a table of sample ids in `parent`, which restricts the result, not the scales."""
        scores = self.distances(kind, item).withColumn("score", 1 - blend(weights))
        if scope is not None:
            scores = scores.join(scope.select("parent").distinct(), "parent", "left_semi")
        return fold(scores)


def searched(items: DataFrame, query: list[float], width: int) -> DataFrame:
    """Items with `score`, the cosine with a query that is normalised first; vectors of another width are absent."""
    length = sum(x * x for x in query) ** 0.5 or 1.0
    q = F.array(*(F.lit(x / length) for x in query))
    return items.where(F.size("vector") == width).withColumn("score", dot(F.col("vector"), q))


def weighted_squares(axes: Axes, weights: dict[str, float]) -> Column:
    """The squared length of an item's row of the weighted feature matrix: columns times sqrt(weight / width), missing as 0."""
    if not any(w > 0 for w in weights.values()):
        raise ValueError("all weights are zero")
    total = F.lit(0.0)
    for axis, cols in axes.columns.items():
        for c in cols:
            total = total + F.pow(F.coalesce(F.col(c), F.lit(0.0)), F.lit(2)) * (max(0.0, weights.get(axis, 0.0)) / len(cols))
    return total


def weighted_matrix(axes: Axes, weights: dict[str, float]) -> Column:
    """That row, as an array."""
    if not any(w > 0 for w in weights.values()):
        raise ValueError("all weights are zero")
    return F.array(*(F.coalesce(F.col(c), F.lit(0.0)) * (max(0.0, weights.get(a, 0.0)) / len(cols)) ** 0.5 for a, cols in axes.columns.items() for c in cols))
