"""Vectors and fixed-width lists as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles; NULL for unequal widths."""
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(product, F.lit(0.0), lambda s, x: s + x))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    return F.transform(a, lambda x: x.cast("double") / F.when(norm(a) > 0, norm(a)).otherwise(F.lit(1.0)))


def of_width(a: Column, width: int) -> Column:
    """The list if it has this width, else missing."""
    return F.when(F.size(a) == width, a)


def from_json_list(text: Column, width: int) -> Column:
    """A JSON list of numbers, missing if it doesn't parse or has another width."""
    return of_width(F.from_json(text, "array<double>"), width)


def to_json_list(a: Column, places: int = 6) -> Column:
    return F.to_json(F.transform(a, lambda x: F.round(x, places)))


def cropped(a: Column, most: Column | int) -> Column:
    most = most if isinstance(most, Column) else F.lit(most)
    return F.slice(a, F.lit(1), F.greatest(F.lit(0), most).cast("int"))


def softmax(scores: Column) -> Column:
    """exp(s - max) over its sum."""
    top = F.array_max(scores)
    e = F.transform(scores, lambda s: F.exp(s - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def faded(signal: Column, rate: int, fade_in_ms: int = 2, fade_out_ms: int = 20) -> Column:
    """Linear ramps at both ends, each over half the signal at most."""
    n = F.size(signal)
    a = F.least(F.lit(fade_in_ms * rate // 1000), F.floor(n / 2))
    b = F.least(F.lit(fade_out_ms * rate // 1000), F.floor(n / 2))
    up = lambda i: F.when(i >= a, 1.0).when(a > 1, i / (a - 1)).otherwise(0.0)
    down = lambda i: F.when(i < n - b, 1.0).when(b > 1, 1.0 - (i - (n - b)) / (b - 1)).otherwise(1.0)
    return F.transform(signal, lambda x, i: x * up(i) * down(i))
