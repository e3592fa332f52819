"""Predicates as columns: scopes, criteria, column filters, and the requests that build them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions.scalars import all_of


def in_folders(path: Column, folders: list[str] | None) -> Column:
    """Below one of the folders, ASCII case aside. None is everything, an empty list nothing."""
    if folders is None:
        return F.lit(True)
    out = F.lit(False)
    for folder in folders:
        out = out | F.startswith(F.lower(path), F.lit(folder.rstrip("/").lower() + "/"))
    return out


def in_ids(column: Column, ids: list[int] | None) -> Column:
    """None is everything, an empty list nothing."""
    if ids is None:
        return F.lit(True)
    return column.isin(ids) if ids else F.lit(False)


def inside(path: Column, root: str | None) -> Column:
    """The root itself or strictly under it, case counting; without a root, inside."""
    if not root:
        return F.lit(True)
    root = root.rstrip("/")
    return (path == root) | F.startswith(path, F.lit(root + "/"))


def outermost(paths: DataFrame, column: str = "path") -> DataFrame:
    """Paths that aren't inside another.  Each path looks its own ancestors up, so the join is by equality."""
    p = paths.select(F.regexp_replace(column, "/+$", "").alias("p")).distinct()
    parts = F.split("p", "/")
    above = p.select("p", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("q")).where("p <> q")
    return p.join(above.join(p.select(F.col("p").alias("q")), "q").select("p").distinct(), "p", "left_anti").select(F.col("p").alias(column))


def counts_under(folders: DataFrame, rows: DataFrame, folder: str = "path", path: str = "filepath") -> DataFrame:
    """How many rows lie under each folder, 0 included; each row looks up its ancestors, no pairs by prefix test."""
    parts = F.split(path, "/")
    above = rows.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("_a")).groupBy("_a").agg(F.count("*").alias("n"))
    return folders.join(above, F.regexp_replace(folders[folder], "/+$", "") == F.col("_a"), "left").select(folders[folder], F.coalesce("n", F.lit(0)).alias("n"))


@dataclass(frozen=True)
class Criteria:
    """Filters of list rows; a missing value fails each bound that is set: the condition is NULL then, which a filter drops, and bounds stay plain comparisons that reach the scan."""

    types: frozenset[str] | None = None
    class_minima: dict[str, float] = field(default_factory=dict)
    ranges: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    axis_ranges: dict[str, tuple[float, float]] = field(default_factory=dict)

    def column(self, *, type_col: str = "structural_type", scores_col: str = "class_scores") -> Column:
        out = []
        if self.types is not None:
            out.append(F.coalesce(F.col(type_col), F.lit("")).isin(*self.types) if self.types else F.lit(False))
        out += [F.element_at(F.col(scores_col), F.lit(k)) >= v for k, v in self.class_minima.items()]
        for name, (low, high) in self.ranges.items():
            out += [F.col(name) >= low] if low is not None else []
            out += [F.col(name) <= high] if high is not None else []
        out += [F.col(f"d_{a}").between(low, high) for a, (low, high) in self.axis_ranges.items()]
        return all_of(out)


def criteria_of(*, types: set[str] | None = None, all_types: set[str] = frozenset(), minima_percent: dict[str, float] | None = None, ranges: dict[str, tuple[float, float]] | None = None, axes_percent: dict[str, tuple[float, float]] | None = None) -> Criteria:
    """A request's controls: all types ticked is no filter, 0 is an open bound, per cents become shares, (0, 100) of an axis is no filter."""
    return Criteria(
        None if types is None or types == all_types else frozenset(types),
        {k: v / 100 for k, v in (minima_percent or {}).items() if v > 0},
        {k: (low or None, high or None) for k, (low, high) in (ranges or {}).items() if low or high},
        {k: (low / 100, high / 100) for k, (low, high) in (axes_percent or {}).items() if (low, high) != (0, 100)},
    )


@dataclass(frozen=True)
class ColumnFilter:
    """A filter of one column: part of its shown text, shown values, or a range of its raw value, where less than 0 is no value."""

    text: str = ""
    values: frozenset[str] | None = None
    low: float | None = None
    high: float | None = None

    def column(self, shown: Column, raw: Column) -> Column:
        shown = F.coalesce(shown.cast("string"), F.lit(""))
        out = []
        if self.text:
            out.append(F.contains(F.lower(shown), F.lit(self.text.lower())))
        if self.values is not None:
            out.append(shown.isin(*self.values) if self.values else F.lit(False))
        if self.low is not None or self.high is not None:
            out.append(raw >= 0)
            out += [raw >= self.low] if self.low is not None else []
            out += [raw <= self.high] if self.high is not None else []
        return all_of(out)


def any_contains(columns: list[Column], text: str) -> Column:
    """One of the columns' texts holds `text`, case aside; no text holds always."""
    if not text:
        return F.lit(True)
    out = F.lit(False)
    for c in columns:
        out = out | F.contains(F.lower(F.coalesce(c.cast("string"), F.lit(""))), F.lit(text.lower()))
    return out


def filtered(parents: DataFrame, children: DataFrame, condition: Column, key: str = "id", parent: str = "parent") -> tuple[DataFrame, DataFrame]:
    """Parents that pass, and the children that follow them."""
    kept = parents.where(condition)
    return kept, children.join(kept.select(F.col(key).alias(parent)), parent, "left_semi")


def distinct_values(df: DataFrame, column: Column) -> DataFrame:
    """Shown texts of a column, '' for none."""
    return df.select(F.coalesce(column.cast("string"), F.lit("")).alias("value")).distinct()
