"""Runs: worklist, work, split into done and failed, keyed write, report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield import working
from nearfield.io import upsert


@dataclass
class Report:
    """What a run did: counts by outcome, and five errors at most."""

    counts: dict[str, int] = field(default_factory=dict)
    errors: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)

    def text(self) -> str:
        parts = [f"{n} {k}" for k, n in sorted(self.counts.items())] or ["nothing to do"]
        return "; ".join([", ".join(parts), *self.errors, *self.notes])


def run_stage(work: DataFrame, do: Callable[[DataFrame], DataFrame], stored: DataFrame, key: str, *, limit: int | None = None, ids: list[int] | None = None) -> tuple[DataFrame, Report]:
    """Rows of `work` done and put into `stored` by key; rows with an error are counted and left out, so that one bad row ends no run.

    do: gives key, the stored columns and `error`.  ids: None is all, an empty list nothing.
    """
    if ids is not None:
        work = work.where(F.col(key).isin(ids) if ids else F.lit(False))
    if limit is not None:
        work = work.orderBy(key).limit(limit)
    # results are read several times, and the work is the dear part
    done = working.stored(do(work))
    report = Report({r["outcome"]: r["count"] for r in done.groupBy(F.when(F.col("error").isNull(), "done").otherwise("failed").alias("outcome")).count().collect()})
    report.errors = [r["error"] for r in done.where("error is not null").orderBy(key).limit(5).select("error").collect()]
    return upsert(stored, done.where("error is null").select(*stored.columns), [key]), report


def run_plan(steps: list[tuple[str, Callable[[], Report]]], *, scope: list[str] | None = None) -> Report:
    """Steps in order; an empty scope is refused; a step that fails drops the rest, and says so in the notes."""
    if scope is not None and not scope:
        raise ValueError("the scope is empty")
    total = Report()
    for name, step in steps:
        try:
            report = step()
        except Exception as e:
            total.notes.append(f"{name} failed: {e}")
            break
        for k, n in report.counts.items():
            total.counts[k] = total.counts.get(k, 0) + n
        total.errors = (total.errors + report.errors)[:5]
        total.notes += report.notes
    return total
