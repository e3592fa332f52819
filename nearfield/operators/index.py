"""A kept, versioned index of a population for ranking.

The population is cut into parts (a table each, or a file each), every part with a
version of its source.  What is kept in the index's folder:

* the items, in one table by part, bucketed and sorted by parent, so that a fold to
  parents needs no exchange; buckets are as many as the items ask for, so that a task
  sorts MOST_ROWS of them or so at most at any size, in memory;
* of each part a KLL sketch of every feature, and the SAMPLE items of least hash;
* one manifest by state: the parts it is made of, and the statistics of all of them.

A refresh writes only parts whose source has changed, unless over twice the
buckets are called for: then all parts are written anew, in as many.  The parts' sketches are
merged, which brackets each feature's median and, as the share of values within d
of the median follows from the same sketch, its median deviation; one pass over the
items for each of the two then makes them exact.  A distance's 95th percentile depends on
the anchor: the sample brackets it, and one pass makes it exact.  If a bracket is
wrong, counts show it, and a sketch of all values follows.

States never change once written: a refresh writes new parts and a new manifest, and
then moves one pointer.  A reader of an older state goes on with that one until it
is vacuumed; whoever asks for a ranking of sources that have changed since gets
StaleIndex instead of an old answer.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield import files
from nearfield.functions.scalars import known
from nearfield.operators.quantiles import quantiles
from nearfield.operators.similarity import MAD_FACTOR, SCALE_SHARE, SPREAD_FLOOR, Axes, Ranker

#: Size of a KLL sketch, and the ranks read off the merged one.
SKETCH, GRID = 4096, 1000
#: Items that a bucket is made for: those that a task sorts at a time; it gets up to MOST_ROWS where that keeps buckets
#: at UNSORTED, as to more of them Spark's tasks sort what they send, and spill where they read much.
BUCKET_ROWS, MOST_ROWS, UNSORTED = 500_000, 1_500_000, 200
#: Parts written at a time.
WRITERS = 4
#: Items of least hash that stand for the population where a bracket is looked for.
SAMPLE = 20_000
#: Shares of the rows by which brackets are wider than what sketch or sample says.
SLACK, SAMPLE_SLACK = 0.002, 0.008

_KEPT = ["kind", "id", "parent", "start", "end", "window"]


class StaleIndex(ValueError):
    """The sources have changed since the index was made."""


@dataclass(frozen=True)
class Source:
    """A part of the population: the version of what it is made from, and its items, which are asked for only if they aren't kept.

    dealt: the same items for a number of tasks, dealt by hash of their parent over so
    many already, for a source that must bring children of a parent together itself;
    they aren't moved again.
    """

    version: str
    items: Callable[[], DataFrame]
    dealt: Callable[[int], DataFrame] | None = None


@dataclass(frozen=True)
class State:
    """A manifest: parts by name with version and folder name, buckets of each, rows, and statistics by feature."""

    parts: dict[str, tuple[str, str]]
    buckets: int
    rows: int
    centre: dict[str, float | None]
    spread: dict[str, float]


def _bracket(grid: list[float] | None, share: float, slack: float) -> tuple[float, float] | None:
    """Values of an even grid of quantiles round a share."""
    if not grid:
        return None
    n = len(grid) - 1
    low, high = int(np.floor((share - slack) * n)), int(np.ceil((share + slack) * n))
    return grid[max(0, low)], grid[min(n, high)]


def _buckets_for(rows: int, least: int) -> int:
    """Buckets for so many items."""
    return max(min(least, UNSORTED), min(-(-rows // BUCKET_ROWS), max(UNSORTED, -(-rows // MOST_ROWS))))


def _deviation_bracket(grid: list[float], centre: float, slack: float) -> tuple[float, float]:
    """Bounds of the median of |x - centre|, given a grid of quantiles of x."""
    x = np.asarray(grid)
    d = np.unique(np.abs(x - centre))
    inside = (np.searchsorted(x, centre + d, side="right") - np.searchsorted(x, centre - d, side="left")) / len(x)
    low, high = np.searchsorted(inside, 0.5 - slack), np.searchsorted(inside, 0.5 + slack)
    return float(d[max(0, low - 1)]), float(d[min(len(d) - 1, high + 1)])


class Index:
    """The index in a folder that driver and executors share.  buckets: a fixed number of them; else they follow the items."""

    def __init__(self, spark: SparkSession, path: str, axes: Axes, *, buckets: int | None = None) -> None:
        self.spark, self.path, self.axes, self.buckets = spark, path.rstrip("/"), Axes(axes.columns), buckets
        held = files.read_text(spark, f"{self.path}/layout.json")
        layout = {"buckets": self.buckets, "features": self.axes.features}
        if held is None:
            files.write_text(spark, f"{self.path}/layout.json", json.dumps(layout))
        elif json.loads(held)["features"] != layout["features"]:
            raise ValueError("the index has other features")
        else:
            self.buckets = json.loads(held)["buckets"]

    # states

    @property
    def state(self) -> State | None:
        """The state that the pointer names."""
        name = files.read_text(self.spark, f"{self.path}/current")
        if name is None:
            return None
        held = json.loads(files.read_text(self.spark, f"{self.path}/states/{name}.json"))
        return State({p: tuple(v) for p, v in held["parts"].items()}, held.get("buckets") or self.buckets, held["rows"], held["centre"], held["spread"])

    def refresh(self, sources: dict[str, Source]) -> list[str]:
        """Bring the index up to the sources; the parts that were written."""
        before = self.state
        held = before.parts if before else {}
        parts = {p: held[p] if p in held and held[p][0] == s.version else (s.version, uuid.uuid4().hex) for p, s in sources.items()}
        if before is not None and parts == before.parts:
            return []
        changed = {p: sources[p].items() for p, v in parts.items() if held.get(p) != v}
        buckets = self._fitting(before, list(changed.values()), [own for p, (_, own) in parts.items() if p not in changed])
        if before is not None and buckets != before.buckets:
            parts = {p: (s.version, uuid.uuid4().hex) for p, s in sources.items()}
            changed |= {p: s.items() for p, s in sources.items() if p not in changed}
        rows = {parts[p][1]: (df, sources[p].dealt) for p, df in changed.items()}
        for df, _ in list(rows.values())[:1]:
            self._declare(buckets, self._selected(df))
        with ThreadPoolExecutor(WRITERS) as pool:
            list(pool.map(lambda x: self._write(x[0], buckets, *x[1]), rows.items()))
        folders = [own for _, own in parts.values()]
        rows, centre, spread = self._statistics(buckets, folders)
        name = uuid.uuid4().hex
        files.write_text(self.spark, f"{self.path}/states/{name}.json", json.dumps({"parts": parts, "buckets": buckets, "rows": rows, "centre": centre, "spread": spread}))
        files.write_text(self.spark, f"{self.path}/current", name)
        return sorted(changed)

    def _fitting(self, before: State | None, new: list[DataFrame], kept: list[str]) -> int:
        """Buckets for these items and those of the kept folders: as before, while they hold them."""
        if self.buckets:
            return self.buckets
        rows = sum(df.count() for df in new)
        if kept:
            rows += self._of("sketches", kept).agg(F.sum("rows")).first()[0]
        wanted = _buckets_for(rows, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        return before.buckets if before is not None and wanted <= 2 * before.buckets else wanted

    def vacuum(self) -> None:
        """Delete all but the current state; older readers fail from then on."""
        name, state = files.read_text(self.spark, f"{self.path}/current"), self.state
        live = {own for _, own in state.parts.values()} if state else set()
        for kind in ("items/part=", "sketches/part=", "sample/part="):
            top, prefix = kind.split("/")
            for own in files.names(self.spark, f"{self.path}/{top}"):
                if own.startswith(prefix) and own.removeprefix(prefix) not in live:
                    files.delete(self.spark, f"{self.path}/{top}/{own}")
        for own in files.names(self.spark, f"{self.path}/states"):
            if own != f"{name}.json":
                files.delete(self.spark, f"{self.path}/states/{own}")

    # what is kept of a part

    def _selected(self, items: DataFrame) -> DataFrame:
        return items.select(*_KEPT, *(known(F.col(f).cast("double")).alias(f) for f in self.axes.features))

    def _write(self, own: str, buckets: int, items: DataFrame, dealt: Callable[[int], DataFrame] | None) -> None:
        rows = self._selected(dealt(buckets) if dealt else items)
        columns = ", ".join(f"`{c}`" for c in rows.columns)
        # each part is written by a table of its own, in the part's folder: writers of one folder would clear each other's unfinished files
        table = f"nearfield_part_{own}"
        self.spark.sql(f"CREATE TABLE {table} ({self._typed(rows)}) USING parquet CLUSTERED BY (parent) SORTED BY (parent) INTO {buckets} BUCKETS LOCATION '{self.path}/items/part={own}'")
        # rows of a parent are written by one task, so a bucket is one file
        hint = "" if dealt else f"/*+ REPARTITION({buckets}, parent) */ "
        self.spark.sql(f"INSERT OVERWRITE {table} SELECT {columns} FROM (SELECT {hint}* FROM {{rows}})", rows=rows)
        # the files stay
        self.spark.sql(f"DROP TABLE {table}")
        self.spark.sql(f"ALTER TABLE {self._table(buckets)} ADD IF NOT EXISTS PARTITION (part = '{own}')")
        kept = self._rows(buckets, [own])
        sketches = kept.agg(F.count("*").alias("rows"), *(F.kll_sketch_agg_double(f, SKETCH).alias(f) for f in self.axes.features))
        sketches.write.mode("overwrite").parquet(f"{self.path}/sketches/part={own}")
        count = self._of("sketches", [own]).first()["rows"]
        sample = f"{self.path}/sample/part={own}"
        # a threshold leaves some three times the rows: else each task would send SAMPLE of them
        self._least(kept, 3 * SAMPLE / max(1, count)).write.mode("overwrite").parquet(sample)
        if self.spark.read.parquet(sample).count() < min(SAMPLE, count):
            # equal ids have equal hashes
            self._least(kept).write.mode("overwrite").parquet(sample)

    def _least(self, rows: DataFrame, share: float = 1.0) -> DataFrame:
        """The SAMPLE rows of least hash, looked for in this share of the hashes: a bounded heap in each task."""
        hashed = rows.withColumn("h", F.xxhash64("kind", "id"))
        if share < 1:
            hashed = hashed.where(F.col("h") <= int(share * 2**64) - 2**63)
        return hashed.orderBy("h").limit(SAMPLE).select("h", *self.axes.features)

    def _table(self, buckets: int) -> str:
        """The session's name for the items of states with so many buckets."""
        return f"nearfield_index_{hashlib.blake2b(self.path.encode(), digest_size=8).hexdigest()}_{buckets}"

    def _declare(self, buckets: int, like: DataFrame | None = None) -> None:
        """Make the table known to the session, with the parts that lie in its folder; those of other numbers of buckets are never read by it."""
        table = self._table(buckets)
        if self.spark.catalog.tableExists(table):
            return
        if like is None:
            like = self.spark.read.parquet(f"{self.path}/items")
        self.spark.sql(f"CREATE TABLE {table} ({self._typed(like)}, part STRING) USING parquet PARTITIONED BY (part) CLUSTERED BY (parent) SORTED BY (parent) INTO {buckets} BUCKETS LOCATION '{self.path}/items'")
        if files.names(self.spark, f"{self.path}/items"):
            self.spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")

    @staticmethod
    def _typed(like: DataFrame) -> str:
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema if f.name != "part")

    def _of(self, kind: str, folders: list[str]) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.path}/{kind}/part={own}" for own in folders))

    def items(self, state: State | None = None) -> DataFrame:
        """The items of a state, the current one if none is given."""
        state = state or self.state
        self._declare(state.buckets)
        table = self._table(state.buckets)
        missing = {own for _, own in state.parts.values()} - {r[0].removeprefix("part=") for r in self.spark.sql(f"SHOW PARTITIONS {table}").collect()}
        if missing:
            # another session wrote them
            self.spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")
        return self._rows(state.buckets, [own for _, own in state.parts.values()])

    def _rows(self, buckets: int, folders: list[str]) -> DataFrame:
        return self.spark.table(self._table(buckets)).where(F.col("part").isin(*folders)).drop("part")

    # statistics

    def _statistics(self, buckets: int, folders: list[str]) -> tuple[int, dict[str, float | None], dict[str, float]]:
        names = self.axes.features
        if not folders:
            return 0, dict.fromkeys(names), dict.fromkeys(names, 1.0)
        ranks = F.lit([i / GRID for i in range(GRID + 1)])
        merged = self._of("sketches", folders).agg(F.sum("rows").alias("rows"), *(F.kll_merge_agg_double(f).alias(f) for f in names))
        count = lambda f: F.kll_sketch_get_n_double(f)
        got = merged.select("rows", *(F.when(count(f) > 0, F.kll_sketch_get_quantile_double(f, ranks)).alias(f) for f in names), *(count(f).alias(f"n {f}") for f in names)).first().asDict()
        items = self._rows(buckets, folders)
        value = {f: F.col(f) for f in names if got[f]}
        between = lambda f: int(6 * SLACK * got[f"n {f}"])
        near = {f: (*_bracket(got[f], 0.5, SLACK), between(f)) for f in value}
        centre: dict[str, float | None] = dict.fromkeys(names) | quantiles(items, value, 0.5, within=near)
        near = {f: (*_deviation_bracket(got[f], centre[f], SLACK), between(f)) for f in value}
        far = quantiles(items, {f: F.abs(c - F.lit(centre[f])) for f, c in value.items()}, 0.5, within=near)
        spread = {f: far[f] * MAD_FACTOR if far.get(f) is not None and far[f] * MAD_FACTOR > SPREAD_FLOOR else 1.0 for f in names}
        return int(got["rows"] or 0), centre, spread

    def ranker(self, sources: dict[str, Source] | None = None) -> Ranker:
        """What ranks the current state; with sources given, only if they are those of that state."""
        state = self.state
        if state is None:
            raise StaleIndex("nothing is indexed yet")
        if sources is not None and {p: s.version for p, s in sources.items()} != {p: v for p, (v, _) in state.parts.items()}:
            raise StaleIndex("the sources have changed")
        axes = Axes(self.axes.columns, state.centre, state.spread)
        sample: list[dict[str, np.ndarray]] = []

        def near(anchor: dict[str, float | None]) -> dict[str, tuple[float, float, int]]:
            if not sample:
                least = axes.standardised(self._of("sample", [own for _, own in state.parts.values()]).orderBy("h").limit(SAMPLE))
                table = least.select(*axes.features).toArrow()
                sample.append({c: table.column(c).to_numpy(zero_copy_only=False).astype(float) for c in axes.features})
            return _scale_brackets(axes, sample[0], anchor, state.rows)

        return Ranker(self.items(state), axes, near)


def _scale_brackets(axes: Axes, z: dict[str, np.ndarray], anchor: dict[str, float | None], rows: int) -> dict[str, tuple[float, float, int]]:
    """By axis, values round the 95th percentile of the distances from an anchor, as the sample has them; axes without any are left out."""
    out = {}
    for axis, cols in axes.columns.items():
        squares = np.array([(z[c] - anchor[c]) ** 2 for c in cols if anchor[c] is not None]).reshape(-1, len(next(iter(z.values()))))
        there = ~np.isnan(squares)
        n = there.sum(axis=0)
        d = np.sort(np.sqrt(np.where(there, squares, 0.0).sum(axis=0)[n > 0] / n[n > 0]))
        if len(d):
            # a sample of all items is as good as all of them
            slack = 0.0 if len(next(iter(z.values()))) >= rows else SAMPLE_SLACK
            at = [int(np.floor((SCALE_SHARE - slack) * (len(d) - 1))) - 1, int(np.ceil((SCALE_SHARE + slack) * (len(d) - 1))) + 1]
            low, high = (float(d[min(len(d) - 1, max(0, i))]) for i in at)
            # sums may differ in their last bits
            out[axis] = (low * (1 - 1e-9), high * (1 + 1e-9), int(3 * SAMPLE_SLACK * rows * len(d) / len(next(iter(z.values())))) + 4)
    return out
