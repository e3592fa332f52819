"""Listing folders, comparing a listing with the catalogue, pairing moved files, and the render cache."""

from __future__ import annotations

import os
import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.functions.scalars import base_name, extension
from nearfield.operators import places
from nearfield.working import dropped, stored

AUDIO = [".wav", ".flac", ".aif", ".aiff", ".mp3", ".ogg"]
#: Bytes that are read from a file at once; bytes that fit one value of a row.
CHUNK, MOST = 1 << 20, (1 << 31) - 1


def opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path:
        return arrow_fs.FileSystem.from_uri(path)
    return arrow_fs.LocalFileSystem(), path.removeprefix("file:")


_ENTRY = pa.schema([("kind", pa.string()), ("path", pa.string()), ("folder", pa.string()), ("real", pa.string()), ("size", pa.int64()), ("mtime", pa.timestamp("us", "UTC")), ("error", pa.string())])


def listed_entries(path: str, folder: str) -> Iterator[tuple]:
    """A folder's own files and folders, links left out; one row with its error if it can't be listed."""
    system, inside = opened(path)
    below = lambda name: f"{folder}/{name}" if folder else name
    try:
        if isinstance(system, arrow_fs.LocalFileSystem):
            for e in os.scandir(inside):
                if e.is_dir(follow_symlinks=False):
                    yield "folder", e.path, below(e.name), os.path.realpath(e.path), None, None, None
                elif e.is_file(follow_symlinks=False):
                    at = e.stat(follow_symlinks=False)
                    yield "file", e.path, folder, None, at.st_size, at.st_mtime_ns // 1000, None
        else:
            for e in system.get_file_info(arrow_fs.FileSelector(inside)):
                whole = f"{path.rstrip('/')}/{e.base_name}"
                if e.type == arrow_fs.FileType.Directory:
                    yield "folder", whole, below(e.base_name), whole, None, None, None
                elif e.type == arrow_fs.FileType.File:
                    yield "file", whole, folder, None, e.size, e.mtime_ns // 1000 if e.mtime_ns else None, None
    except OSError as e:
        yield "unread", path, folder, None, None, None, str(e)[:200]


def walked(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """All files below a folder, whatever their names, and the folders that couldn't be read.

    files: (path, folder, filename, ext, file_size, file_mtime); unread: (path, error).
    Level by level: the folders of one level are dealt over tasks and listed there.
    A folder whose real place was listed already isn't again, so no loop is walked
    for ever; links aren't followed.  Neither names nor contents reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path, folder in zip(batch.column("path").to_pylist(), batch.column("folder").to_pylist(), strict=True):
                for row in listed_entries(path, folder):
                    rows.append(row)
                    if len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ENTRY.types, strict=True)], schema=_ENTRY)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ENTRY.types, strict=True)], schema=_ENTRY)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    root = root.rstrip("/") or "/"
    real = os.path.realpath(opened(root)[1]) if isinstance(opened(root)[0], arrow_fs.LocalFileSystem) else root
    due = spark.createDataFrame([(root if "://" in root else opened(root)[1], "", real)], "path string, folder string, real string")
    seen, found = due.select("real"), None
    while True:
        level = stored(due.repartition(tasks).mapInArrow(run, "kind string, path string, folder string, real string, size long, mtime timestamp, error string"))
        found = level if found is None else found.unionByName(level)
        due = level.where("kind = 'folder'").select("path", "folder", "real").dropDuplicates(["real"]).join(seen, "real", "left_anti").select("path", "folder", "real")
        if not due.limit(1).count():
            break
        seen = seen.unionByName(level.where("kind = 'folder'").select("real"))
    name = base_name(F.col("path"))
    files = found.where("kind = 'file'").select("path", "folder", name.alias("filename"), extension(F.col("path")).alias("ext"), F.col("size").alias("file_size"), F.col("mtime").alias("file_mtime"))
    return files, found.where("kind = 'unread'").select("path", "error")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, folder, filename, ext, file_size, file_mtime) of all files below a folder, whatever their names; contents aren't read."""
    return walked(spark, root)[0]


def _read(files: DataFrame, schema: str, one) -> DataFrame:
    """A row of path, value and error for each file, read where it lies; files are dealt over tasks."""
    kind = {"string": pa.string(), "binary": pa.large_binary()}[schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                value, error = None, None
                try:
                    system, inside = opened(path)
                    value = one(system, inside)
                except Exception as e:  # one bad file doesn't end a run
                    error = f"{type(e).__name__}: {e}"[:200]
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([value], kind), pa.array([error], pa.string())], ["path", "value", "error"])

    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("path").repartition(tasks).mapInArrow(run, f"path string, value {schema}, error string")


def contents(files: DataFrame) -> DataFrame:
    """(path, content, error) of files (path); one of 2 GB and more doesn't fit a row, which its error says."""

    def whole(system: arrow_fs.FileSystem, path: str) -> bytes:
        size = system.get_file_info(path).size
        if size is not None and size > MOST:
            raise ValueError(f"{size} bytes don't fit a row")
        with system.open_input_stream(path) as f:
            return f.read()

    return _read(files, "binary", whole).withColumnRenamed("value", "content")


def hashed(files: DataFrame) -> DataFrame:
    """(path, hash, error): BLAKE2b of files (path) of any size, read in pieces where they lie."""

    def digest(system: arrow_fs.FileSystem, path: str) -> str:
        import hashlib

        h = hashlib.blake2b()
        with system.open_input_stream(path) as f:
            while piece := f.read(CHUNK):
                h.update(piece)
        return h.hexdigest()

    return _read(files, "string", digest).withColumnRenamed("value", "hash")


def content_hash(content: Column) -> Column:
    """SHA-512 of a value that is a column already; files are hashed by hashed()."""
    return F.sha2(content, 512)


def kinds_of(files: DataFrame, name: str = "filename") -> DataFrame:
    """(kind, n): files that are read, those of no use by extension, and resource forks under one key."""
    ext = extension(F.col(name))
    kind = F.when(F.startswith(base_name(F.col(name)), F.lit("._")), F.lit("._*")).otherwise(ext)
    return files.select(kind.alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


def compared(found: DataFrame, known: DataFrame, *, unread: list[str] | None = None, root: str = "") -> DataFrame:
    """(path, id, change): unchanged, identical, changed, added, removed, protected or outside.

    found: path, size, mtime, hash; known: id, path, size, mtime, hash.  A row is
    removed only if it lies under the root and not under a folder that could not
    be read.
    """
    a = found.select("path", F.col("size").alias("s1"), F.col("mtime").alias("m1"), F.col("hash").alias("h1"), F.lit(True).alias("f"))
    b = known.select("path", "id", F.col("size").alias("s0"), F.col("mtime").alias("m0"), F.col("hash").alias("h0"), F.lit(True).alias("k"))
    both = a.join(b, "path", "full_outer")
    safe = F.lit(False)
    for p in unread or []:
        safe = safe | (F.col("path") == p) | F.startswith("path", F.lit(p.rstrip("/") + "/"))
    under = F.startswith("path", F.lit(root.rstrip("/") + "/")) if root else F.lit(True)
    same_key = (F.col("s1") == F.col("s0")) & (F.col("m1") == F.col("m0"))
    same_hash = (F.col("s1") == F.col("s0")) & (F.col("h1") == F.col("h0"))
    change = (
        F.when(F.col("k").isNull(), "added")
        .when(F.col("f").isNull(), F.when(safe, "protected").when(~under, "outside").otherwise("removed"))
        .when(F.coalesce(same_key, F.lit(False)), "unchanged")
        .when(F.coalesce(same_hash, F.lit(False)), "identical")
        .otherwise("changed")
    )
    return both.select("path", "id", change.alias("change"))


def moved(removed: DataFrame, added: DataFrame) -> DataFrame:
    """(id, old_path, new_path): removed and added files paired one to one.

    First by equal hash and size, in order of paths; then, for removed rows
    without a hash, by name, size, length, rate and channels where each side has one
    candidate alone.  removed: id and added: path, name, size, duration, rate, channels, hash.
    """
    key = ["hash", "size"]
    nth = lambda t: t.where("hash is not null").withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("path")))
    old, new = nth(removed), nth(added)
    first = old.select("id", F.col("path").alias("old_path"), *key, "n").join(new.select(F.col("path").alias("new_path"), *key, "n"), [*key, "n"]).select("id", "old_path", "new_path")
    key = ["name", "size", "duration", "rate", "channels"]
    rest = added.join(first.select(F.col("new_path").alias("path")), "path", "left_anti")
    alone = lambda t: t.withColumn("c", F.count("*").over(Window.partitionBy(*key))).where("c = 1")
    second = alone(removed.where("hash is null")).select("id", F.col("path").alias("old_path"), *key).join(alone(rest).select(F.col("path").alias("new_path"), *key), key).select("id", "old_path", "new_path")
    return first.unionByName(second)


def evicted(files: DataFrame, limit: int | None) -> DataFrame:
    """(path, reason): cache files that nothing refers to, then the longest unused until the rest fits the limit.

    files: path, size, used (time), referenced.  Sums go by hour of use first, so
    only the hour that holds the cut is sorted.
    """
    gone = files.where("not referenced").select("path", F.lit("orphan").alias("reason"))
    if limit is None:
        return gone
    live = files.where("referenced").withColumn("hour", F.floor(F.col("used") / 3600))
    newer = Window.orderBy(F.desc("hour")).rowsBetween(Window.unboundedPreceding, -1)
    hours = live.groupBy("hour").agg(F.sum("size").alias("s")).withColumn("after", F.coalesce(F.sum("s").over(newer), F.lit(0)))
    within = Window.partitionBy("hour").orderBy(F.desc("used"), F.desc("path"))
    ranked = live.join(hours, "hour").withColumn("total", F.col("after") + F.sum("size").over(within))
    return gone.unionByName(ranked.where(F.col("total") > limit).select("path", F.lit("old").alias("reason")))


def cache_state(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count_if(~F.col("referenced")).alias("orphans"))


def spread(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """n rows of each key at evenly spaced places (halves round to even), each once."""
    w = Window.partitionBy(key)
    ranked = rows.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    at = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / F.lit(max(1, n - 1))).cast("int"))
    return ranked.where((F.col("_n") <= n) | F.array_contains(at, F.col("_i"))).drop("_i", "_n")


def seeded_folders(roots: DataFrame, scope: DataFrame, hint: str | None) -> DataFrame:
    """Known roots, folders in scope and a hint, once each."""
    out = roots.select("path").union(scope.select("path"))
    if hint:
        out = out.union(roots.sparkSession.createDataFrame([(hint,)], "path string"))
    return out.select(F.regexp_replace("path", "(?<=.)/+$", "").alias("path")).distinct()


def scan_roots(samples: DataFrame) -> DataFrame:
    """The folders that a catalogue was scanned from: paths without the relative folder and name that end them."""
    tail = F.when(F.col("folder") == "", F.concat(F.lit("/"), F.col("filename"))).otherwise(F.concat(F.lit("/"), F.col("folder"), F.lit("/"), F.col("filename")))
    fits = samples.withColumn("_t", tail).where(F.endswith("filepath", F.col("_t")))
    return fits.select(F.expr("left(filepath, length(filepath) - length(_t))").alias("path")).distinct()


def rescanned(spark: SparkSession, root: str, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One run over a folder that was scanned before: (changes, catalogue).

    known: id, path, size, mtime, hash.  The folder is walked; only files that are
    new or whose size or time has changed are read and hashed; those that went and
    those that came are paired by their contents, so that a file that moved keeps
    its id; new files get ids after the greatest one, in order of their paths.

    changes: path, id, change (unchanged, identical, changed, added, moved, removed,
    protected), old_path of moved ones.  catalogue: known's columns as of now;
    removed files are gone, protected ones (below a folder that couldn't be read)
    stay.  A file that can't be read is left as it was known, or out.
    """
    files, unread = walked(spark, root)
    # local files are listed by their paths, also where the root has a scheme
    system, inside = opened(root)
    top = (inside if isinstance(system, arrow_fs.LocalFileSystem) else root).rstrip("/")
    found = files.select("path", F.col("file_size").alias("size"), F.col("file_mtime").alias("mtime"))
    key = known.select("path", F.col("size").alias("_s"), F.col("mtime").alias("_m"), F.col("hash").alias("_h"))
    both = stored(found.join(key, "path", "left").withColumn("same", F.coalesce((F.col("size") == F.col("_s")) & (F.col("mtime") == F.col("_m")), F.lit(False))))
    read = stored(hashed(both.where("not same")))
    now = both.where("same").select("path", "size", "mtime", F.col("_h").alias("hash")).unionByName(both.where("not same").join(read.where("error is null"), "path").select("path", "size", "mtime", "hash"))
    failed = read.where("error is not null").select("path")
    # a folder's own error protects what is known below it; few folders can't be read
    shut = [r.path for r in unread.select("path").limit(1000).collect()]
    if len(shut) == 1000:
        raise ValueError("a thousand folders can't be read: nothing is taken as removed")
    change = compared(now, known, unread=shut, root=top).join(failed.withColumn("failed", F.lit(True)), "path", "left").withColumn("change", F.when(F.col("failed") & (F.col("change") == "removed"), "protected").otherwise(F.col("change"))).drop("failed")
    change = stored(change)
    none = lambda kind: F.lit(None).cast(kind)
    shape = [base_name(F.col("path")).alias("name"), "size", none("double").alias("duration"), none("int").alias("rate"), none("int").alias("channels"), "hash"]
    gone = known.join(change.where("change = 'removed'").select("path"), "path", "left_semi").select("id", "path", *shape)
    came = now.join(change.where("change = 'added'").select("path"), "path", "left_semi").select("path", *shape)
    pairs = stored(moved(gone, came))
    greatest = known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first().m
    fresh_ = places.in_order(came.select("path").join(pairs.select(F.col("new_path").alias("path")), "path", "left_anti"), [F.col("path")])
    new = fresh_.select("path", (F.col("place") + greatest).alias("new_id"))
    to = pairs.select(F.col("new_path").alias("path"), F.col("id").alias("moved_id"), "old_path")
    left = change.join(pairs.select(F.col("old_path").alias("path")), "path", "left_anti")
    named = left.join(to, "path", "left").join(new, "path", "left")
    changes = stored(named.select("path", F.coalesce("id", "moved_id", "new_id").alias("id"), F.when(F.col("moved_id").isNotNull(), "moved").otherwise(F.col("change")).alias("change"), "old_path"))
    live = changes.where("change not in ('removed', 'protected', 'outside')").select("id", "path").join(now, "path").select(*known.columns)
    kept = known.join(changes.where("change in ('protected', 'outside')").select("path"), "path", "left_semi")
    catalogue = stored(live.unionByName(kept))
    dropped(both, read, change, pairs, fresh_)
    return changes, catalogue
