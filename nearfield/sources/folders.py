"""Folders of files as a source: spark.read.format("nearfield_files").load(root)."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from nearfield.sources.ingest import listed_entries

FORMAT = "nearfield_files"
SCHEMA = "path string, folder string, filename string, ext string, file_size long, file_mtime timestamp, error string"
_ARROW = pa.schema([("path", pa.string()), ("folder", pa.string()), ("filename", pa.string()), ("ext", pa.string()), ("file_size", pa.int64()), ("file_mtime", pa.timestamp("us", "UTC")), ("error", pa.string())])
#: Rows of a batch.
ROWS = 10_000


@dataclass
class Below(InputPartition):
    """Folders that one task lists: (path, place below the root, real place), each with all below it or its own files alone."""

    folders: tuple[tuple[str, str, str], ...]
    deep: bool


def _suffix(name: str) -> str:
    """As functions.scalars.extension has it, of one name."""
    found = re.search(r"[^.](\.[^.]+)$", name)
    return found[1].lower() if found else "<no-ext>"


class FolderReader(DataSourceReader):
    """Plans a task for some folders each, and lists what the filters leave."""

    def __init__(self, root: str, tasks: int) -> None:
        self.root, self.tasks = root, tasks
        self.exts: set[str] | None = None
        self.under: list[str] = []
        self.exact: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Conditions on the extension and the folder are met while listing: folders that can't hold a row aren't opened."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute in (("ext",), ("folder",)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                held = self.exts if f.attribute == ("ext",) else self.exact
                held = values if held is None else held & values
                if f.attribute == ("ext",):
                    self.exts = held
                else:
                    self.exact = held
            elif isinstance(f, StringStartsWith) and f.attribute == ("folder",):
                self.under.append(f.value)
            else:
                yield f

    def _open(self, folder: str) -> bool:
        """Whether a folder may hold a row, itself or below it."""
        towards = lambda place, goal: goal == place or goal.startswith(f"{place}/") or place == ""
        if self.exact is not None and not any(towards(folder, goal) for goal in self.exact):
            return False
        return all(folder.startswith(u) or u.startswith(folder) for u in self.under)

    def _wanted(self, folder: str, ext: str) -> bool:
        return (self.exts is None or ext in self.exts) and (self.exact is None or folder in self.exact) and all(folder.startswith(u) for u in self.under)

    def partitions(self) -> list[InputPartition]:
        """Folders are opened level by level until there are some for every task; those that were opened give their own files."""
        opened: list[tuple[str, str, str]] = []
        seen = {self.root}
        level = [(self.root, "", self.root)]
        while level and len(level) < 2 * self.tasks:
            below = []
            for path, folder, _ in level:
                for kind, inner, place, real, *_ in listed_entries(path, folder):
                    if kind == "folder" and real not in seen and self._open(place):
                        seen.add(real)
                        below.append((inner, place, real))
            opened += level
            level = below
            if len(opened) > 50 * self.tasks:
                break
        parts: list[InputPartition] = []
        for folders, deep in ((opened, False), (level, True)):
            # neighbours part, so that a large branch is several tasks
            parts += [Below(tuple(folders[i :: self.tasks]), deep) for i in range(min(self.tasks, len(folders)))]
        return parts

    def read(self, partition: Below) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        seen = {real for *_, real in partition.folders}
        due = list(partition.folders)
        while due:
            path, folder, _ = due.pop()
            for kind, inner, place, real, size, mtime, error in listed_entries(path, folder):
                if kind == "folder":
                    if partition.deep and real not in seen and self._open(place):
                        seen.add(real)
                        due.append((inner, place, real))
                elif kind == "unread":
                    rows.append((inner, folder, None, None, None, None, error))
                else:
                    name = inner.rsplit("/", 1)[-1]
                    if self._wanted(folder, _suffix(name)):
                        rows.append((inner, folder, name, _suffix(name), size, mtime, None))
                if len(rows) >= ROWS:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


class Folders(DataSource):
    """Every file below a folder, whatever its name, without links; a folder that can't be listed is a row with its error.

    load(path); option `tasks`: how many share the work (8 if it isn't given).
    A folder is listed once however it is reached within a task; conditions on `ext`
    and `folder` (equality, in, prefix) are met while listing.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        path = self.options.get("path", "")
        if not path:
            raise ValueError("load() needs a folder")
        return FolderReader(path if path == "/" else path.rstrip("/"), max(1, int(self.options.get("tasks", "8"))))


def registered(spark: SparkSession) -> SparkSession:
    """The session with the format, and with conditions handed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Folders)
    return spark
