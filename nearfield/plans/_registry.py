"""Queries by name, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nearfield.io import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Query -> the operators of the inventory that it runs.
COVERS: dict[str, str] = {}
#: Rules over fixed values, which read no table: not registered, but tested against their SQL like the others.
FIXED: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}
#: What these run.
FIXED_COVERS: dict[str, str] = {}


def query(name: str, covers: str, sql: str | None = None, *, fixed: bool = False):
    """Register a function of Tables under a name; without SQL only its rows are checked.  fixed: it reads no table, and is kept for its test alone."""

    def add(f: Callable[[Tables], DataFrame]):
        if name in QUERIES or name in FIXED:
            raise ValueError(name)
        if fixed:
            FIXED[name], FIXED_COVERS[name] = (lambda spark, folder: f(Tables(spark, folder)), sql), covers
            return f
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        COVERS[name] = covers
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add
