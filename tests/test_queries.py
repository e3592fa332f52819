"""Every registered query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from nearfield.plans import catalogue

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


RUNS = {n: (catalogue.QUERIES[n], sql) for n, sql in catalogue.ORACLE_SQL.items()} | catalogue.FIXED


@pytest.mark.parametrize("name", sorted(RUNS))
def test_query_equals_its_sql(spark, duck, name):
    run, sql = RUNS[name]
    df = run(spark, DIR)
    got = sorted(map(repr, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))
    found = duck.execute(sql)
    names = [c[0] for c in found.description]
    want = sorted(map(repr, (tuple(r[names.index(c)] for c in sorted(names)) for r in found.fetchall())))
    assert sorted(df.columns) == sorted(names)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DIR).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["sample_id", "score", "hit_id"] and df.count() > 0


def test_every_query_names_what_it_covers():
    assert set(catalogue.COVERS) == set(catalogue.QUERIES) and set(catalogue.FIXED_COVERS) == set(catalogue.FIXED)


def test_the_rest_does_not_import_the_llm_subpackage():
    root = os.path.join(os.path.dirname(entry.__file__), "nearfield")
    for path in glob.glob(f"{root}/**/*.py", recursive=True):
        if f"{os.sep}llm{os.sep}" not in path:
            assert "nearfield.llm" not in open(path).read(), path
