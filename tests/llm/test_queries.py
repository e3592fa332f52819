"""The registered queries of the subpackage against their SQL, and the pipeline stage by stage."""

import duckdb
import pytest

import corpus_pipeline
from nearfield.llm import jaccard
from nearfield.llm.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DIR}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    got = sorted(map(repr, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))
    found = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    want = sorted(map(repr, (tuple(r[names.index(c)] for c in sorted(names)) for r in found.fetchall())))
    assert sorted(df.columns) == sorted(names) and got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_returns_all_documents(spark, name):
    assert QUERIES[name](spark, DIR).count() == spark.read.parquet(f"{DIR}/documents.parquet").count()


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, DIR).persist()
        sizes.append(docs.count())
        if name == "n-gram Jaccard join":
            groups = jaccard.near_duplicates(before, k=5, percent=80)
            assert docs.count() == groups.select("component_id").distinct().count()
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert docs.columns == columns
            assert docs.join(before, "doc_id", "left_anti").count() == 0
    assert sizes[0] > sizes[1] > sizes[-1] == sizes[-2] > 0
    assert corpus_pipeline.run(spark, DIR).count() == sizes[-1]
