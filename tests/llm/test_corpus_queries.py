"""The registered corpus queries on the smallest tables."""

import os

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry
import corpus_pipeline
from catchment.llm import queries

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables not present")


@pytest.mark.parametrize("name", queries.ORACLES)
def test_oracle(spark, name):
    assert compare(queries.QUERIES[name](spark, SMALL), connect(SMALL), queries.ORACLES[name]) is None


def test_all_are_registered():
    names = entry.queries()
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(names)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLES and n[2:4] not in ("8_", "11")])
def test_a_row_for_each_document(spark, name):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = queries.QUERIES[name](spark, SMALL)
    assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(
        r.doc_id for r in docs.select("doc_id").collect())


def test_stages_of_the_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    left, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, SMALL)
        assert left.columns == columns, name
    out = corpus_pipeline.run(spark, SMALL)
    assert out.filter("NOT round_trip").count() == 0
    assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in left.select("doc_id").collect()}
    assert out.count() == left.count()
