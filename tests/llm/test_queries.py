"""Registered queries on the smallest generated tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from runsieve.llm import queries
from runsieve.llm.common import stage

SF_DIR = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="generated tables missing")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in SF_DIR.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", queries.ORACLES)
def test_query_matches_sql(spark, duck, name):
    frame = queries.QUERIES[name](spark, str(SF_DIR))
    columns = sorted(frame.columns)
    found = sorted((tuple(row) for row in frame.select(*columns).collect()), key=repr)
    cursor = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    expected = sorted((tuple(row[names.index(c)] for c in columns) for row in cursor.fetchall()), key=repr)
    assert found == expected and found


def test_pipeline_is_its_stages(spark):
    docs = spark.read.parquet(str(SF_DIR / "documents.parquet"))
    columns = docs.columns
    for name, apply in corpus_pipeline.STAGES:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = stage(apply(spark, docs, str(SF_DIR)), name)
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        assert after <= before
        if name != "packing":
            assert docs.columns == columns and len(after) == docs.count()
        else:
            assert after == before
    whole = corpus_pipeline.run(spark, str(SF_DIR))
    assert sorted(map(tuple, whole.select("doc_id", "start", "length").collect())) == sorted(
        map(tuple, docs.select("doc_id", "start", "length").collect())
    )
