"""Every registered query against its SQL on the smallest generated tables."""

from __future__ import annotations

import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module

SF_DIR = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="generated tables missing")
# The optional operators have tests of their own.
OPTIONAL = re.compile(r"op\d+_|pipeline$")
QUERIES = {k: v for k, v in entry_module.queries().items() if not OPTIONAL.match(k)}
ORACLES = {k: v for k, v in entry_module.oracle_sql().items() if not OPTIONAL.match(k)}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in SF_DIR.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def ordered(rows):
    return sorted(rows, key=lambda row: [(value is None, str(value)) for value in row])


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_sql(spark, duck, name):
    frame = QUERIES[name](spark, str(SF_DIR))
    columns = sorted(frame.columns)
    found = [tuple(row) for row in frame.select(*columns).collect()]
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    expected = [tuple(row[i] for i in places) for row in cursor.fetchall()]
    assert ordered(found) == ordered(expected)
    assert found


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


LARGER = Path("/root/testdata/sf0.01")


@pytest.mark.skipif(not LARGER.exists(), reason="generated tables missing")
def test_rows_of_the_fixture_can_tell_rules_apart():
    """Each loosening and each outcome changes the expected rows; one study is hot."""
    duck = duckdb.connect()
    for path in LARGER.glob("*.parquet"):
        duck.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")

    def rows(name):
        return duck.execute(ORACLES[name]).fetchall()

    def values(name, *columns):
        return set(duck.execute(f"SELECT DISTINCT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall())

    sizes = [len(rows("keep_small_rna")), *(len(rows(f"keep_relaxed_{i}")) for i in range(1, 5))]
    assert sizes == sorted(set(sizes)) and sizes[0] > 0
    reports = [rows("screen_total_long"), *(rows(f"target_relaxed_{i}") for i in range(1, 4))]
    assert all(set(map(repr, a)) != set(map(repr, b)) for a, b in zip(reports, reports[1:]))
    assert values("ladder_small_rna", "rung") == {(i,) for i in range(5)}
    assert values("ladder_total_long", "rung") >= {(0,), (1,), (3,)}
    assert 0 < len(rows("matched_design")) < len(rows("screen_total_long"))
    for flag in ("title_mentions_alzheimer", "title_mentions_mirna"):
        assert values("enrich", flag) == {("True",), ("False",)}
    assert len(values("target_relaxed_3", "evidence")) == 5
    assert len(values("target_relaxed_3", "verdict")) == 4
    assert len(values("target_relaxed_3", "tissue_verdict")) == 5
    share = duck.execute(
        f"SELECT max(n) / sum(n) FROM (SELECT count(*) AS n FROM ({ORACLES['study_runs']}) GROUP BY bioproject)"
    ).fetchone()[0]
    assert share > 0.3
    assert rows("unreadable_documents") and len(rows("json_records")) < len(rows("sheet_round_trip"))
