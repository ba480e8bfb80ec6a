"""Every query against its SQL, on the smallest data set."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as contract
from tillwise.plans.oracle import ORACLE
from tillwise.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test data not there")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _sorted(rows):
    return sorted(rows, key=lambda row: [(x is None, str(x)) for x in row])


def _same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-9)
    return a == b


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = _sorted(tuple(r) for r in df.select(*columns).collect())
    answer = duck.execute(ORACLE[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = _sorted(tuple(row[i] for i in order) for row in answer.fetchall())
    assert len(got) == len(expected)
    for mine, theirs in zip(got, expected, strict=True):
        assert all(_same(a, b) for a, b in zip(mine, theirs, strict=True)), (mine, theirs)


def test_every_query_without_sql_is_known():
    # Its text writes numbers the Java way; insight_payload_read compares what is in it.
    assert set(QUERIES) - set(ORACLE) == {"insight_payload"}
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert [r.category for r in rows] and len(rows) == 3
    assert abs(sum(r.percentage for r in rows) - 100) < 1e-9
    assert contract.queries().keys() >= QUERIES.keys() and contract.oracle_sql().items() >= ORACLE.items()
