"""Every registered query against its SQL on the smallest data set."""

import os

import pytest
from compare import DATA, check, duck

import __spark_entry__ as entry

ROOT = f"{DATA}/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(ROOT)


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="driver tables are not present")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    ok, text = check(spark, con, ROOT, name, QUERIES[name], SQL.get(name))
    assert ok, text


def test_names_are_paired():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="driver tables are not present")
def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    assert [r["total"] for r in rows] == sorted((r["total"] for r in rows), reverse=True)
