import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from curator.runtime import local_session

    session = local_session(8, app="curator-tests")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate column expressions over one row of named values."""

    def run(column, **values):
        from pyspark.sql import functions as F

        row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("_")])
        return row.select(column.alias("x")).collect()[0]["x"]

    return run


@pytest.fixture
def small_ranges(monkeypatch):
    """Cut even small inputs into several ranges, as large inputs are."""
    from curator.operators import ordered

    monkeypatch.setattr(ordered, "_MIN_RANGE_ROWS", 50)
