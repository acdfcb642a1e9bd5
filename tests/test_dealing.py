"""Rows dealt by key, and the queries that join order lines under their orders."""

import pytest
from pyspark.sql import functions as F

from curator import runtime
from curator.catalog import QUERIES


@pytest.fixture
def orders(spark, tmp_path):
    n = F.col("id")
    day = F.timestamp_seconds(F.lit(1704067200) + n * 3600)
    pick = lambda *values: F.get(F.array(*[F.lit(v) for v in values]), (n % len(values)).cast("int"))
    spark.range(300).select(
        n.alias("o_orderkey"), (n * 7 % 100).alias("o_custkey"), pick("F", "O", "P").alias("o_orderstatus"),
        pick("1-URGENT", "2-HIGH", "5-LOW").alias("o_orderpriority"), day.alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(1200).select(
        F.floor(n / 4).alias("l_orderkey"), (n % 4).cast("int").alias("l_linenumber"), (n * 3 % 200).alias("l_partkey"), (n % 20).alias("l_suppkey"),
        (n % 50).cast("double").alias("l_quantity"), pick("O", "F").alias("l_linestatus"), pick("R", "A", "N").alias("l_returnflag")).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["v02_opportunities", "v01_issue_items", "v02_final_issues", "v02_group_rules", "v01_provenance", "v03_decisions"])
def test_rows_of_one_task_are_bounded(spark, orders, monkeypatch, name):
    rows = lambda: sorted(map(str, QUERIES[name](spark, orders).collect()))
    want = rows()
    monkeypatch.setattr(runtime, "_TASK_ROWS", 100)
    found = QUERIES[name](spark, orders)
    assert found.rdd.getNumPartitions() >= 1200 // 100
    assert want and rows() == want


def test_tables_are_dealt_alike(spark, monkeypatch):
    monkeypatch.setattr(runtime, "_TASK_ROWS", 50)
    large, small = runtime.dealt("id", spark.range(1000), spark.range(10))
    assert large.rdd.getNumPartitions() == small.rdd.getNumPartitions() == 20
