"""Ordered scans against plain loops, hot groups included."""

import random

import pytest
from pyspark.sql import functions as F

from curator.operators.ordered import ordered_scan, range_bucket
from curator.operators.windows import fair_share, merge_intervals, select_chunks, take_budget

pytestmark = pytest.mark.usefixtures("small_ranges")


@pytest.mark.parametrize("hot", [0.0, 0.4, 1.0])
def test_running_values(spark, hot):
    rng = random.Random(int(hot * 10) + 1)
    rows = [("hot" if rng.random() < hot else f"g{rng.randrange(40)}", rng.randrange(200), i, rng.randrange(9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, o int, i int, v int")
    out = ordered_scan(df, ["o", "i"], ["g"], position="p", size="n", sums={"s": F.col("v")}, totals={"t": F.col("v")}, mins_before={"m": F.col("v")})
    expected = {}
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    for members in groups.values():
        total, low, running = sum(r[3] for r in members), None, 0
        for place, r in enumerate(sorted(members, key=lambda r: (r[1], r[2])), 1):
            running += r[3]
            expected[r[2]] = (place, len(members), running, total, low)
            low = r[3] if low is None else min(low, r[3])
    got = {r["i"]: (r["p"], r["n"], r["s"], r["t"], r["m"]) for r in out.collect()}
    assert got == expected


def test_one_group_is_split(spark):
    df = spark.range(5000).select(F.lit("hot").alias("g"), F.col("id"))
    plan_parts = ordered_scan(df, ["id"], ["g"], position="p").select(F.max("p"), F.count_distinct("p")).collect()[0]
    assert tuple(plan_parts) == (5000, 5000)
    sizes = df.groupBy(range_bucket(df, [F.col("g"), F.col("id")]).alias("b")).count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 1300


def test_few_rows_need_no_ranges(spark, monkeypatch):
    from curator.operators import ordered

    monkeypatch.setattr(ordered, "_MIN_RANGE_ROWS", 20_000)
    df = spark.range(300).select((F.col("id") % 3).alias("g"), "id")
    assert range_bucket(df, [F.col("id")]) is None
    out = ordered_scan(df, ["id"], ["g"], position="p", size="n", sums={"s": F.lit(2)}, totals={"t": F.lit(1)}, mins_before={"m": F.col("id")})
    assert out.where("p = 100 and n = 100 and s = 200 and t = 100 and m = g").count() == 3


def test_null_groups_and_timestamps(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), ("a", 2)], "g string, o int").withColumn("at", F.timestamp_seconds("o"))
    got = {(r["g"], r["o"]): r["p"] for r in ordered_scan(df, ["at"], ["g"], position="p").collect()}
    assert got == {(None, 1): 1, (None, 3): 2, ("a", 2): 1}


def test_budgets(spark):
    rng = random.Random(5)
    rows = [(f"g{rng.randrange(3)}", i, rng.randrange(1, 60)) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, i int, n int")
    taken = {r["i"] for r in take_budget(df, "n", 500, ["i"], ["g"]).collect()}
    granted = {r["i"]: r["granted"] for r in fair_share(df, "n", 4000, ["i"], ["g"]).collect()}
    for g in {r[0] for r in rows}:
        members = [r for r in rows if r[0] == g]
        used, keep = 0, set()
        for _, i, n in members:
            if used + n > 500:
                break
            used += n
            keep.add(i)
        assert {i for _, i, _ in members if i in taken} == keep
        share = 4000 // len(members)
        counts = [min(n, share) for *_, n in members]
        left = 4000 - sum(counts)
        for j, (_, _, n) in enumerate(members):
            extra = min(left, n - counts[j])
            counts[j] += extra
            left -= extra
        assert [granted[i] for _, i, _ in members] == counts


def test_chunk_selection_falls_back(spark):
    df = spark.createDataFrame([("q", i, 10, 0) for i in range(10)] + [("r", i, 10, int(i in (7, 8))) for i in range(10)], "q string, i int, n int, s int")
    got = {}
    for r in select_chunks(df, ["q"], "s", ["i"], "n", 50, 20).collect():
        got.setdefault(r["q"], set()).add(r["i"])
    assert got == {"q": {0, 1, 2, 3, 4}, "r": {7, 8, 0, 1}}


def test_merge_intervals(spark):
    rng = random.Random(9)
    rows = [(rng.choice("abc"), a := rng.randrange(4000), a + rng.randrange(0, 12)) for _ in range(900)]
    got = {}
    for r in merge_intervals(spark.createDataFrame(rows, "g string, a int, b int"), ["g"], "a", "b").collect():
        got.setdefault(r["g"], []).append((r["a"], r["b"]))
    for g in "abc":
        merged = []
        for a, b in sorted((a, b) for k, a, b in rows if k == g and b > a):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        assert sorted(got[g]) == [tuple(m) for m in merged]
