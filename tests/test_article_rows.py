"""What an article's tables send between tasks, and whose lines stand once."""

from pyspark.sql import functions as F
from test_article import tables

from curator.catalog import QUERIES
from curator.sinks.article import article_lines


def shuffles(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]


def test_parts_reach_their_issue_in_few_shuffles(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # Facts and issues; the level and the items, whose rows are dealt before their texts are made.
        found = shuffles(QUERIES["k02_issue_article"](spark, "/root/testdata/sf0.001"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert 0 < len(found) <= 6


def test_repeated_and_missing_issues(spark):
    issue, items, chances, sources, runs, missing = tables(spark)
    other = lambda df, key: df.unionByName(df.withColumn("issue_id", F.lit(key).cast("int")))
    lines = article_lines(issue.unionByName(other(issue, None)), other(other(items, None), 7), chances, other(sources, 7), runs, missing)
    got = {(r.issue_id, r.line): r.n for r in lines.groupBy("issue_id", "line").agg(F.count("*").alias("n")).collect()}
    # Own lines follow the issues, headings the parts.
    assert got[1, "# Week"] == 2 and got[None, "# Week"] == 1 and (7, "# Week") not in got
    assert [got[k, "## Skills"] for k in (1, 7, None)] == [1, 1, 1] and [got[k, "实际来源状态："] for k in (1, 7)] == [1, 1]
    assert got[1, "### ★ T"] == 2 and (7, "### ★ T") not in got and got[7, "- [A](https://a)：ok；x"] == 1
    assert got[1, "来源失败：B：down；B：down。"] == 2 and got[None, "来源失败：本次记录中无失败；不代表未访问来源可用。"] == 1
