"""Scores of impact predictions against gold cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """Rounded share; 1.0 where there is nothing to find."""
    return F.when(denominator == 0, F.lit(1.0)).otherwise(F.bround(numerator / denominator, 4))


def impact_projects(gold: DataFrame, pred: DataFrame, critical: DataFrame) -> DataFrame:
    """One row of micro counts over (case_id, project_id) pairs.

    gold, pred: affected and predicted projects; critical: case_id of critical
    cases. Two or more critical misses open the dependency-graph question.
    """
    key = ["case_id", "project_id"]
    both = gold.select(*key).distinct().withColumn("_g", F.lit(True)).join(
        pred.select(*key).distinct().withColumn("_p", F.lit(True)), key, "full_outer"
    ).join(critical.select("case_id").distinct().withColumn("_c", F.lit(True)), "case_id", "left")
    g, p = F.col("_g").isNotNull(), F.col("_p").isNotNull()
    counts = both.agg(
        F.count_if(g & p).alias("true_positive_projects"), F.count_if(g & ~p).alias("false_negative_projects"),
        F.count_if(~g & p).alias("false_positive_projects"), F.count_if(g & ~p & F.col("_c").isNotNull()).alias("critical_misses"),
    )
    tp = F.col("true_positive_projects")
    return counts.withColumns({
        "project_recall": ratio(tp, tp + F.col("false_negative_projects")),
        "precision": ratio(tp, tp + F.col("false_positive_projects")),
        "repeated_critical_misses": F.col("critical_misses") >= 2,
        "dependency_graph_decision": F.when(F.col("critical_misses") >= 2, "dependency_graph_candidate_requires_root_cause_review")
        .otherwise("do_not_add_dependency_graph_to_mvp"),
    })


def evidence_levels(sides: DataFrame, matched: DataFrame) -> DataFrame:
    """none / one_sided / two_sided per case.

    sides: (case_id, project_id) the change touches, the changed project
    included; matched: the same keys where required evidence was hit.
    """
    key = ["case_id", "project_id"]
    found = matched.select(*key).distinct().withColumn("_m", F.lit(1))
    counted = sides.select(*key).distinct().join(found, key, "left").groupBy("case_id").agg(
        F.count(F.lit(1)).alias("_sides"), F.count("_m").alias("_hit")
    )
    level = F.when(F.col("_hit") == 0, "none").when(F.col("_hit") == F.col("_sides"), "two_sided").otherwise("one_sided")
    return counted.select("case_id", level.alias("level"))


def completeness(required: DataFrame, matched_ids: DataFrame, key: str = "gold_id") -> DataFrame:
    """Share of required evidence or tests that was matched, as one row."""
    marked = required.select(key).distinct().join(matched_ids.select(key).distinct().withColumn("_m", F.lit(1)), key, "left")
    return marked.agg(ratio(F.count("_m"), F.count(F.lit(1))).alias("completeness"), F.count("_m").alias("matched"), F.count(F.lit(1)).alias("required"))
