"""Set operations over sources, decisions and logs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_sources(*sources: DataFrame) -> DataFrame:
    """Rows of every source; a column missing from a source is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def merge_accepted(prior: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Prior information kept, newly rejected removed, newly accepted added.

    decisions: the columns of prior plus `decision`.
    """
    rejected = decisions.where("decision = 'reject'").select(key)
    accepted = decisions.where("decision = 'accept'").select(*prior.columns)
    return prior.join(rejected, key, "left_anti").unionByName(accepted.join(prior.select(key), key, "left_anti"))


def pending(successes: DataFrame, acknowledged: DataFrame, key: str) -> DataFrame:
    """Successful runs that nobody has answered yet."""
    return successes.join(acknowledged.select(key).distinct(), key, "left_anti")


def is_subset(part: Column, whole: Column) -> Column:
    return F.size(F.array_except(part, whole)) == 0


def same_set(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: do two tables hold exactly the same keys?"""
    sides = a.select(*key).distinct().withColumn("_a", F.lit(1)).join(
        b.select(*key).distinct().withColumn("_b", F.lit(1)), list(key), "full_outer"
    )
    return sides.agg(
        F.count_if(F.col("_b").isNull()).alias("only_left"), F.count_if(F.col("_a").isNull()).alias("only_right")
    ).withColumn("same", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def split_leaks(labels: DataFrame, identity: str, split: str = "split") -> DataFrame:
    """Identities found in more than one split."""
    return labels.groupBy(identity).agg(F.min(split).alias("first_split"), F.max(split).alias("last_split")).where(
        "first_split <> last_split"
    )
