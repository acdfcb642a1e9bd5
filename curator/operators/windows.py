"""Latest states, histories, representatives and budgets per key.

"Latest" and "representative" are maxima of a struct, which combine on the map
side; positions and budgets use the ordered scan. Neither sends a whole group
to one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curator.functions.times import event_bounds
from curator.operators.ordered import ordered_scan, with_ranges


def latest(df: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The last row of each key by `order` (ties by the remaining columns)."""
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    rest = [c for c in df.columns if c not in key]
    best = F.max(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *rest)).alias("_best")
    return df.groupBy(*key).agg(best).select(*key, *[F.col(f"_best.{c}").alias(c) for c in rest])


def current_state(log: DataFrame, key: Sequence[str], order: Sequence[str], discovered: str) -> DataFrame:
    """Latest entry per key with the discovery time of its first entry."""
    rest = [c for c in log.columns if c not in key]
    last = F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_last")
    first = F.min(F.struct(*order, discovered)).alias("_first")
    return log.groupBy(*key).agg(last, first).select(
        *key, *[F.col(f"_last.{c}").alias(c) for c in rest], F.col(f"_first.{discovered}").alias("first_discovered_at")
    )


def history(log: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Every entry with its 1-based place in the key's history and the history's length."""
    return ordered_scan(log, order, key, position="place", size="entries")


def event_candidates(records: DataFrame, key: Sequence[str] = ("kind", "event_url")) -> DataFrame:
    """One effective record per event: verified first, then the newest.

    records: key columns, evidence_status, verified_at, collected_at, obs_id, ...
    """
    rest = [c for c in records.columns if c not in key]
    verified = F.col("evidence_status") == "verified"
    preference = F.struct(
        verified.alias("_v"),
        F.when(verified, F.col("verified_at")).otherwise(F.col("collected_at")).alias("_t"),
        F.col("collected_at").alias("_c"), *[F.col(c) for c in ("obs_id", *[r for r in rest if r != "obs_id"])],
    )
    grouped = records.groupBy(*key).agg(
        F.max(preference).alias("_best"),
        F.max("collected_at").alias("event_last_collected_at"),
        F.count(F.lit(1)).alias("observation_count"),
    )
    return grouped.select(
        *key, *[F.col(f"_best.{c}").alias(c) for c in rest],
        F.when(F.col("_best._v"), F.col("_best.verified_at")).alias("last_verified_at"),
        "event_last_collected_at", "observation_count",
    )


def representative(events: DataFrame, key: Sequence[str]) -> DataFrame:
    """The event that stands for its candidate.

    events: selection_status, occurred_at, occurred_on, discovered_at,
    last_verified_at, collected_at, ...; a published block never outranks.
    """
    rest = [c for c in events.columns if c not in key]
    status = F.when(F.col("selection_status") == "available", 2).when(F.col("selection_status") == "needs_evidence", 1).otherwise(0)
    best = F.struct(
        status.alias("_s"),
        F.coalesce(event_bounds("occurred_at", "occurred_on")["earliest"], "discovered_at").alias("_t"),
        F.coalesce("last_verified_at", "collected_at").alias("_o"), *rest,
    )
    return events.groupBy(*key).agg(F.max(best).alias("_best")).select(*key, *[F.col(f"_best.{c}").alias(c) for c in rest])


def rank(df: DataFrame, score: str, tie: str, name: str = "rank") -> DataFrame:
    """Place of every row by descending score, ties by `tie`; no single-task sort."""
    return ordered_scan(df, [-F.col(score), F.col(tie)], position=name)


def feed_edges(df: DataFrame, source: str, key: str, order: Sequence[str]) -> DataFrame:
    """First and last key of each feed in document order, and its length."""
    place = F.struct(*order)
    return df.groupBy(source).agg(
        F.min_by(key, place).alias("newest_key"), F.max_by(key, place).alias("oldest_key"),
        F.count(F.lit(1)).alias("entry_count"),
    )


def take_budget(df: DataFrame, length: Column | str, budget: int, order: Sequence[Column | str], group: Sequence[str] = ()) -> DataFrame:
    """Rows in order while their cumulative length fits the budget."""
    length = F.col(length) if isinstance(length, str) else length
    return ordered_scan(df, order, group, sums={"used": length.cast("long")}).where(F.col("used") <= budget)


def fair_share(df: DataFrame, length: Column | str, budget: int, order: Sequence[str], group: Sequence[str]) -> DataFrame:
    """Characters granted to each row: an equal share, unused shares in order."""
    length = F.col(length) if isinstance(length, str) else length
    placed, part = with_ranges(df.withColumn("_need", length.cast("long")), [F.col(c) for c in (*group, *order)], "_part")
    counted = ordered_scan(placed, order, group, size="_rows", bucket=part)
    based = counted.withColumn("_base", F.least("_need", F.floor(F.lit(budget) / F.col("_rows")).cast("long")))
    wanted = F.col("_need") - F.col("_base")
    scanned = ordered_scan(based, order, group, sums={"_asked": wanted}, totals={"_given": F.col("_base")}, bucket=part)
    left = F.lit(budget) - F.col("_given") - (F.col("_asked") - wanted)
    extra = F.greatest(F.lit(0), F.least(wanted, left))
    return scanned.withColumn("granted", F.col("_base") + extra).drop("_part", "_need", "_rows", "_base", "_asked", "_given")


def watches(log: DataFrame, key: str, order: Sequence[str], enabled: Column) -> DataFrame:
    """Latest watch state per repository among the enabled ones."""
    return latest(log.where(enabled), [key], order)


def select_chunks(
    lines: DataFrame, group: Sequence[str], score: Column | str, order: Sequence[str], length: Column | str,
    budget: int, reserve: int,
) -> DataFrame:
    """Lines read within a budget: best matching chunks first, some room for the rest.

    Matching lines may use budget - reserve, the others the reserve; where
    nothing matches, plain order uses the whole budget.
    """
    length = (F.col(length) if isinstance(length, str) else length).cast("long")
    score = (F.col(score) if isinstance(score, str) else score).cast("long")
    scored = lines.withColumn("_score", score).withColumn("_length", length)
    matched = F.col("_score") > 0
    scanned = ordered_scan(
        scored, [(~matched).cast("int"), -F.col("_score"), *order], group,
        sums={"_used": F.col("_length")},
        totals={"_matched": F.when(matched, F.col("_length")).otherwise(0), "_hits": matched.cast("long")},
    )
    kept = (
        F.when(F.col("_hits") == 0, F.col("_used") <= budget)
        .when(matched, F.col("_used") <= budget - reserve)
        .otherwise(F.col("_used") - F.col("_matched") <= reserve)
    )
    return scanned.where(kept).withColumn("fallback", F.col("_hits") == 0).drop("_score", "_length", "_used", "_matched", "_hits")


def merge_intervals(df: DataFrame, group: Sequence[str], start: str, end: str) -> DataFrame:
    """Disjoint union of half-open ranges per group, one row per merged range.

    The row form of `functions.spans.merge_ranges`, for groups of any size.
    """
    solid = df.where(F.col(end) > F.col(start)).select(*group, F.col(start).alias("_a"), F.col(end).alias("_b"))
    placed, part = with_ranges(solid, [F.col(c) for c in (*group, "_a", "_b")], "_part")
    reached = ordered_scan(placed, ["_a", "_b"], group, mins_before={"_far": -F.col("_b")}, bucket=part)
    opened = reached.withColumn("_opens", (F.col("_far").isNull() | (F.col("_a") > -F.col("_far"))).cast("long"))
    numbered = ordered_scan(opened, ["_a", "_b"], group, sums={"_island": F.col("_opens")}, bucket=part)
    return numbered.groupBy(*group, "_island").agg(F.min("_a").alias(start), F.max("_b").alias(end)).drop("_island")
