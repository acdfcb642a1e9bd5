"""Connected components by contraction, one table per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curator.llm.common import by_number, materialize


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b); nodes of one component have the same root.

    Each round hooks every node to its neighbour of least rank (a hash of the node, so that chains of neighbours are
    short whatever the ids), follows those hooks four steps, and replaces the ends of every edge by what they reached.
    Edges inside one node vanish; the rest goes into the next round. Two nodes are joined only if an edge path joins
    them, and the rounds end when no edge is left, so the result is exact. Every round writes its (node, next) table
    in the shared folder; the tables shrink by a constant factor, and they are composed from the last to the first.
    A hub's edges are combined before the shuffle (`min`), and the joins are equality joins, which Spark may split
    where one node has many edges. A round's hooks are broadcast only if its edges, which are counted, are few.
    """
    spark = edges.sparkSession
    rest = materialize(
        edges.select(_ranked("a"), _ranked("b")).where("a.node <> b.node").distinct(), "edges")
    hops: list[tuple[DataFrame, int]] = []
    while n := rest.count():
        both = rest.union(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("b"))
        hook = materialize(_twice(_twice(hook, 2 * n), 2 * n), "hook")
        left = by_number(hook.select(F.col("a"), F.col("b").alias("a2")), 2 * n)
        right = by_number(hook.select(F.col("a").alias("b"), F.col("b").alias("b2")), 2 * n)
        rest = materialize(
            rest.join(left, "a").join(right, "b").where("a2.node <> b2.node")
            .select(F.col("a2").alias("a"), F.col("b2").alias("b")).distinct(), "edges")
        hops.append((hook.select(F.col("a.node").alias("node"), F.col("b.node").alias("root")), 2 * n))
    if not hops:
        kind = edges.schema["a"].dataType
        return spark.range(0).select(F.lit(None).cast(kind).alias("node"), F.lit(None).cast(kind).alias("root"))
    found, rows = hops[-1]
    for hop, n in reversed(hops[:-1]):
        later = by_number(found.select(F.col("node").alias("root"), F.col("root").alias("last")), rows)
        found, rows = hop.join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root")), n
    return found


def _ranked(name: str):
    return F.struct(F.xxhash64(name).alias("rank"), F.col(name).alias("node")).alias(name)


def _twice(hook: DataFrame, rows: int) -> DataFrame:
    """Follow each hook, of so many at most, once more."""
    then = by_number(hook.select(F.col("a").alias("b"), F.col("b").alias("c")), rows)
    return hook.join(then, "b", "left").select("a", F.coalesce("c", "b").alias("b"))
