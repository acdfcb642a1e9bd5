"""What the training-data operators share: session settings, row splits, ordered buckets and bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curator import runtime
from curator.runtime import materialize, shuffled

#: Rows in one Arrow batch. Texts may be long, and two Python workers share an executor with the JVM.
BATCH_ROWS = 512
BATCH_BYTES = "16m"


def configure(spark: SparkSession) -> SparkSession:
    runtime.configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remainder(column: str | Column, n: int) -> Column:
    """crc32 of a value as text, modulo n: the split that keeps held-out rows apart (null counts as an empty text)."""
    text = (F.col(column) if isinstance(column, str) else column).cast("string")
    return F.crc32(F.coalesce(text, F.lit(""))) % n


def free_name(df: DataFrame, base: str) -> str:
    """A column name that `df` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


def narrow(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, as `doc_id` and `text`; other columns can't clash with an operator's own."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def in_order(df: DataFrame, buckets: int) -> tuple[DataFrame, list[int]]:
    """Put rows of (doc_id, ...) into ranges of `doc_id`.

    Adds `bucket`, which rises with doc_id, and returns the lower bounds of all buckets but the first. The bounds are
    quantiles of the ids, at most `buckets` of them, so the driver holds a number of values that follows the number
    of partitions and not the rows. Rows of one id share a bucket; null ids go to bucket 0.
    """
    steps = [i / buckets for i in range(1, buckets)]
    found = df.agg(F.percentile_approx("doc_id", steps, 10_000).alias("q")).first()["q"] if steps else None
    bounds = sorted({int(x) for x in found or []})
    if not bounds:
        return df.withColumn("bucket", F.lit(0)), []
    from pyspark.ml.feature import Bucketizer

    inf = float("inf")
    splits = [-inf, *sorted({float(x) for x in bounds}), inf]
    ranges = Bucketizer(splits=splits, inputCol="__key", outputCol="__range")
    placed = ranges.transform(df.withColumn("__key", F.coalesce(F.col("doc_id").cast("double"), F.lit(-inf))))
    return placed.withColumn("bucket", F.col("__range").cast("int")).drop("__key", "__range"), bounds


#: Rows of a few numbers that a join may broadcast; more are shuffled.
_FEW_ROWS = 20_000


def by_number(df: DataFrame, rows: int) -> DataFrame:
    """`df`, of so many rows at most, as a side of a join, with the way of joining that this number asks for.

    Spark sizes a table by its compressed files, and rows that an `explode` makes of it not at all. So it may broadcast
    tables of millions of rows, which the driver has to hold.
    """
    return F.broadcast(df) if rows <= _FEW_ROWS else shuffled(df)


#: Kinds whose shares travel in a broadcast table; more are joined plainly.
_MOST_KINDS = 10_000


def sample_rows(rows: DataFrame, keys: list[str], kind: str | None, per_kind: int) -> DataFrame:
    """About `per_kind` rows of each value of `kind` (all different ones, where there are fewer), or of all rows, chosen by a
    hash of `keys`.

    The bound is the documented size of a classifier's training sample. Rows with equal keys are one row, so neither
    copies nor rows that share an id can exceed it. The number of different rows of each kind decides its share,
    so the choice is a filter, not a sort, and is the same in every run. A null kind is passed over.
    """
    place = F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys], F.lit("sample"))
    name, share = free_name(rows, "place"), free_name(rows, "share")
    at = F.pmod(F.col(name), F.lit(1 << 30)) / float(1 << 30)
    if kind is None:
        placed = rows.withColumn(name, place)
        n = placed.agg(F.approx_count_distinct(name, 0.02).alias("n")).first()["n"]
        return placed.where(at < min(1.0, per_kind / max(n, 1))).dropDuplicates([name]).select(rows.columns)
    placed = rows.where(F.col(kind).isNotNull()).withColumn(name, place)
    counts = placed.groupBy(F.col(kind).alias("sample_kind")).agg(F.approx_count_distinct(name, 0.02).alias("n"))
    counts = materialize(counts.select("sample_kind", F.least(F.lit(1.0), F.lit(float(per_kind)) / F.col("n")).alias(share)), "shares")
    if counts.count() <= _MOST_KINDS:
        counts = F.broadcast(counts)
    kept = placed.join(counts, F.col(kind) == F.col("sample_kind")).where(at < F.col(share))
    return kept.dropDuplicates([kind, name]).select(rows.columns)


def rows_of_ids(rows: DataFrame, id_col: str, most: int) -> DataFrame:
    """At most `most` rows of each id, those of least hash: bounds what a sample of ids brings along."""
    name = free_name(rows, "rank")
    by = Window.partitionBy(id_col).orderBy(F.xxhash64(*[c for c in rows.columns if c != id_col]))
    return rows.withColumn(name, F.row_number().over(by)).where(F.col(name) <= most).drop(name)


__all__ = [
    "by_number", "configure", "free_name", "in_order", "load", "materialize", "narrow", "partitions", "remainder",
    "rows_of_ids", "sample_rows", "shuffled",
]
