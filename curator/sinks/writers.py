"""Run artifacts: dated JSON output, manifests, retention and snapshot audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_run(df: DataFrame, path: str, dt: str, status: str = "success") -> None:
    """Replace the output of one date; a failed run replaces it with an empty result.

    Only the partition of `dt` is overwritten. The status row is always written,
    so that a stale success cannot survive a failure.
    """
    spark = df.sparkSession
    body = df if status == "success" else df.limit(0)
    body.write.mode("overwrite").json(f"{path}/rows/dt={dt}")
    spark.range(1).select(F.lit(dt).alias("date"), F.lit(status).alias("exit_status")).write.mode("overwrite").json(f"{path}/status/dt={dt}")


def run_manifest(sources: DataFrame, stages: dict[str, DataFrame], gaps: DataFrame | None = None, review_error: str | None = None) -> DataFrame:
    """One row: stage counts and the run's status.

    sources: source_id, error (null = success). Status ladder: review_failed,
    failed (no source succeeded), partial (a failure or an open gap), success.
    """
    counts = sources.agg(
        F.count_if(F.col("error").isNull()).alias("successful_sources"), F.count_if(F.col("error").isNotNull()).alias("failed_sources")
    )
    for name, stage in stages.items():
        counts = counts.withColumn(f"{name}_count", stage.agg(F.count(F.lit(1))).scalar())
    open_gaps = F.lit(0).cast("long")
    if gaps is not None:
        counts = counts.withColumn("known_gaps", gaps.agg(F.count(F.lit(1))).scalar())
        open_gaps = F.col("known_gaps")
    status = (
        F.when(F.lit(review_error is not None), "review_failed").when(F.col("successful_sources") == 0, "failed")
        .when((F.col("failed_sources") > 0) | (open_gaps > 0), "partial").otherwise("success")
    )
    return counts.withColumn("status", status).withColumn("review_error", F.lit(review_error))


def expired_partitions(partitions: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Dated partitions older than `days` before `as_of`; names that are no date stay.

    partitions: name.
    """
    return partitions.where(F.col("name").try_cast("date") < F.date_sub(as_of, days))


def audit_snapshot(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """State of every path: ok, changed, missing or unlisted.

    manifest: path, bytes, sha256; files: path, bytes, sha256 as found.
    """
    m = manifest.select("path", F.col("bytes").alias("_mb"), F.col("sha256").alias("_ms"))
    f = files.select("path", F.col("bytes").alias("_fb"), F.col("sha256").alias("_fs"))
    state = (
        F.when(F.col("_ms").isNull(), "unlisted").when(F.col("_fs").isNull(), "missing")
        .when((F.col("_mb") != F.col("_fb")) | (F.col("_ms") != F.col("_fs")), "changed").otherwise("ok")
    )
    return m.join(f, "path", "full_outer").select("path", state.alias("state"))


def snapshot_files(spark, path: str, root: str = "") -> DataFrame:
    """path, bytes, sha256 of the files below `path`."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        F.regexp_replace("path", f"^(?:file:)?/*{root}/*" if root else "^$", "").alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")
    )


def export_state(expected: DataFrame, files: DataFrame) -> DataFrame:
    """State of exported documents against the ledger's text hashes.

    expected: path, sha256, previous_sha256 (drafts only, else null), tracked;
    files: path, sha256. A file nobody expects is an orphan.
    """
    e = expected.select("path", F.col("sha256").alias("_e"), F.col("previous_sha256").alias("_p"), "tracked", F.lit(True).alias("_known"))
    f = files.select("path", F.col("sha256").alias("actual_sha256"))
    actual = F.col("actual_sha256")
    state = (
        F.when(F.col("_known").isNull(), "orphan").when(~F.col("tracked"), "legacy_untracked").when(actual.isNull(), "missing")
        .when(actual == F.col("_e"), "ok").when(actual == F.col("_p"), "previous_revision").otherwise("conflict")
    )
    return e.join(f, "path", "full_outer").select("path", state.alias("state"))
