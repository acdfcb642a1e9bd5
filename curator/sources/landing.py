"""Landed snapshots, receipts, manifests and event logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curator.functions.ids import canonical_hash


def config_hash(registry: DataFrame, settings: dict[str, str]) -> DataFrame:
    """One row with the hash of all sources and settings.

    Sources are hashed one by one; the registry itself is a short table.
    """
    each = registry.select("ord", canonical_hash({c: F.col(c).cast("string") for c in registry.columns}).alias("h"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "h"))), lambda x: x["h"]), "\n")
    tail = "\n".join(f"{k}={settings[k]}" for k in sorted(settings))
    return each.agg(F.sha2(F.concat(text, F.lit("\n" + tail)), 256).alias("config_hash"))


def land_or_replay(registry: DataFrame, landed: DataFrame, dt: str, config: Column | str) -> DataFrame:
    """Sources of a run with action 'reuse' or 'fetch'.

    landed: dt, source_id, config_hash, status, body. Raw payloads are reused
    only if every registered source has a good one of this date and this
    configuration, so that a replay is complete or does not happen.
    """
    config = F.lit(config) if isinstance(config, str) else config
    good = landed.where((F.col("dt") == dt) & (F.col("status") == "ok") & (F.col("config_hash") == config)).select("source_id", "body")
    joined = registry.join(good, "source_id", "left")
    absent = joined.agg(F.count_if(F.col("body").isNull())).scalar()
    return joined.withColumn("action", F.when(absent == 0, "reuse").otherwise("fetch")).withColumn(
        "body", F.when(F.col("action") == "reuse", F.col("body"))
    )


def latest_receipts(fetch_log: DataFrame, key: Sequence[str] = ("url",)) -> DataFrame:
    """The valid saved response of every URL.

    fetch_log: url, checked_at, fetch_id, http_status (null = failed), sha256,
    fetched_at. A 304 after a saved body renews the check time but keeps the
    body and its original fetch time; failures never replace anything.
    """
    body = F.col("http_status") == 200
    stamp = F.struct("checked_at", "fetch_id")
    last_body = F.max(F.when(body, F.struct("checked_at", "fetch_id", "sha256", "fetched_at")))
    renewed = F.max(F.when(F.col("http_status") == 304, stamp))
    grouped = fetch_log.groupBy(*key).agg(last_body.alias("b"), renewed.alias("r")).where("b is not null")
    later = F.col("r").isNotNull() & (F.struct("r.checked_at", "r.fetch_id") > F.struct("b.checked_at", "b.fetch_id"))
    return grouped.select(
        *key, F.col("b.sha256").alias("sha256"), F.col("b.fetched_at").alias("fetched_at"),
        F.when(later, F.col("r.checked_at")).otherwise(F.col("b.checked_at")).alias("checked_at"),
        F.when(later, "revalidated").otherwise("fetched").alias("cache_status"),
    )


EVENT_LOG = T.StructType([
    *[T.StructField(n, T.StringType()) for n in (
        "event", "recorded_at", "run_id", "repository", "entry_mode", "status", "feedback", "relation_id", "error_class", "attempt_sha256", "commit_sha", "result_sha256",
    )],
    T.StructField("discovery_metrics", T.StructType([
        *[T.StructField(n, T.IntegerType()) for n in (
            "search_query_count", "screened_candidate_count", "deep_read_count", "direct_candidate_count", "adjacent_candidate_count",
        )],
        T.StructField("selected_repository", T.StringType()),
    ])),
    T.StructField("watch_state", T.StructType([
        T.StructField("enabled", T.BooleanType()), T.StructField("repository", T.StringType()),
        T.StructField("last_checked_commit_sha", T.StringType()), T.StructField("last_checked_at", T.StringType()),
    ])),
])


def read_event_log(spark: SparkSession, path: str, schema: T.StructType = EVENT_LOG) -> DataFrame:
    """JSON Lines log; blank lines are skipped, any other line must be an object.

    The first malformed line fails the read.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    checked = F.when(F.trim("value").startswith("{") & F.try_parse_json("value").isNotNull(), F.col("value")).otherwise(
        F.raise_error(F.concat(F.lit("event log line is not a JSON object: "), F.substring("value", 1, 80)))
    )
    return lines.select(F.from_json(checked, schema).alias("e")).select("e.*")


MANIFEST = T.StructType([
    T.StructField("status", T.StringType()), T.StructField("successful_sources", T.ArrayType(T.StringType())),
    T.StructField("known_gaps", T.ArrayType(T.StructType([T.StructField("source_id", T.StringType()), T.StructField("reason", T.StringType())]))),
    T.StructField("dt", T.DateType()),
])


def read_manifests(spark: SparkSession, root: str, start: str, days: int, multi_line: bool = True) -> DataFrame:
    """Run manifests of a date window from `root/dt=YYYY-MM-DD/`; absent days are absent rows.

    The window filters the partition column, so other days are not read.
    """
    first = F.lit(start).cast("date")
    return spark.read.schema(MANIFEST).json(root, multiLine=multi_line).where((F.col("dt") >= first) & (F.col("dt") < F.date_add(first, days)))


def manifest_days(manifests: DataFrame) -> DataFrame:
    """source_id, day, gapped: the input of the trial metrics."""
    gaps = F.transform(F.coalesce("known_gaps", F.array().cast(MANIFEST["known_gaps"].dataType)), lambda g: g["source_id"])
    return manifests.select(F.col("dt").alias("day"), F.explode("successful_sources").alias("source_id"), gaps.alias("_g")).select(
        "source_id", "day", F.array_contains("_g", F.col("source_id")).alias("gapped")
    )
