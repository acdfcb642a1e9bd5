"""Daily release ledger: feeds -> open records -> hard filter -> decisions -> accepted information."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curator.operators.filters import filter_releases
from curator.operators.joins import merge_backfill, needs_processing
from curator.operators.sets import merge_accepted, union_sources
from curator.operators.validation import validate_decisions
from curator.operators.windows import latest

_RECORD = (
    "release_key", "source_id", "repository", "release_tag", "title", "release_notes_text", "url", "published_at", "item_type", "prerelease",
)


@dataclass(frozen=True)
class ReleaseDay:
    """Tables of one run, all lazy."""

    queue: DataFrame
    entries: DataFrame
    violations: DataFrame
    accepted: DataFrame


def open_records(records: DataFrame, log: DataFrame, sources: DataFrame) -> DataFrame:
    """Records the ledger has not settled, with policy version and content hash.

    log: release_key, seq, status, policy_version, content_hash; the last entry
    of a key is its state.
    """
    state = latest(log, ["release_key"], ["seq"])
    bound = records.withColumn("content_hash", F.sha2("release_notes_text", 256)).join(
        sources.select("repository", "policy_version").dropDuplicates(["repository"]), "repository"
    )
    return needs_processing(bound, state, "release_key")


def release_day(
    feed: DataFrame, sources: DataFrame, log: DataFrame, decisions: DataFrame, prior: DataFrame,
    backfill: DataFrame | None = None, advisories: DataFrame | None = None,
) -> ReleaseDay:
    """One run over parsed records.

    feed, backfill: release records (see sources.releases); advisories: the same
    with `qualifies` and `withdrawn_at`; sources: source_id, repository,
    policy_version, accepted_tag_patterns, excluded_tag_patterns; decisions:
    release_key, decision, change_types, changes, decision_reason; prior:
    release_key of information accepted before.
    """
    records = feed.select(*_RECORD)
    if backfill is not None:
        records = merge_backfill(records, backfill.select(*_RECORD), ["release_key"]).drop("from_feed")
    judged = filter_releases(
        open_records(records, log, sources).withColumnRenamed("release_notes_text", "notes"), sources
    ).withColumn("status", F.when(F.col("eligible"), "pending_review").otherwise("filtered"))
    if advisories is not None:
        withdrawn = F.coalesce(F.col("withdrawn_at"), F.lit("")) != ""
        notices = open_records(advisories, log, sources).withColumn(
            "status", F.when(withdrawn, "withdrawn").when(~F.col("qualifies"), "no_longer_qualifying").otherwise("pending_review")
        ).withColumn("reasons", F.when(F.col("status") == "withdrawn", F.array(F.lit("advisory_withdrawn"))).when(
            F.col("status") == "no_longer_qualifying", F.array(F.lit("no_longer_qualifying"))
        ).otherwise(F.array().cast("array<string>")))
        judged = union_sources(judged, notices.withColumnRenamed("release_notes_text", "notes").drop("qualifies", "withdrawn_at", "severity"))
    kept = ("release_key", "source_id", "repository", "release_tag", "url", "published_at", "notes", "policy_version", "content_hash", "item_type", "status", "reasons")
    judged = judged.select(*kept)
    queue = judged.where("status = 'pending_review'")
    relevant = decisions.join(queue.select("release_key"), "release_key", "left_semi")
    settled = queue.drop("status", "reasons").join(relevant.select("release_key", "decision", "decision_reason"), "release_key").select(
        *[c for c in kept if c not in ("status", "reasons")],
        F.when(F.col("decision") == "accept", "accepted").otherwise("rejected").alias("status"),
        F.when(F.col("decision") == "accept", F.array().cast("array<string>")).otherwise(F.array("decision_reason")).alias("reasons"),
    )
    return ReleaseDay(
        queue=queue,
        entries=judged.unionByName(settled),
        violations=validate_decisions(relevant, queue),
        accepted=merge_accepted(prior.select("release_key"), relevant, "release_key"),
    )
