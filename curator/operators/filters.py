"""Predicates that keep every reason for a rejection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curator.constants import PRERELEASE
from curator.functions.expr import reasons
from curator.functions.times import event_in_period, local_date


def _any_match(patterns: Column, text: Column, whole: bool) -> Column:
    """Does any regular expression of the array match (fully, if `whole`)?"""
    if whole:
        return F.exists(patterns, lambda p: F.regexp_like(text, F.concat(F.lit("(?i)^(?:"), p, F.lit(")$"))))
    return F.exists(patterns, lambda p: F.regexp_like(text, F.concat(F.lit("(?i)"), p)))


def filter_releases(releases: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds reasons[] and eligible to releases of registered sources.

    releases: source_id, release_tag, prerelease, url, published_at, notes;
    sources: source_id, accepted_tag_patterns[], excluded_tag_patterns[].
    """
    tag = F.col("release_tag")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    joined = releases.join(sources.select("source_id", "accepted_tag_patterns", "excluded_tag_patterns"), "source_id")
    judged = joined.withColumn(
        "reasons",
        reasons(
            (F.coalesce("prerelease", F.lit(False)) | tag.rlike(PRERELEASE), "prerelease_tag"),
            (~_any_match(F.col("accepted_tag_patterns"), tag, True), "tag_not_allowed"),
            (_any_match(F.col("excluded_tag_patterns"), tag, False), "tag_excluded"),
            (blank("url") | blank("published_at") | blank("notes"), "incomplete_release"),
        ),
    )
    return judged.withColumn("eligible", F.size("reasons") == 0).drop("accepted_tag_patterns", "excluded_tag_patterns")


def window_state(published_at: Column, now: Column, hours: Column | int) -> Column:
    """'future', 'outside', 'unknown' or 'inside' the collection window."""
    hours = F.lit(hours) if isinstance(hours, int) else hours
    start = F.unix_micros(now) - hours.cast("long") * 3_600_000_000
    return (
        F.when(published_at.isNull(), F.lit("unknown"))
        .when(published_at > now, F.lit("future"))
        .when(F.unix_micros(published_at) < start, F.lit("outside"))
        .otherwise("inside")
    )


def window_filter(df: DataFrame, published_at: str, now: Column, hours: int) -> DataFrame:
    """Rows inside the window; an unknown date is kept for later review.

    Plain comparisons, so that a constant window is filtered in the scan.
    """
    at = F.col(published_at)
    return df.where(at.isNull() | ((at <= now) & (at >= now - F.expr(f"INTERVAL {hours} HOURS"))))


def period_eligible(
    kind: Column, evidence_status: Column, occurred_at: Column, occurred_on: Column, event_url: Column,
    evidence_event_urls: Column, first_discovered: Column, start: Column, end: Column,
) -> Column:
    """May a record be considered for the period [start, end]?

    News belongs to the period of its event. A late discovery needs an event
    inside the period whose own page is among the evidence.
    """
    from curator.functions.times import event_bounds

    has_event = event_url.isNotNull()
    inside = event_in_period(occurred_at, occurred_on, start, end)
    begins = local_date(event_bounds(occurred_at, occurred_on)["earliest"])
    in_time = local_date(first_discovered) <= end
    proven = has_event & inside & F.array_contains(evidence_event_urls, event_url)
    return F.coalesce(
        F.when((kind == "news") & ~has_event, evidence_status == "discovered")
        .when((kind == "news") & ~inside, F.lit(False))
        .when(has_event & (begins > end), F.lit(False))
        .otherwise(in_time | proven),
        F.lit(False),
    )


# Why a candidate isn't eligible.
_UNVERIFIED = "original-source verification has not been recorded in the digest ledger"
_NO_CONTEXT = "no readable original-source context was supplied for scoring"
_MORE_EVIDENCE = "digest candidate requires further evidence"
_BLOCKED = "same-level or period eligibility blocked"


def eligibility(block: Column, selection_status: Column, evidence_status: Column, has_context: Column) -> Column:
    """STRUCT<state, reasons> before publication: blocked, needs_evidence or available."""
    blocked = F.coalesce((F.coalesce(block, F.lit("")) != "") | (selection_status == "blocked"), F.lit(False))
    unverified = F.coalesce(evidence_status != "verified", F.lit(True))
    missing = reasons(
        (unverified, _UNVERIFIED),
        (~has_context, _NO_CONTEXT),
        ((selection_status == "needs_evidence") & ~unverified & has_context, _MORE_EVIDENCE),
    )
    why = F.when(blocked, F.array(F.coalesce(F.nullif(block, F.lit("")), F.lit(_BLOCKED)))).otherwise(missing)
    state = F.when(blocked, F.lit("blocked")).when(F.size(missing) > 0, F.lit("needs_evidence")).otherwise("available")
    return F.struct(state.alias("state"), why.alias("reasons"))


def source_risk(redirected_fork: Column, archived: Column, license_id: Column, recognized: Column) -> Column:
    """STRUCT<learning_only, reasons> of a repository's provenance."""
    known = F.when(~license_id.isin("", "NOASSERTION", "OTHER"), license_id)
    why = reasons(
        (redirected_fork, "fork_redirected_to_upstream"),
        (archived, "archived_repository"),
        (known.isNull(), "license_unknown"),
        (known.isNotNull() & (F.size(recognized) > 0) & ~F.array_contains(recognized, known), "license_requires_review"),
    )
    serious = F.array(*[F.lit(x) for x in ("archived_repository", "license_unknown", "license_requires_review")])
    return F.struct(F.arrays_overlap(why, serious).alias("learning_only"), why.alias("reasons"))


def is_fresh(verified_at: Column, prepared_at: Column, period_start: Column, hours: int = 24) -> Column:
    """Verified before preparation, within `hours`, and not before the period."""
    age = F.unix_micros(prepared_at) - F.unix_micros(verified_at)
    return F.coalesce(
        (age >= 0) & (age <= hours * 3_600_000_000) & (local_date(verified_at) >= period_start), F.lit(False)
    )


def linked_stories(members: DataFrame, stories: DataFrame) -> DataFrame:
    """Stories with at least one linked item. members: cluster_id, url, source_links."""
    linked = members.where((F.col("url") != "") | (F.size("source_links") > 0)).select("cluster_id")
    return stories.join(linked, "cluster_id", "left_semi")


def ranking_gate(good_sources: DataFrame, linked: DataFrame, minimum: int = 3) -> DataFrame:
    """One row: may the run be published, and if not, why?"""
    counts = good_sources.agg(F.count_distinct("source_id").alias("good_sources")).withColumn(
        "linked_events", linked.agg(F.count(F.lit(1))).scalar()
    )
    why = reasons(
        (F.col("good_sources") < minimum, F.format_string("only %d sources succeeded", "good_sources")),
        (F.col("linked_events") == 0, "no candidate events with source links"),
    )
    return counts.withColumn("failure_reason", F.array_join(why, "; ")).withColumn("passed", F.size(why) == 0)


def success_days(log: DataFrame, key: str, at: str, days: int) -> DataFrame:
    """key, _ask, _before, _same: what a row of day `_ask` must know of the log, one row per key and day.

    `_before` is the last success of the `days` days before, `_same` the first one of the day itself.
    """
    moment = F.unix_micros(at)
    success = log.groupBy(key, F.to_date(at).alias("_day")).agg(F.max(moment).alias("_last"), F.min(moment).alias("_first"))
    return success.withColumn("_ask", F.explode(F.sequence("_day", F.date_add("_day", days)))).groupBy(key, "_ask").agg(
        F.max(F.when(F.col("_day") < F.col("_ask"), F.col("_last"))).alias("_before"),
        F.min(F.when(F.col("_day") == F.col("_ask"), F.col("_first"))).alias("_same"),
    )


def cooled_down(df: DataFrame, log: DataFrame, key: str, at: str, days: int) -> DataFrame:
    """Rows whose key had no success in the `days` days up to their time.

    The log is reduced to one row per key and day before it is joined, so a busy
    key costs its rows once and nothing is multiplied.
    """
    return unblocked(df, success_days(log, key, at, days), key, at, days)


def unblocked(df: DataFrame, near: DataFrame, key: str, at: str, days: int) -> DataFrame:
    """Rows that nothing in `near` (see `success_days`) blocks; `df` may be a stream."""
    width = days * 86_400_000_000
    moment = F.unix_micros(at)
    blocked = (moment - F.col("_before") <= width) | (F.col("_same") < moment)
    joined = df.withColumn("_ask", F.to_date(at)).join(near, [key, "_ask"], "left")
    return joined.where(~F.coalesce(blocked, F.lit(False))).select(*df.columns)
