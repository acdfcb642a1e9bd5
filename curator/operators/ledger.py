"""The observation ledger: append, candidate query, due periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from curator import constants as K
from curator.functions.times import event_bounds, local_date, local_time, period_window
from curator.operators import commits
from curator.operators.filters import period_eligible
from curator.operators.scoring import dedup_verdict
from curator.operators.topk import page
from curator.operators.windows import event_candidates, representative
from curator.runtime import materialize


def new_entries(batch: DataFrame, log: DataFrame, key: str, content_hash: str) -> tuple[DataFrame, DataFrame]:
    """(rows to append, conflicts): the same key and hash is a replay, the same key with another hash a conflict,
    whether the other one is in the log or in the batch itself. Replays inside the batch are appended once; their
    other columns are those of the least row.
    """
    rest = [F.col(c) for c in batch.columns if c not in (key, content_hash)]
    once = batch.groupBy(key, content_hash).agg(F.min(F.struct(*rest)).alias("_rest")) if rest else batch.distinct()
    once = once.select(*[F.col("_rest")[c].alias(c) if c not in (key, content_hash) else F.col(c) for c in batch.columns])
    # The hash that a key must have: the log's where it is known, else the least one of the batch.
    held = log.select(key, F.col(content_hash).alias("_held")).distinct()
    first = once.groupBy(key).agg(F.min(content_hash).alias("_first"))
    joined = once.join(first, key).join(held, key, "left")
    conflicts = joined.where(~F.col(content_hash).eqNullSafe(F.coalesce("_held", "_first"))).select(
        key, content_hash, F.coalesce("_held", "_first").alias("recorded_hash")).distinct()
    fresh = joined.where("_held is null").drop("_held", "_first")
    return fresh, conflicts


#: Times that an append starts over because another writer was first.
_APPEND_ATTEMPTS = 20


def read_state(spark: SparkSession, path: str, schema: StructType, version: int | None = None) -> DataFrame:
    """The log at `path` as of a version (the last one by default)."""
    return commits.read(spark, path, schema, version)


def append_state(batch: DataFrame, path: str, key: str, content_hash: str) -> int:
    """Append what is new to the versioned log at `path`; fail on a conflict, in the log or inside the batch.

    Check and append are one step: the batch is judged against a version and committed as the next one. If another
    writer was first, the batch is judged again with its rows, so of two writers with different content for a key one
    fails. A writer that is lost before its commit leaves nothing that `read_state` shows.
    """
    spark = batch.sparkSession
    batch = materialize(batch, "batch")
    for _ in range(_APPEND_ATTEMPTS):
        version = commits.current(spark, path)
        fresh, conflicts = new_entries(batch, read_state(spark, path, batch.schema, version), key, content_hash)
        clash = conflicts.limit(1).collect()
        if clash:
            raise ValueError(f"{key} {clash[0][key]!r} already exists with different content")
        folder = commits.new_folder()
        fresh.write.parquet(f"{path}/{folder}")
        added = spark.read.schema(batch.schema).parquet(f"{path}/{folder}").count()
        if not added or commits.commit(spark, path, version + 1, [*commits.folders(spark, path, version), folder]):
            return added
    raise RuntimeError(f"{path}: other writers were first {_APPEND_ATTEMPTS} times")


def first_discoveries(obs: DataFrame) -> DataFrame:
    return obs.groupBy("canonical_url").agg(F.min("discovered_at").alias("first_discovered_at"))


def period_label(first_discovered: Column, start: Column, end: Column) -> Column:
    """new / carried / backfilled, by where the first discovery lies."""
    day = local_date(first_discovered)
    return (
        F.when(day < start, F.lit(K.PERIOD_LABELS["carried"])).when(day > end, F.lit(K.PERIOD_LABELS["backfilled"]))
        .otherwise(K.PERIOD_LABELS["new"])
    )


def candidate_query(obs: DataFrame, history: DataFrame, ranking_type: str, period: str) -> tuple[DataFrame, DataFrame]:
    """(candidates, events) of one period, with publication history applied.

    obs: obs_id, canonical_url, kind, evidence_status, discovered_at,
    verified_at, collected_at, event_id, event_url, occurred_at, occurred_on,
    page_url (event form of the candidate's own URL), evidence[] (event form);
    history: see scoring.dedup_verdict, of the same ranking level.

    One set-based plan over all identities: first discovery, eligibility, one
    effective record per event, history verdict, one representative per identity.
    """
    w = period_window(F.lit(period), ranking_type)
    start, end = w["start_date"], w["end_date"]
    first = first_discoveries(obs)
    # Once an article's event is verified, its undated discovery follows that event.
    verified_news = obs.where("kind = 'news' and evidence_status = 'verified' and event_url is not null").groupBy(
        "canonical_url", F.col("event_url").alias("page_url")
    ).agg(
        F.max_by(F.struct("evidence_status", "occurred_at", "occurred_on", "event_url", "evidence"), F.struct("collected_at", "obs_id")).alias("_v")
    )
    joined = obs.join(first, "canonical_url").join(verified_news, ["canonical_url", "page_url"], "left")
    follows = (F.col("kind") == "news") & F.col("event_url").isNull() & F.col("_v").isNotNull()
    pick = lambda c: F.when(follows, F.col(f"_v.{c}")).otherwise(F.col(c))
    eligible = joined.where(period_eligible(
        F.col("kind"), pick("evidence_status"), pick("occurred_at"), pick("occurred_on"), pick("event_url"), pick("evidence"),
        F.col("first_discovered_at"), start, end,
    )).drop("_v", "first_discovered_at")
    return _judged_candidates(obs, eligible, history, start, end)


def window_candidates(obs: DataFrame, since: Column, until: Column) -> tuple[DataFrame, DataFrame]:
    """(candidates, events) of a span of collection dates, both ends included, without publication history.

    An identity takes part if any of its observations was collected in the span; all that were collected up to its
    end count. obs: as for `candidate_query`.
    """
    day = local_date(F.col("collected_at"))
    active = obs.where(day.between(since, until)).select("canonical_url").distinct()
    seen = obs.join(active, "canonical_url", "left_semi")
    return _judged_candidates(seen, seen.where(day <= until), None, since, until)


def _judged_candidates(obs: DataFrame, eligible: DataFrame, history: DataFrame | None, start: Column, end: Column) -> tuple[DataFrame, DataFrame]:
    """One effective record per event with its status, and one representative per identity."""
    keyed = eligible.withColumn(
        "event_key", F.coalesce("event_url", F.when(F.col("kind") == "news", F.col("page_url")), F.lit(""))
    )
    # Candidates are read by several joins and a scan; computing them is the costly part.
    effective = materialize(event_candidates(keyed, ["canonical_url", "kind", "event_key"]), "candidates")
    named = effective.withColumn("row_id", F.concat_ws("|", "canonical_url", "kind", "event_key")).withColumn(
        "reported_url", F.coalesce("event_url", F.when(F.col("kind") == "news", F.col("page_url")))
    ).withColumn("earliest", event_bounds("occurred_at", "occurred_on")["earliest"])
    judged = named.withColumn("selection_block", F.lit(None).cast("string")) if history is None else dedup_verdict(named, history)
    events = judged.withColumn(
        "selection_status",
        F.when(F.col("selection_block").isNotNull(), "blocked").when(F.col("last_verified_at").isNotNull(), "available").otherwise("needs_evidence"),
    ).drop("row_id", "reported_url", "earliest")
    rolled = obs.groupBy("canonical_url").agg(F.max("collected_at").alias("last_collected_at"), F.min("discovered_at").alias("first_discovered_at"))
    best = representative(events, ["canonical_url"]).join(rolled, "canonical_url")
    return best.withColumn("period_label", period_label(F.col("first_discovered_at"), start, end)), events


def candidate_page(candidates: DataFrame, limit: int = 80, offset: int = 0) -> DataFrame:
    """One review page of the candidates that nothing blocks, by canonical URL (a stable order, not a value)."""
    if not (1 <= limit <= 1000 and offset >= 0):
        raise ValueError("limit must be 1 to 1000 and offset 0 or more")
    return page(candidates.where("selection_status <> 'blocked'"), ["canonical_url"], offset, limit)


def blocked_candidates(candidates: DataFrame) -> DataFrame:
    """The candidates that history blocks, compact; they never take up the review limit."""
    return candidates.where("selection_status = 'blocked'").select("canonical_url", "kind", "event_key", "selection_status", "selection_block")


def candidate_counts(candidates: DataFrame) -> DataFrame:
    """One row: total, eligible, available, needs_evidence and blocked candidates."""
    status = F.col("selection_status")
    return candidates.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(status != "blocked").alias("eligible"), F.count_if(status == "available").alias("available"),
        F.count_if(status == "needs_evidence").alias("needs_evidence"), F.count_if(status == "blocked").alias("blocked"))


def candidate_sources(candidates: DataFrame, obs: DataFrame) -> DataFrame:
    """canonical_url, source_url: all source URLs of each candidate's observations, one row each. obs: canonical_url, source_urls[]."""
    each = obs.select("canonical_url", F.explode("source_urls").alias("source_url")).distinct()
    return each.join(candidates.select("canonical_url").distinct(), "canonical_url", "left_semi")


def due_periods(now: Column, issues: DataFrame, drafts: DataFrame) -> DataFrame:
    """The latest complete period per level: is it due, archived, drafted?

    issues: ranking_type, period; drafts: ranking_type, period.
    """
    spark = issues.sparkSession
    today = F.to_date(local_time(now))
    names = {
        "daily": F.date_format(F.date_sub(today, 1), "yyyy-MM-dd"),
        "weekly": F.date_format(F.date_sub(F.to_date(F.date_trunc("week", today)), 7), "yyyy-MM-dd"),
        "monthly": F.date_format(F.add_months(today, -1), "yyyy-MM"),
    }
    cycles = None
    for level, name in names.items():
        row = spark.range(1).select(F.lit(level).alias("ranking_type"), name.alias("period"))
        row = row.select("*", period_window("period", level).alias("w"))
        cycles = row if cycles is None else cycles.unionByName(row)
    have = lambda df, flag: df.select("ranking_type", "period").distinct().withColumn(flag, F.lit(True))
    keys = ["ranking_type", "period"]
    joined = cycles.join(have(issues, "archived"), keys, "left").join(have(drafts, "has_draft"), keys, "left")
    flags = joined.select(
        *keys, "w.start_date", "w.end_date", "w.due_at",
        F.coalesce("archived", F.lit(False)).alias("archived"), F.coalesce("has_draft", F.lit(False)).alias("has_draft"),
    )
    return flags.withColumn("due", (F.col("due_at") <= now) & ~F.col("archived"))


def dispatch(now: Column, issues: DataFrame, drafts: DataFrame) -> DataFrame:
    """Actions of the current hour: generate a due level, or collect and backfill.

    drafts additionally holds item_count.
    """
    moment = local_time(now)
    hour, day = F.hour(moment), F.to_date(moment)
    slot = {
        "daily": hour == K.DUE_HOURS["daily"],
        "weekly": (hour == K.DUE_HOURS["weekly"]) & (F.weekday(day) == 0),
        "monthly": (hour == K.DUE_HOURS["monthly"]) & (F.dayofmonth(day) == 1),
    }
    in_slot = F.lit(False)
    for level, condition in slot.items():
        in_slot = in_slot | ((F.col("ranking_type") == level) & condition)
    generate = due_periods(now, issues, drafts).where(F.col("due") & in_slot).select(
        F.lit("generate").alias("action"), "ranking_type", "period", F.lit(None).cast("long").alias("shortfall")
    )
    evening = hour == K.COLLECT_HOUR
    collect = issues.sparkSession.range(1).where(evening).select(
        F.lit("collect").alias("action"), F.lit(None).cast("string").alias("ranking_type"), day.cast("string").alias("period"), F.lit(None).cast("long").alias("shortfall")
    )
    waiting = drafts.where(evening & (F.col("ranking_type") == "monthly") & (period_window("period", "monthly")["due_at"] <= now))
    oldest = waiting.agg(F.min(F.struct("period", "item_count")).alias("o")).where("o is not null").select(
        F.lit("backfill_monthly").alias("action"), F.lit("monthly").alias("ranking_type"), F.col("o.period").alias("period"),
        F.greatest(F.lit(0), 20 - F.col("o.item_count")).cast("long").alias("shortfall"),
    )
    return generate.unionByName(collect).unionByName(oldest)
