"""Joins of records with registries, ledgers, decisions and quotations.

Registries are small dimension tables; they are joined without a hint, so Spark
broadcasts one only when its size is known to fit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curator.functions.text import normalize_evidence
from curator.operators.cells import cells
from curator.operators.ordered import ordered_scan


def with_source(df: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    return df.join(sources, key)


def map_advisories(advisories: DataFrame, sources: DataFrame) -> DataFrame:
    """The first registered source named by an advisory's location or packages.

    advisories: advisory_id, location, packages[]; sources: source_id, ord,
    repository, aliases[]. The disjunction is two equi joins, each with the first source of every key, so an advisory
    meets one row per key, however many sources share it.
    """
    home = F.concat(F.lit("https://github.com/"), F.col("repository"))
    clean = lambda c: F.regexp_replace(F.lower(c), r"/+$", "")
    first = lambda df: df.groupBy("_key").agg(F.min_by("source_id", "ord").alias("source_id"), F.min("ord").alias("ord"))
    by_home = first(sources.select(clean(home).alias("_key"), "ord", "source_id"))
    by_alias = first(sources.select(F.explode("aliases").alias("_a"), "ord", "source_id").select(F.lower("_a").alias("_key"), "ord", "source_id"))
    located = advisories.select("advisory_id", clean(F.col("location")).alias("_key")).join(by_home, "_key")
    packaged = advisories.select("advisory_id", F.explode("packages").alias("_p")).select("advisory_id", F.lower("_p").alias("_key")).join(by_alias, "_key")
    found = located.unionByName(packaged).groupBy("advisory_id").agg(F.min_by("source_id", "ord").alias("source_id"))
    return advisories.join(found, "advisory_id", "left")


def needs_processing(records: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """Records a ledger has not settled: unseen, under an older policy, pending
    or failed, or a security notice whose content changed.

    records: key, policy_version, item_type, content_hash; state: the latest
    entry per key (status, policy_version, content_hash).
    """
    known = state.select(
        key, F.col("status").alias("_status"), F.col("policy_version").alias("_policy"),
        F.col("content_hash").alias("_hash"), F.lit(True).alias("_seen"),
    )
    changed = (F.col("item_type") == "security") & ~F.col("content_hash").eqNullSafe(F.col("_hash"))
    open_again = (
        F.col("_seen").isNull() | ~F.col("policy_version").eqNullSafe(F.col("_policy"))
        | F.coalesce(F.col("_status").isin("pending_review", "review_failed"), F.lit(False)) | changed
    )
    return records.join(known, key, "left").where(open_again).drop("_status", "_policy", "_hash", "_seen")


def observations(obs: DataFrame, batches: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Observations with their batch, as known at `as_of`, gaps filled from the batch.

    obs: run_id, evidence_status, discovered_at, verified_at, verification_level;
    batches: run_id, collected_at.
    """
    if as_of is not None:
        batches = batches.where(F.col("collected_at") <= as_of)
    joined = obs.join(batches, "run_id")
    return joined.withColumns({
        "discovered_at": F.coalesce("discovered_at", "collected_at"),
        "verified_at": F.coalesce("verified_at", F.when(F.col("evidence_status") == "verified", F.col("collected_at"))),
        "verification_level": F.coalesce("verification_level", F.lit("documented")),
    })


def match_verified(items: DataFrame, obs: DataFrame) -> DataFrame:
    """Each issue item with the newest verified observation that covers it.

    Equal identity, kind, verification time, level and event; the item's
    evidence must be a subset of the observation's. No match leaves obs_id null,
    which is an error for the issue.
    items: item_id, canonical_url, kind, verified_at, level, event_key,
    evidence[]; obs: the same keys with obs_id, collected_at, evidence_status.
    Observations are first reduced to the newest of each event and evidence
    set, so a busy identity meets its different evidence sets only.
    """
    keys = ["canonical_url", "kind", "verified_at", "level"]
    side = obs.where("evidence_status = 'verified'").select(
        *keys, F.col("event_key").alias("_event"), F.array_sort(F.array_distinct("evidence")).alias("_evidence"), "obs_id", "collected_at"
    ).groupBy(*keys, "_event", "_evidence").agg(F.max(F.struct("collected_at", "obs_id")).alias("_o")).select(
        *keys, "_event", "_evidence", F.col("_o.obs_id").alias("obs_id"), F.col("_o.collected_at").alias("collected_at"))
    found = (
        items.join(side, keys)
        .where(F.col("event_key").eqNullSafe(F.col("_event")) & (F.size(F.array_except("evidence", "_evidence")) == 0))
        .groupBy("item_id").agg(F.max(F.struct("collected_at", "obs_id")).alias("_m"))
        .select("item_id", F.col("_m.obs_id").alias("obs_id"), F.col("_m.collected_at").alias("collected_at"))
    )
    return items.join(found, "item_id", "left")


def selection_history(selections: DataFrame, issues: DataFrame, level: str) -> DataFrame:
    """Published selections of one ranking level. selections: issue_id, ...; issues: issue_id, ranking_type, period, archived_at."""
    return selections.join(issues.where(F.col("ranking_type") == level), "issue_id")


def bind_quotes(refs: DataFrame, sources: DataFrame, key: str, normalized: bool = True) -> DataFrame:
    """References with a violation code: unknown source, or a quote it does not hold.

    refs: key, quote, ...; sources: key, text.
    """
    form = normalize_evidence if normalized else (lambda c: F.col(c))
    texts = sources.select(key, form("text").alias("_text"))
    quoted = refs.withColumn("_quote", form("quote"))
    code = (
        F.when(F.col("_text").isNull(), F.lit("unknown_source"))
        .when((F.col("_quote") == "") | ~F.contains("_text", "_quote"), F.lit("quote_not_found"))
    )
    return quoted.join(texts, key, "left").withColumn("violation", code).drop("_text", "_quote")


def match_decisions(queue: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Keys that are not decided exactly once: missing, unknown or duplicate."""
    counted = decisions.groupBy(key).agg(F.count(F.lit(1)).alias("decisions"))
    queued = queue.select(key).distinct().withColumn("_queued", F.lit(True))
    problem = (
        F.when(F.col("_queued").isNull(), F.lit("unknown"))
        .when(F.col("decisions").isNull(), F.lit("missing"))
        .when(F.col("decisions") > 1, F.lit("duplicate"))
    )
    return queued.join(counted, key, "full_outer").withColumn("problem", problem).where("problem is not null").select(
        key, "problem", F.coalesce("decisions", F.lit(0)).alias("decisions")
    )


def reason_passages(reasons: DataFrame, passages: DataFrame) -> DataFrame:
    """Each reason with each passage of a source it cites itself.

    reasons: unit_id, field, evidence_refs[]; passages: evidence_url, passage_id.
    A cited source without passages gives one row with a null passage.
    """
    cited = reasons.select("unit_id", "field", F.explode(F.array_distinct("evidence_refs")).alias("evidence_url"))
    return cited.join(passages.select("evidence_url", "passage_id"), "evidence_url", "left").withColumn(
        "missing_ref", F.col("passage_id").isNull()
    )


def overall_refs(reasons: DataFrame) -> DataFrame:
    """References an overall reason may rest on: those of its components."""
    return reasons.select("unit_id", F.explode("evidence_refs").alias("evidence_url")).distinct()


def match_feed_items(items: DataFrame, candidates: DataFrame) -> DataFrame:
    """Feed item of each candidate: same publisher and event URL, one stated date.

    items: publisher, event_url, raw_date, place; candidates: candidate_id,
    publisher, event_url. Items that disagree about the date match nobody.
    """
    agreed = items.groupBy("publisher", "event_url").agg(
        F.min_by("raw_date", "place").alias("raw_date"), F.min("place").alias("place"),
        F.min(F.coalesce("raw_date", F.lit("\x00"))).alias("_lo"), F.max(F.coalesce("raw_date", F.lit("\x00"))).alias("_hi"),
    ).where("_lo = _hi").drop("_lo", "_hi")
    return candidates.join(agreed, ["publisher", "event_url"])


def _path(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.replace(c, F.lit("\\"), F.lit("/"))), r"^/+|/+$", "")


def _path_suffix_join(observed: DataFrame, required: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs whose observed path equals the required path or ends with '/required'.

    An observed path is listed once for each folder it can be cut at, so the whole required path is the join key: a
    file name that every folder has meets nothing but its own path.
    """
    parts = F.split(_path(F.col("path")), "/")
    endings = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "/"))
    o = observed.withColumn("_ending", F.explode(endings)).drop("path")
    r = required.withColumn("_ending", _path(F.col("path"))).drop("path")
    return o.join(r, [*keys, "_ending"]).drop("_ending")


def match_evidence(pred: DataFrame, gold: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """Gold evidence that some predicted evidence hits.

    Same project and path suffix, then the same symbol or overlapping lines.
    Paths meet first, each distinct one once; only predictions under a path that is asked for are cut into cells. Their
    lines are masks per asked path and cell, so a busy file does not compare all of its ranges; the symbol is an equi key
    of its own. pred: keys, path, line_start, line_end, symbol; gold: gold_id, the same.
    """
    keys = list(keys)
    p = pred.select(*keys, _path(F.col("path")).alias("path"), "line_start", "line_end", F.col("symbol").alias("_symbol"))
    g = gold.select(*keys, _path(F.col("path")).alias("_asked_path"), "gold_id", "line_start", "line_end", F.col("symbol").alias("_symbol"))
    observed = p.select(*keys, "path").distinct().withColumn("_file", F.col("path"))
    met = _path_suffix_join(observed, g.select(*keys, F.col("_asked_path").alias("path")).distinct().withColumn("_asked_path", F.col("path")), keys)
    p = p.withColumnRenamed("path", "_file").join(met, [*keys, "_file"]).drop("_file")
    by_symbol = p.where("coalesce(_symbol, '') <> ''").select(*keys, "_asked_path", "_symbol").distinct().join(
        g.where("coalesce(_symbol, '') <> ''"), [*keys, "_asked_path", "_symbol"]).select("gold_id")
    touched = lambda df: df.withColumn("_c", F.explode(cells(F.col("line_start"), F.col("line_end")))).withColumn("_cell", F.col("_c.cell"))
    covered = touched(p).groupBy(*keys, "_asked_path", "_cell").agg(F.bit_or(F.col("_c.mask")).alias("_covered"))
    asked = touched(g).select(*keys, "_asked_path", "gold_id", "_cell", F.col("_c.mask").alias("_asked"))
    by_line = covered.join(asked, [*keys, "_asked_path", "_cell"]).where(
        F.col("_covered").bitwiseAND(F.col("_asked")) != 0
    ).select("gold_id")
    return by_symbol.unionByName(by_line).distinct()


def match_tests(pred: DataFrame, gold: DataFrame, keys: Sequence[str] = ("project_id", "selector")) -> DataFrame:
    """Required tests named by a prediction: same project, selector and path suffix."""
    return _path_suffix_join(pred.select(*keys, "path").distinct(), gold, keys).select("gold_id").distinct()


def evaluation_rows(cards: DataFrame, reviews: DataFrame, labels: DataFrame, split: str) -> DataFrame:
    """Cards with label and review, and why a card takes no part in the evaluation."""
    joined = cards.join(labels, "candidate_id", "left").join(reviews, "candidate_id", "left")
    excluded = (
        F.when(F.col("label").isNull(), F.lit("unlabelled"))
        .when(F.col("split") != split, F.lit("other_split"))
        .when(F.col("label") == "either", F.lit("either"))
        .when(F.col("decision").isNull(), F.lit("unreviewed"))
    )
    return joined.withColumn("excluded", excluded)


def missing_dates(runs: DataFrame, day: str, start: Column, end: Column) -> DataFrame:
    """Calendar dates of [start, end] on which nothing was collected."""
    spark = runs.sparkSession
    calendar = spark.range(1).select(F.explode(F.sequence(start, end)).alias("missing_date"))
    held = runs.where(F.col(day).between(start, end)).select(F.col(day).alias("missing_date")).distinct()
    return calendar.join(held, "missing_date", "left_anti")


def merge_backfill(feed: DataFrame, rest: DataFrame, key: Sequence[str]) -> DataFrame:
    """All keys of both tables; the feed's row wins."""
    columns = [c for c in feed.columns if c not in key]
    ranked = feed.withColumn("_o", F.lit(0)).unionByName(rest.withColumn("_o", F.lit(1)))
    return ranked.groupBy(*key).agg(F.min(F.struct("_o", *columns)).alias("_m")).select(
        *key, *[F.col(f"_m.{c}").alias(c) for c in columns], (F.col("_m._o") == 0).alias("from_feed")
    )


def backfill_until(pages: DataFrame, source: str, order: Sequence[str], stop: Column) -> DataFrame:
    """Rows of each source before the first one at which paging stops.

    `closed` says whether the stop was reached; without one the gap stays open.
    """
    marked = pages.withColumn("_stop", F.coalesce(stop, F.lit(False)).cast("long"))
    scanned = ordered_scan(marked, order, [source], sums={"_stops": F.col("_stop")}, totals={"_all": F.col("_stop")})
    return scanned.where("_stops = 0").withColumn("closed", F.col("_all") > 0).drop("_stop", "_stops", "_all")
