"""Roll-ups of clusters, sources, runs and evaluations.

Every aggregate combines on the map side; lists whose length grows with the
data come back as rows, not as arrays.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curator.constants import AGGREGATOR, PRERELEASE, PRIMARY_CLASSES
from curator.functions.expr import reasons
from curator.functions.ids import story_id
from curator.functions.text import normalize_title
from curator.functions.urls import normalize_url
from curator.operators.cells import cells
from curator.operators.ordered import ordered_scan, range_count
from curator.runtime import materialize


def stories_from_clusters(members: DataFrame, extra: Sequence[Column] = ()) -> DataFrame:
    """One story per cluster: representative, sources, primary link, evidence status.

    members: cluster_id, id, title, url, source_id, source_class,
    evidence_allowed. `extra` aggregates are added to the result. Source classes
    are few fixed names; sources may be many, so they are counted here and
    listed as rows by `story_sources`.
    """
    priority = F.coalesce(
        F.nullif(F.array_position(F.array(*[F.lit(c) for c in PRIMARY_CLASSES]), F.col("source_class")), F.lit(0)),
        F.lit(len(PRIMARY_CLASSES) + 1),
    )
    choice = F.struct(
        priority.alias("p"), normalize_title("title").alias("t"), normalize_url("url").alias("u"), F.col("id").alias("i"),
        F.col("title").alias("title"), F.col("url").alias("url"),
    )
    primary = F.col("source_class").isin(*PRIMARY_CLASSES) & F.col("evidence_allowed") & (F.col("url") != "")
    counted = F.col("evidence_allowed") & (F.col("source_class") != AGGREGATOR)
    # The sort keys cost a scan of the titles, so they are made once per row.
    keyed = members.select("*", choice.alias("_choice"), primary.alias("_primary"), counted.alias("_counted"))
    grouped = keyed.groupBy("cluster_id").agg(
        F.min("_choice").alias("_rep"),
        F.min(F.when(F.col("_primary"), F.col("_choice"))).alias("_first"),
        F.count_distinct("source_id").alias("source_count"),
        F.array_sort(F.collect_set("source_class")).alias("source_classes"),
        F.count(F.lit(1)).alias("item_count"),
        F.bool_and(F.col("source_class") == AGGREGATOR).alias("_only_aggregators"),
        F.min(F.when(F.col("_counted"), F.col("source_id"))).alias("_low"),
        F.max(F.when(F.col("_counted"), F.col("source_id"))).alias("_high"),
        *extra,
    )
    names = [c for c in grouped.columns if not c.startswith("_") and c != "cluster_id"]
    return grouped.select(
        "cluster_id",
        story_id(F.col("_first.url"), F.col("_rep.url"), F.col("_rep.title")).alias("event_id"),
        F.col("_rep.title").alias("canonical_title"),
        F.col("_first.url").alias("primary_source_url"),
        evidence_status(F.col("_first").isNotNull(), F.col("_only_aggregators"), F.col("_low"), F.col("_high")).alias("evidence_status"),
        *names,
    )


def story_sources(members: DataFrame) -> DataFrame:
    """cluster_id, source_id, item_count: the sources of every story, one row each."""
    return members.where("source_id is not null").groupBy("cluster_id", "source_id").agg(F.count(F.lit(1)).alias("item_count"))


def evidence_status(has_primary: Column, only_aggregators: Column, low_source: Column, high_source: Column) -> Column:
    """primary / discovery_only / multi_source / insufficient.

    Two different sources exist exactly when the least and the greatest differ.
    """
    return (
        F.when(has_primary, F.lit("primary")).when(only_aggregators, F.lit("discovery_only"))
        .when(low_source != high_source, F.lit("multi_source")).otherwise("insufficient")
    )


def backtest(filtered: DataFrame, decisions: DataFrame, closed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Counts per source, and the histogram of rejection reasons as rows.

    filtered: source_id, release_key, eligible, reasons[]; decisions:
    release_key, decision; closed: source_id, closed.
    """
    verdicts = decisions.select("release_key", "decision")
    counts = filtered.join(verdicts, "release_key", "left").groupBy("source_id").agg(
        F.count(F.lit(1)).alias("observed_count"),
        F.count_if("eligible").alias("eligible_count"),
        F.count_if(F.col("eligible") & (F.col("decision") == "accept")).alias("accepted_count"),
        F.count_if(F.col("eligible") & (F.col("decision") == "reject")).alias("rejected_count"),
    )
    if closed is not None:
        counts = counts.join(closed.select("source_id", F.col("closed").alias("coverage_complete")), "source_id", "left")
    histogram = filtered.select("source_id", F.explode("reasons").alias("reason")).groupBy("source_id", "reason").agg(
        F.count(F.lit(1)).alias("rejections")
    )
    return counts, histogram


def trial_metrics(manifests: DataFrame, ledger: DataFrame, start: Column, days: int) -> DataFrame:
    """Per source: days fetched without a gap, eligible, accepted, leaks, evidence, latency.

    manifests: source_id, day, gapped; ledger: source_id, discovered_at,
    published_at, status, release_tag, evidence_complete.
    """
    end = F.date_add(start, days)
    in_trial = lambda d: (d >= start) & (d < end)
    fetched = manifests.where(in_trial(F.col("day")) & ~F.col("gapped")).groupBy("source_id").agg(
        F.count_distinct("day").alias("fetch_days")
    )
    kept = ledger.where(
        in_trial(F.to_date("discovered_at")) & F.col("status").isin("pending_review", "accepted", "rejected")
    )
    latency = (F.unix_micros("discovered_at") - F.unix_micros("published_at")) / 3_600_000_000
    counted = kept.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("eligible_count"),
        F.count_if(F.col("status") == "accepted").alias("accepted_count"),
        F.count_if(F.col("release_tag").rlike(PRERELEASE)).alias("prerelease_leaks"),
        F.count_if((F.col("status") == "accepted") & F.col("evidence_complete")).alias("complete_evidence_count"),
        # A record without a readable date can prove no latency bound.
        F.max(F.when(latency.isNull(), float("inf")).otherwise(F.greatest(F.lit(0.0), latency))).alias("max_latency_hours"),
    )
    joined = fetched.join(counted, "source_id", "full_outer")
    zero = {c: 0 for c in joined.columns if c not in ("source_id", "max_latency_hours")}
    return joined.fillna({**zero, "max_latency_hours": 0.0})


def trial_decision(metrics: DataFrame, trial_days: int = 14) -> DataFrame:
    """promote_core, continue_trial or demote_watchlist, with the reasons."""
    if trial_days != 14:
        raise ValueError("source promotion requires exactly 14 trial days")
    unreliable = reasons(
        (F.col("fetch_days") < trial_days - 1, "fetch_success_below_13_of_14"),
        (F.col("prerelease_leaks") > 0, "prerelease_leak"),
        (F.col("max_latency_hours") > 24, "latency_above_24_hours"),
        (F.col("complete_evidence_count") != F.col("accepted_count"), "accepted_evidence_incomplete"),
    )
    reliable = F.size(unreliable) == 0
    few, none = F.col("eligible_count") < 3, F.col("accepted_count") < 1
    decision = (
        F.when(~reliable, F.lit("demote_watchlist")).when(few, F.lit("continue_trial"))
        .when(none, F.lit("demote_watchlist")).otherwise("promote_core")
    )
    why = F.when(~reliable, unreliable).otherwise(
        reasons((few, "insufficient_eligible_sample"), (~few & none, "no_substantive_change_accepted"))
    )
    return metrics.withColumn("decision", decision).withColumn("reasons", why)


def coverage(batches: DataFrame, start: Column, end: Column) -> DataFrame:
    """Collection state per local date of a period, dates without a run included.

    batches: run_id, local_date, sources ARRAY<STRUCT<name, status, ...>>.
    """
    spark = batches.sparkSession
    calendar = spark.range(1).select(F.explode(F.sequence(start, end)).alias("local_date"))
    count = lambda s: F.sum(F.size(F.filter("sources", lambda x: x["status"] == s))).cast("long")
    runs = batches.where(F.col("local_date").between(start, end)).groupBy("local_date").agg(
        F.count(F.lit(1)).alias("runs"), count("ok").alias("ok_sources"),
        count("failed").alias("failed_sources"), count("empty").alias("empty_sources"),
    )
    return calendar.join(runs, "local_date", "left").fillna(0).withColumn("missing", F.col("runs") == 0)


def ledger_status(obs: DataFrame, batches: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: size of the ledger and its last collection."""
    return obs.agg(
        F.count_distinct("canonical_url").alias("candidate_count"), F.count(F.lit(1)).alias("observation_count")
    ).withColumns({
        "batch_count": batches.agg(F.count(F.lit(1))).scalar(),
        "last_collected_at": batches.agg(F.max("collected_at")).scalar(),
        "collection_dates": batches.agg(F.count_distinct("local_date")).scalar(),
        "issue_count": issues.agg(F.count(F.lit(1))).scalar(),
    })


def candidate_counts(candidates: DataFrame, *by: str) -> DataFrame:
    state = lambda s: F.count_if(F.col("selection_status") == s)
    return candidates.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_candidates"), state("available").alias("available_count"),
        state("needs_evidence").alias("needs_evidence_count"), state("blocked").alias("blocked_count"),
    )


def confusion(rows: DataFrame, predicted: Column, actual: Column, *by: str) -> DataFrame:
    """Confusion counts with precision and recall, null where undefined."""
    counted = rows.groupBy(*by).agg(
        F.count_if(predicted & actual).alias("true_positive"), F.count_if(predicted & ~actual).alias("false_positive"),
        F.count_if(~predicted & actual).alias("false_negative"), F.count_if(~predicted & ~actual).alias("true_negative"),
    )
    share = lambda other: F.try_divide(F.col("true_positive").cast("double"), F.col("true_positive") + F.col(other))
    return counted.withColumn("precision", share("false_positive")).withColumn("recall", share("false_negative"))


def confusion_cases(rows: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """The misjudged rows, labelled by the kind of error."""
    return rows.where(predicted != actual).withColumn("error", F.when(predicted, "false_positive").otherwise("false_negative"))


def threshold_scan(rows: DataFrame, score: Column, allowed: Column, actual: Column, low: int = 40, high: int = 90, step: int = 5) -> DataFrame:
    """Confusion counts at every threshold, from one pass over the rows.

    A row counts for the thresholds up to its score, so rows are first counted
    per highest threshold passed; thresholds then accumulate a dozen counts.
    """
    steps = (high - low) // step + 1
    passed = F.when(allowed & score.isNotNull(), F.floor((score - low) / step) + 1).otherwise(0)
    level = F.greatest(F.lit(0), F.least(F.lit(steps), passed)).cast("int")
    counts = rows.groupBy(level.alias("level"), actual.alias("actual")).agg(F.count(F.lit(1)).alias("n"))
    cells = (("true_positive", True, True), ("false_positive", True, False), ("false_negative", False, True), ("true_negative", False, False))
    at = lambda i, p, a: F.coalesce(F.sum(F.when(((F.col("level") >= i) == p) & (F.col("actual") == a), F.col("n"))), F.lit(0))
    table = F.array(*[
        F.struct(F.lit(low + (i - 1) * step).cast("long").alias("threshold"), *[at(i, p, a).alias(name) for name, p, a in cells])
        for i in range(1, steps + 1)
    ])
    merged = counts.agg(table.alias("t")).select(F.inline("t"))
    share = lambda other: F.try_divide(F.col("true_positive").cast("double"), F.col("true_positive") + F.col(other))
    return merged.withColumn("precision", share("false_positive")).withColumn("recall", share("false_negative"))


def exact_median(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Exact median per group, not from values held in memory: by selection, or from positions where rows are few."""
    known = df.where(F.col(value).isNotNull())
    sizes = known.agg(F.count("*").alias("n"), F.count_if(F.col(value).cast("double").between(-_LARGEST, _LARGEST)).alias("finite")).first()
    small = range_count(sizes["n"]) <= 1
    if small or sizes["n"] != sizes["finite"]:
        # Few rows in all, or values without a width: one ordered scan.
        placed = ordered_scan(known, [value], by, position="_p", size="_n", bucket=False if small else None)
        middle = (F.col("_p") == F.floor((F.col("_n") + 1) / 2)) | (F.col("_p") == F.floor((F.col("_n") + 2) / 2))
        return placed.where(middle).groupBy(*by).agg(F.avg(value).alias("median"))
    return _median_by_selection(known.select(*by, F.col(value).cast("double").alias("_v")), list(by))


#: Cells of one refinement, and the largest values whose range has a width.
_CELLS, _LARGEST = 1024, 8e307


def _median_by_selection(values: DataFrame, by: list[str]) -> DataFrame:
    """Medians by narrowing the range that holds each group's middle values, without a sort of the values.

    A pass counts the values of each group in `_CELLS` equal cells between two bounds; the cell that holds the wanted rank
    gives the next bounds, its least and greatest value. A range of one value is the answer. Counts combine before the
    shuffle, so a pass moves a row per cell and task and no values.
    """
    values = materialize(values, "median-values")
    whole = values.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    ranks = F.array(F.floor((F.col("_n") + 1) / 2), F.floor((F.col("_n") + 2) / 2))
    wanted = materialize(whole.select(*by, F.posexplode(ranks).alias("_which", "_rank"), "_low", "_high"), "median-bounds")
    done = []
    while True:
        done.append(wanted.where("_low = _high").select(*by, F.col("_low").alias("_found")))
        open_ = wanted.where("_low < _high")
        if open_.isEmpty():
            break
        names = [f"_by{i}" for i in range(len(by))]
        bounds = open_.select(*[F.col(c).alias(n) for c, n in zip(by, names)], "_which", "_rank", "_low", "_high")
        same = F.lit(True)
        for c, n in zip(by, names):
            same = same & F.col(c).eqNullSafe(F.col(n))
        inside = values.join(bounds, same & F.col("_v").between(F.col("_low"), F.col("_high")))
        cell = F.least(F.floor((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * _CELLS), F.lit(_CELLS - 1))
        # Where rounding puts all values of a narrow range into one cell, its ends are still cut off.
        cell = F.when(F.col("_v") == F.col("_low"), -1).when(F.col("_v") == F.col("_high"), _CELLS).otherwise(cell)
        cells = inside.groupBy(*by, "_which", cell.alias("_cell")).agg(
            F.any_value("_rank").alias("_rank"), F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        before = Window.partitionBy(*by, "_which").orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
        placed = cells.withColumn("_upto", F.sum("_n").over(before))
        held = (F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_n") < F.col("_rank"))
        wanted = materialize(placed.where(held).select(
            *by, "_which", (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_rank"), "_low", "_high"), "median-bounds")
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    return found.groupBy(*by).agg(F.avg("_found").alias("median"))


def compare_runs(results: DataFrame, by: Sequence[str] = ("provider",)) -> DataFrame:
    """Outcome per provider: successes, decisions, tokens, unknown answers, median time.

    results: provider, status, decision, elapsed_seconds, prompt_tokens,
    input_tokens, completion_tokens, output_tokens, unknown_dimensions.
    """
    attempted = F.col("status") != "not_run"
    ok = F.col("status") == "succeeded"
    tokens = lambda a, b: F.sum(F.when(attempted, F.coalesce(a, b, F.lit(0))).otherwise(0))
    no_usage = F.col("prompt_tokens").isNull() & F.col("input_tokens").isNull()
    counted = results.groupBy(*by).agg(
        F.count_if(ok).alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"),
        *[F.count_if(ok & (F.col("decision") == d)).alias(f"decided_{d}") for d in ("select", "defer", "reject")],
        tokens("prompt_tokens", "input_tokens").alias("input_token_sum"),
        tokens("completion_tokens", "output_tokens").alias("output_token_sum"),
        F.count_if(attempted & no_usage).alias("missing_usage"),
        F.sum(F.when(ok, F.col("unknown_dimensions")).otherwise(0)).alias("unknown_answers"),
    )
    medians = exact_median(results.where(attempted), by, "elapsed_seconds").withColumnRenamed("median", "median_seconds")
    return counted.join(medians, list(by), "left")


def paired_agreement(results: DataFrame, left: str, right: str) -> DataFrame:
    """Cases both providers answered, and how many they decided alike."""
    side = lambda p, name: results.where((F.col("provider") == p) & (F.col("status") == "succeeded")).select("candidate_id", F.col("decision").alias(name))
    return side(left, "a").join(side(right, "b"), "candidate_id").agg(
        F.count(F.lit(1)).alias("paired"), F.count_if(F.col("a") == F.col("b")).alias("decision_agreement")
    )


def admission(log: DataFrame) -> DataFrame:
    """One row: may co-learning runs be automated, and which conditions are unmet?

    log: event, status, run_id, entry_mode, feedback, error_class,
    attempt_sha256, discovery_metrics STRUCT (null when absent).
    """
    m = lambda f: F.col(f"discovery_metrics.{f}")
    mode = F.coalesce("entry_mode", F.lit("nominated"))
    bounded = (
        m("screened_candidate_count").between(1, 20) & m("deep_read_count").between(1, 5) & m("search_query_count").between(1, 5)
        & (m("direct_candidate_count") + m("adjacent_candidate_count") == m("screened_candidate_count"))
        & ((m("adjacent_candidate_count") == 0) | (m("direct_candidate_count") >= 4 * m("adjacent_candidate_count")))
        & m("selected_repository").isNotNull()
    )
    success = (
        (F.col("event") == "learning_finalized") & (F.col("status") == "success") & F.col("run_id").isNotNull() & (F.col("run_id") != "")
        & ((mode != "discovered") | F.coalesce(bounded, F.lit(False)))
    )
    qualified = log.where(success)
    # The last qualifying entry of a run says how it was started.
    order = "seq" if "seq" in log.columns else "run_id"
    modes = qualified.groupBy("run_id").agg(F.max_by(mode, F.col(order)).alias("mode"))
    positive = log.where((F.col("event") == "feedback_recorded") & F.col("feedback").isin("continue", "watch", "experiment")).select("run_id").distinct()
    counted = modes.join(positive.withColumn("positive", F.lit(True)), "run_id", "left").agg(
        F.count(F.lit(1)).alias("completed_runs"), F.count_if(F.col("mode") == "nominated").alias("nominated_runs"),
        F.count_if(F.col("mode") == "discovered").alias("discovered_runs"), F.count_if(F.col("positive")).alias("positive_feedback_runs"),
    )
    errors = log.where((F.col("event") == "learning_review_failed") & (F.col("error_class") == "dual_evidence")).agg(
        F.count_distinct("run_id", "attempt_sha256")
    )
    unmet = reasons(
        (F.col("completed_runs") < 10, "completed_runs<10"), (F.col("nominated_runs") < 3, "nominated_runs<3"),
        (F.col("discovered_runs") < 3, "discovered_runs<3"), (F.col("positive_feedback_runs") < 6, "positive_feedback_runs<6"),
        (F.col("dual_evidence_errors") > 1, "dual_evidence_errors>1"),
    )
    return counted.withColumn("dual_evidence_errors", errors.scalar()).withColumn("unmet_requirements", unmet).withColumn(
        "eligible_for_automation", F.size("unmet_requirements") == 0
    )


def usage(requests: DataFrame, by: Sequence[str], tokens: Sequence[str]) -> DataFrame:
    """Token totals; counts that are missing or negative add nothing."""
    return requests.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests"),
        *[F.sum(F.when(F.col(t) >= 0, F.col(t)).otherwise(0)).alias(t) for t in tokens],
    )


def status_histogram(jobs: DataFrame, status: str = "status") -> DataFrame:
    return jobs.groupBy(status).agg(F.count(F.lit(1)).alias("jobs"))


def fact_coverage(lines: DataFrame, gold: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For each gold line range: lines covered by the selection, and is it a hit?

    lines: keys, line; gold: keys, fact_id, line_start, line_end, critical.
    Selected lines are masks per file and cell; a range counts the common bits.
    """
    touched = lambda df, a, b: df.withColumn("_c", F.explode(cells(F.col(a), F.col(b)))).withColumn("_cell", F.col("_c.cell"))
    seen = touched(lines, "line", "line").groupBy(*keys, "_cell").agg(F.bit_or(F.col("_c.mask")).alias("_seen"))
    asked = touched(gold, "line_start", "line_end").select(*keys, "fact_id", "_cell", F.col("_c.mask").alias("_asked"))
    covered = asked.join(seen, [*keys, "_cell"]).groupBy("fact_id").agg(
        F.sum(F.bit_count(F.col("_seen").bitwiseAND(F.col("_asked")))).alias("covered_lines")
    )
    required = F.col("line_end") - F.col("line_start") + 1
    return (
        gold.join(covered, "fact_id", "left").withColumn("covered_lines", F.coalesce("covered_lines", F.lit(0)))
        .withColumn("required_lines", required).withColumn("hit", F.col("covered_lines") == F.col("required_lines"))
        .withColumn("critical_miss", F.col("critical") & ~F.col("hit"))
    )


def collect_counters(entries: DataFrame, source: str = "source") -> DataFrame:
    """Counters of one collection run per source.

    entries: source, state (see filters.window_state), accepted,
    budget_excluded, error, observed_at. The run status follows the sources.
    """
    state = lambda s: F.count_if(F.col("state") == s)
    per_source = entries.groupBy(source).agg(
        F.count(F.lit(1)).alias("read_items"), F.count_if("accepted").alias("accepted_observations"),
        state("future").alias("future_items"), state("outside").alias("outside_window"), state("unknown").alias("unknown_date_items"),
        F.count_if("budget_excluded").alias("budget_excluded"), F.count_if("error").alias("errors"),
        F.min("observed_at").alias("observed_date_min"), F.max("observed_at").alias("observed_date_max"),
    )
    return per_source.withColumn(
        "status", F.when(F.col("errors") > 0, "failed").when(F.col("read_items") > 0, "ok").otherwise("empty")
    )


def run_status(sources: DataFrame) -> DataFrame:
    """ok / partial / empty / failed over the per-source counters."""
    failed, total, accepted = F.count_if(F.col("status") == "failed"), F.count(F.lit(1)), F.sum("accepted_observations")
    return sources.agg(
        F.when(failed == total, "failed").when(failed > 0, "partial").when(accepted > 0, "ok").otherwise("empty").alias("status"),
        total.alias("sources"), failed.alias("failed_sources"),
    )


def candidate_rollup(obs: DataFrame, key: Sequence[str]) -> DataFrame:
    """First discovery, last collection and number of sources per identity.

    obs: key, discovered_at, collected_at, source_url. The URLs themselves are
    rows of `candidate_sources`.
    """
    return obs.groupBy(*key).agg(
        F.min("discovered_at").alias("first_discovered_at"), F.max("collected_at").alias("last_collected_at"),
        F.count_distinct("source_url").alias("source_urls"), F.count(F.lit(1)).alias("observations"),
    )


def candidate_sources(obs: DataFrame, key: Sequence[str]) -> DataFrame:
    return obs.select(*key, "source_url").distinct()
