"""Explainable scores, decisions, routing and history deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curator import constants as K
from curator.functions.expr import let, reasons
from curator.functions.text import has_term
from curator.operators.ordered import ordered_scan
from curator.policy import ScoreConfig, SelectionPolicy


def _pick(key: Column, pairs: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for name, value in pairs.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def evaluation_target(kind: Column) -> Column:
    """The unit a candidate is judged as; follows its kind, not its latest page."""
    return _pick(kind, K.EVALUATION_UNITS)


def profile_of(kind: Column, category: Column) -> Column:
    return F.when(kind == "news", F.lit("news")).otherwise(_pick(category, K.CATEGORY_PROFILES))


def term_marks(config: ScoreConfig | None = None) -> list[Column]:
    """workflow_mark and weak_mark of an item's summary and categories: all that scoring needs of its text."""
    config = config or ScoreConfig()
    body = F.concat_ws(" ", F.col("summary"), F.array_join("categories", " "))
    return [has_term(body, config.workflow_terms).alias("workflow_mark"), has_term(body, config.weak_terms).alias("weak_mark")]


def mark_aggregates() -> list[Column]:
    """Aggregates over cluster members, marked by `term_marks`, that `score_stories` needs."""
    return [
        F.coalesce(F.bool_or("workflow_mark"), F.lit(False)).alias("body_workflow"),
        F.coalesce(F.bool_or("weak_mark"), F.lit(False)).alias("body_weak"),
        F.max("published_at").alias("latest_published_at"),
    ]


def score_stories(stories: DataFrame, as_of: Column, recent: DataFrame | None = None, audience: str = "本刊", config: ScoreConfig | None = None) -> DataFrame:
    """Seven additive components, four penalties and a total from 0 to 100.

    stories: event_id, canonical_title, evidence_status, source_count and the
    `mark_aggregates`; recent: event_id of stories like a recent decision;
    config: weights, penalties and terms.
    """
    config = config or ScoreConfig()
    weight, penalty = config.weights, config.penalties
    share = lambda name, part: F.bround(F.lit(weight[name] * part)).cast("int")  # ties to even
    full = lambda name: F.lit(weight[name])
    status = F.col("evidence_status")
    title = F.col("canonical_title")
    title_work = has_term(title, config.workflow_terms)
    work = F.col("body_workflow") | title_work
    age = F.greatest(F.lit(0.0), (F.unix_micros(as_of) - F.unix_micros("latest_published_at")) / 86_400_000_000)
    components = {
        "audience_value": F.when(work, full("audience_value")).otherwise(share("audience_value", 0.4)),
        "evidence": F.when(status == "primary", full("evidence")).when(status == "multi_source", share("evidence", 0.7))
        .when(status == "insufficient", share("evidence", 0.35)).otherwise(0),
        "novelty": F.least(full("novelty"), 4 + 4 * F.col("source_count")),
        "timeliness": F.when(age.isNull(), 0).when(age <= 1, full("timeliness")).when(age <= 3, share("timeliness", 0.75))
        .when(age <= 7, share("timeliness", 0.4)).otherwise(0),
        "audience_fit": F.when(work, full("audience_fit")).otherwise(share("audience_fit", 0.3)),
        "explainability": F.when(status == "primary", full("explainability")).otherwise(share("explainability", 0.5)),
        "production_cost_fit": F.when(status != "discovery_only", full("production_cost_fit")).otherwise(share("production_cost_fit", 0.6)),
    }
    if recent is not None:
        stories = stories.join(recent.select("event_id", F.lit(True).alias("_recent")).distinct(), "event_id", "left")
    else:
        stories = stories.withColumn("_recent", F.lit(False))
    hits = {
        "discovery_only": status == "discovery_only",
        "recent_decision_similarity": F.coalesce("_recent", F.lit(False)),
        "weak_evidence_language": F.col("body_weak") | has_term(title, config.weak_terms),
        "non_workflow_noise": has_term(title, config.noise_terms) & ~title_work,
    }
    scored = stories.select(
        "*",
        F.struct(*[c.cast("int").alias(n) for n, c in components.items()]).alias("components"),
        F.struct(*[c.alias(n) for n, c in hits.items()]).alias("_hits"),
    )
    base = sum((F.col(f"components.{n}") for n in weight), F.lit(0))
    deducted = sum((F.when(F.col(f"_hits.{n}"), penalty[n]).otherwise(0) for n in hits), F.lit(0))
    scored = scored.withColumn("total", F.greatest(F.lit(0), F.least(F.lit(100), base + deducted)))
    entries = F.array_compact(F.array(*[
        F.when(F.col(f"_hits.{n}"), F.struct(F.lit(n).alias("key"), F.lit(penalty[n]).alias("value"))) for n in hits
    ]))
    return (
        scored.withColumn("penalties", F.map_from_entries(entries))
        .withColumn("penalty_reasons", reasons(*[(F.col(f"_hits.{n}"), K.PENALTY_REASONS[n]) for n in hits]))
        .withColumn("recommendation", recommendation(title, status, F.col("total"), audience))
        .drop("_hits", "_recent")
    )


def recommendation(title: Column, status: Column, total: Column, audience: str = "本刊") -> Column:
    """Advice text; `audience` is the name of the publication the choice is for."""
    # The three recommendation texts.
    unproven = f"仅作为发现信号：%s 还缺少可直接引用的一手证据，补齐后再判断是否适合 {audience}。"
    proven = f"有一手证据：%s 可清楚说明变化、使用场景和限制，适合作为 {audience} 候选（%d 分）。"
    partial = f"%s 有可追溯来源，但仍需补充交叉核验后再进入 {audience} 选题池（%d 分）。"
    return (
        F.when(status == "discovery_only", F.format_string(unproven, title))
        .when(status == "primary", F.format_string(proven, title, total))
        .otherwise(F.format_string(partial, title, total))
    )


def _lowest_cap(flags: Column, dimension: str, policy: SelectionPolicy) -> Column:
    caps = [(code, cap[dimension]) for code, cap in policy.flag_caps.items() if dimension in cap]
    return F.least(F.lit(10), *[F.when(F.array_contains(flags, code), cap).otherwise(10) for code, cap in caps], F.lit(10))


def weighted_score(df: DataFrame, policy: SelectionPolicy | None = None) -> DataFrame:
    """raw_score, effective_scores, total_score and applied caps of five 0-10 scores.

    df: profile, scores STRUCT of the five dimensions (null = not scored),
    flags ARRAY<STRING>; policy: the profiles' weights and the flags' caps.
    Without scores every result is null.
    """
    policy = policy or SelectionPolicy()
    dims = K.DIMENSIONS
    raw = {d: F.col(f"scores.{d}") for d in dims}
    scored = F.col("scores").isNotNull()

    def weight(d: str) -> Column:
        out = F.lit(None).cast("int")
        for name, weights in policy.profiles.items():
            out = F.when(F.col("profile") == name, weights[d]).otherwise(out)
        return out

    effective = {d: F.least(raw[d], _lowest_cap(F.col("flags"), d, policy)) for d in dims}
    capped = df.withColumn("_effective", F.struct(*[effective[d].cast("int").alias(d) for d in dims]))
    total = lambda values: sum((values[d] * weight(d) for d in dims[1:]), values[dims[0]] * weight(dims[0]))

    # Caps are listed flag by flag, each against what earlier flags left.
    steps = F.array(*[
        F.struct(F.lit(code).alias("flag"), F.lit(d).alias("dimension"), F.lit(cap).alias("to"))
        for code, limits in policy.flag_caps.items() for d, cap in limits.items()
    ])
    ordered = F.flatten(F.transform("flags", lambda f: F.filter(steps, lambda s: s["flag"] == f)))
    state = F.map_from_arrays(F.array(*[F.lit(d) for d in dims]), F.array(*[raw[d].cast("int") for d in dims]))
    empty = F.array().cast("array<struct<flag:string,dimension:string,from:int,to:int>>")

    def apply(acc: Column, s: Column) -> Column:
        now = F.try_element_at(acc["values"], s["dimension"])
        lower = now > s["to"]
        return F.struct(
            F.when(lower, F.map_zip_with(acc["values"], acc["values"], lambda k, a, b: F.when(k == s["dimension"], s["to"]).otherwise(a)))
            .otherwise(acc["values"]).alias("values"),
            F.when(lower, F.concat(acc["log"], F.array(F.struct(s["flag"].alias("flag"), s["dimension"].alias("dimension"), now.alias("from"), s["to"].alias("to")))))
            .otherwise(acc["log"]).alias("log"),
        )

    log = F.aggregate(ordered, F.struct(state.alias("values"), empty.alias("log")), apply, lambda acc: acc["log"])
    return capped.select(
        *df.columns,
        F.when(scored, total(raw)).alias("raw_score"),
        F.when(scored, F.col("_effective")).alias("effective_scores"),
        F.when(scored, total({d: F.col(f"_effective.{d}") for d in dims})).alias("total_score"),
        F.when(scored, log).otherwise(empty).alias("applied_caps"),
    )


def decide(precheck: Column, eligibility_state: Column, flags: Column, total: Column, policy: SelectionPolicy | None = None) -> Column:
    """select / defer / reject. A hard block comes first, doubt before any threshold."""
    policy = policy or SelectionPolicy()
    doubtful = (
        (precheck == "UNKNOWN") | total.isNull() | (eligibility_state != "available")
        | F.arrays_overlap(flags, F.array(*[F.lit(f) for f in policy.defer_flags]))
    )
    return (
        F.when(precheck == "BLOCK", F.lit("reject")).when(doubtful, F.lit("defer"))
        .when(total >= policy.select_at, F.lit("select")).when(total < policy.reject_below, F.lit("reject")).otherwise("defer")
    )


def escalation_reasons(precheck: Column, confidences: Column, score: Column, policy: SelectionPolicy | None = None) -> Column:
    """Why a judgment should go to the stronger reviewer; empty = keep it.

    confidences: one value per core answer; a missing one counts as low.
    """
    policy = policy or SelectionPolicy()
    near = F.least(F.abs(score - policy.select_at), F.abs(score - policy.reject_below)) <= policy.threshold_margin
    low = F.exists(confidences, lambda c: F.coalesce(c < policy.confidence_floor, F.lit(True)))
    return reasons((precheck == "UNKNOWN", "unknown"), (low, "low_confidence"), (F.coalesce(near, F.lit(False)), "near_threshold"))


def normalize_answers(answers: Column, has_context: Column) -> Column:
    """STRUCT<precheck, scores, unknown_dimensions, error> of typed answers.

    answers: MAP<question, choice>. A dimension may be '0'..'10' or UNKNOWN; one
    UNKNOWN voids all scores and downgrades a PASS.
    """
    dims = F.array(*[F.lit(d) for d in K.DIMENSIONS])
    choice = lambda d: F.try_element_at(answers, d)
    numbers = [str(i) for i in range(11)]
    invalid = F.filter(dims, lambda d: ~F.coalesce(choice(d).isin("UNKNOWN", *numbers), F.lit(False)))
    unknown = F.filter(dims, lambda d: choice(d) == "UNKNOWN")
    precheck = choice(F.lit("precheck"))
    bad_precheck = ~F.coalesce(precheck.isin("PASS", "UNKNOWN", "BLOCK"), F.lit(False))
    void = (F.size(unknown) > 0) | ~has_context
    scores = F.when(~void, F.struct(*[choice(F.lit(d)).try_cast("int").alias(d) for d in K.DIMENSIONS]))
    settled = F.when(~has_context, F.lit("UNKNOWN")).when((F.size(unknown) > 0) & (precheck == "PASS"), F.lit("UNKNOWN")).otherwise(precheck)
    error = F.when(bad_precheck, F.lit("precheck")).when(F.size(invalid) > 0, F.get(invalid, 0))
    return F.struct(
        F.when(error.isNull(), settled).alias("precheck"), F.when(error.isNull(), scores).alias("scores"),
        F.when(error.isNull(), unknown).alias("unknown_dimensions"), error.alias("error"),
    )


def unwrap_answers(raw: Column, expected: tuple[str, ...]) -> Column:
    """STRUCT<answers MAP, note> of a JSON reply, undoing lossless envelopes only.

    Accepted: the plain object, {"answer": {...}}, {"answer": "<json>"}, and
    {question: {"answer": choice}}. Anything else has null answers.
    """
    names = F.array(*[F.lit(n) for n in sorted(expected)])
    fields = lambda text: F.from_json(text, "map<string,string>")
    is_exact = lambda m: F.coalesce(F.array_sort(F.map_keys(m)) == names, F.lit(False))

    def settle(outer: Column) -> Column:
        inner = fields(F.try_element_at(outer, F.lit("answer")))
        rest = F.map_filter(outer, lambda k, v: k != "answer")
        enveloped = F.map_contains_key(outer, "answer")
        duplicate = F.map_entries(rest) == F.map_entries(inner)
        usable = ~enveloped | (F.size(rest) == 0) | F.coalesce(F.array_sort(F.map_entries(rest)) == F.array_sort(F.map_entries(inner)), F.lit(False))
        note = F.when(enveloped & (F.size(rest) == 0), F.lit("answer_object")).when(enveloped & F.coalesce(duplicate, F.lit(True)), F.lit("identical_duplicate_answer"))
        value = F.when(enveloped, inner).otherwise(outer)
        each = F.map_filter(value, lambda k, v: F.coalesce(F.map_keys(fields(v)) == F.array(F.lit("answer")), F.lit(False)))
        wrapped = F.size(each) == F.size(value)
        plain = F.when(wrapped, F.transform_values(value, lambda k, v: F.get_json_object(v, "$.answer"))).otherwise(value)
        return F.struct(
            F.when(usable & is_exact(value), plain).alias("answers"),
            F.concat_ws(",", note, F.when(wrapped & is_exact(value), F.lit("per_question_answer"))).alias("note"),
        )

    return let(fields(raw), settle)


# Dedup verdict texts.
SAME_EVENT = "same event already reported in same-level history (wording and event IDs cannot bypass its URL)"
CROSS_URL = "same event already reported in same-level history (candidate URL and kind cannot bypass its original URL)"
ALREADY = "already selected in same-level history; an unreported important update is required"
NOT_NEWER = "important update must be newer than all previously reported events or baseline verifications"
EVIDENCE_USED = "event evidence already reported in same-level history"


def dedup_verdict(candidates: DataFrame, history: DataFrame) -> DataFrame:
    """Why a candidate may not be published again; null = it may.

    candidates: row_id, canonical_url, kind, event_id, event_url (null = no
    event), reported_url (event URL, or the page's own for news), earliest;
    history: canonical_url, h_event_id, h_event_url (null = no event), h_latest,
    h_verified_at, h_evidence[], h_seq (newest first).

    History is reduced per identity before it is joined, so a much-published
    identity meets a candidate once: the comparisons need only which event ids
    and URLs were reported, the latest bound, and the evidence of introductions.
    """
    reported = history.where("h_event_url is not null").select(F.col("h_event_url").alias("reported_url")).distinct()
    prior = history.select("canonical_url").distinct().withColumn("_prior", F.lit(True))
    boundary = F.when(F.col("h_event_url").isNotNull(), F.col("h_latest")).otherwise(F.col("h_verified_at"))

    # First failing check per candidate in history order: the smallest h_seq of each kind.
    by_id = history.where("h_event_id is not null").groupBy("canonical_url", F.col("h_event_id").alias("event_id")).agg(F.min("h_seq").alias("_id_seq"))
    by_url = history.where("h_event_url is not null").groupBy("canonical_url", F.col("h_event_url").alias("event_url")).agg(F.min("h_seq").alias("_url_seq"))
    by_evidence = (
        history.where("h_event_url is null").select("canonical_url", "h_seq", F.explode("h_evidence").alias("event_url"))
        .groupBy("canonical_url", "event_url").agg(F.min("h_seq").alias("_evidence_seq"))
    )
    # Earliest entry whose boundary is at or after the candidate's event: walk
    # boundaries and candidates together from the latest time down.
    bounds = history.select(
        "canonical_url", F.unix_micros(boundary).alias("_v"), F.lit(0).alias("_asks"), F.col("h_seq"), F.lit(None).cast(candidates.schema["row_id"].dataType).alias("row_id")
    )
    asks = candidates.select(
        "canonical_url", F.unix_micros("earliest").alias("_v"), F.lit(1).alias("_asks"), F.lit(None).cast(history.schema["h_seq"].dataType).alias("h_seq"), "row_id"
    )
    walked = ordered_scan(
        bounds.unionByName(asks).where("_v is not null"), [-F.col("_v"), "_asks", "h_seq", "row_id"], ["canonical_url"],
        mins_before={"_late_seq": F.col("h_seq")},
    )
    late = walked.where("_asks = 1").select("row_id", "_late_seq")

    joined = (
        candidates.join(reported.withColumn("_crossed", F.lit(True)), "reported_url", "left")
        .join(prior, "canonical_url", "left")
        .join(by_id, ["canonical_url", "event_id"], "left")
        .join(by_url, ["canonical_url", "event_url"], "left")
        .join(by_evidence, ["canonical_url", "event_url"], "left")
        .join(late, "row_id", "left")
    )
    same_seq = F.least("_id_seq", "_url_seq")
    first = F.least(same_seq, F.col("_late_seq"), F.col("_evidence_seq"))
    verdict = (
        F.when(F.col("_crossed"), F.lit(CROSS_URL))
        .when(F.col("_prior").isNull(), F.lit(None))
        .when(~F.col("kind").isin("update", "news") | F.col("event_url").isNull(), F.lit(ALREADY))
        .when(same_seq == first, F.lit(SAME_EVENT))
        .when(F.col("_late_seq") == first, F.lit(NOT_NEWER))
        .when(F.col("_evidence_seq") == first, F.lit(EVIDENCE_USED))
    )
    return joined.select(*candidates.columns, verdict.alias("selection_block"))
