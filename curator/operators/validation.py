"""Rules as data-frame checks: every violation is a row, nothing stops at the first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curator import constants as K
from curator.functions.text import normalize_evidence

Rule = tuple[str, str, Column, str]


def validate(df: DataFrame, key: Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    """key, path, code, message for every broken rule.

    A rule is (path, code, broken, message); `broken` is true where it fails. A
    null condition does not fail.
    """
    found = F.array_compact(F.array(*[
        F.when(broken, F.struct(F.lit(path).alias("path"), F.lit(code).alias("code"), F.lit(message).alias("message")))
        for path, code, broken, message in rules
    ]))
    return df.select(*key, F.explode(found).alias("v")).select(*key, "v.*")


def required(name: str) -> Rule:
    text = F.col(name).cast("string")
    return (name, "required", F.coalesce(F.trim(text), F.lit("")) == "", f"{name} must be a nonempty value")


def one_of(name: str, allowed: Sequence) -> Rule:
    return (name, "enum", ~F.col(name).isin(*allowed), f"{name} has an unknown value")


def in_range(name: str, low, high) -> Rule:
    return (name, "range", ~F.col(name).between(low, high), f"{name} must be between {low} and {high}")


def matches(name: str, pattern: str) -> Rule:
    return (name, "pattern", ~F.col(name).rlike(pattern), f"{name} has an invalid form")


def cross(path: str, code: str, broken: Column, message: str) -> Rule:
    return (path, code, broken, message)


def validate_groups(df: DataFrame, group: Sequence[str], measures: dict[str, Column], rules: Sequence[Rule]) -> DataFrame:
    """Rules over aggregates of each group."""
    return validate(df.groupBy(*group).agg(*[c.alias(n) for n, c in measures.items()]), group, rules)


def repeated(df: DataFrame, group: Sequence[str], identity: str) -> DataFrame:
    """Groups that hold an identity more than once, without per-group lists."""
    return df.where(F.col(identity).isNotNull()).groupBy(*group, identity).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


# Issue sizes (wanted, allowed) per ranking level.
ISSUE_SIZE = {"daily": (5, 8), "weekly": (20, 25), "monthly": (20, 1000)}


def _by_level(values: dict[str, int]) -> Column:
    out = F.lit(None).cast("int")
    for level, value in values.items():
        out = F.when(F.col("ranking_type") == level, value).otherwise(out)
    return out


def validate_issues(items: DataFrame, issues: DataFrame) -> DataFrame:
    """Size, featured quota and uniqueness of whole issues.

    issues: issue_id, ranking_type, shortfall_reason; items: issue_id, kind,
    featured, canonical_url, event_url.
    """
    counted = items.groupBy("issue_id").agg(
        F.count(F.lit(1)).alias("items"), F.count_if("featured").alias("featured"),
        F.count_if(F.col("kind") != "reading").alias("nonreading"), F.count_if(F.col("featured") & (F.col("kind") == "reading")).alias("featured_readings"),
    )
    whole = issues.join(counted, "issue_id", "left").fillna(0, ["items", "featured", "nonreading", "featured_readings"])
    wanted, allowed = _by_level({k: v[0] for k, v in ISSUE_SIZE.items()}), _by_level({k: v[1] for k, v in ISSUE_SIZE.items()})
    quota = F.least(F.lit(3), F.col("nonreading"))
    weekly = F.col("ranking_type") == "weekly"
    rules = [
        cross("items", "too_many", F.col("items") > allowed, "more items than the level allows"),
        cross("items", "shortfall_unexplained", (F.col("items") < wanted) & (F.coalesce(F.trim("shortfall_reason"), F.lit("")) == ""), "fewer items need a shortfall_reason"),
        cross("items.featured", "featured_reading", F.col("featured_readings") > 0, "a reading cannot be featured"),
        cross("items.featured", "featured_quota", F.when(weekly, F.col("featured") != quota).otherwise(~F.col("featured").between(F.least(F.lit(1), F.col("nonreading")), quota)), "featured count is outside its quota"),
    ]
    structural = validate(whole, ["issue_id"], rules)
    double = lambda identity, code, message: repeated(items, ["issue_id"], identity).select("issue_id").distinct().select(
        "issue_id", F.lit("items").alias("path"), F.lit(code).alias("code"), F.lit(message).alias("message")
    )
    return structural.unionByName(
        double("canonical_url", "identity_repeated", "the same project or article occurs twice")
    ).unionByName(double("event_url", "event_repeated", "the same original event occurs twice"))


def validate_issue_items(items: DataFrame, issues: DataFrame) -> DataFrame:
    """Row contract of the items of an issue, by its level, period and preparation time.

    issues: issue_id, ranking_type, period, prepared_at; items: issue_id, item_id, url, kind, category, featured, title,
    summary, reason, audience, usage_conditions, verification_level, verified_at, evidence_urls[], change_note, event_url,
    canonical_url, author, original_date, detail, retention_reason.
    """
    from curator.functions.times import local_date, period_window
    from curator.functions.urls import is_http_url

    window = F.coalesce(*[F.when(F.col("ranking_type") == r, period_window("period", r)["start_date"]) for r in K.RANKINGS])
    rows = items.join(issues.select("issue_id", "ranking_type", "period", "prepared_at", window.alias("_start")), "issue_id")
    kind, level = F.col("kind"), F.col("ranking_type")
    empty = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    event = F.col("event_url").isNotNull()
    rules = [
        one_of("kind", K.KINDS), one_of("category", K.CATEGORIES), one_of("verification_level", K.VERIFICATION_LEVELS),
        *[required(c) for c in ("title", "summary", "reason", "audience", "usage_conditions")],
        cross("featured", "required", F.col("featured").isNull(), "featured must be true or false"),
        cross("featured", "featured_reading", F.col("featured") & (kind == "reading"), "a reading cannot be featured"),
        cross("change_note", "type", F.col("change_note").isNull(), "change_note must be text, which may be empty"),
        cross("evidence_urls", "required", F.coalesce(F.size("evidence_urls"), F.lit(0)) < 1, "evidence_urls must be a nonempty array"),
        cross("evidence_urls", "url", F.exists("evidence_urls", lambda u: ~is_http_url(u)), "evidence_urls holds an invalid URL"),
        cross("verified_at", "required", F.col("verified_at").isNull(), "verified_at must be a time"),
        cross("verified_at", "order", F.col("verified_at") > F.col("prepared_at"), "verification cannot be after preparation"),
        cross("verified_at", "stale", F.unix_micros("prepared_at") - F.unix_micros("verified_at") > 86_400_000_000, "originals must be read again within a day before preparation"),
        cross("verified_at", "before_period", local_date(F.col("verified_at")) < F.col("_start"), "originals must be read again in this period or later"),
        cross("change_note", "update_unexplained", (kind == "update") & empty("change_note"), "an important update needs a change note"),
        cross("event", "required", kind.isin("update", "news") & ~event, "an update or news needs a stable event"),
        cross("evidence_urls", "event_missing", event & ~F.array_contains("evidence_urls", F.col("event_url")), "the event URL must be among the evidence"),
        cross("event", "home_page", event & ~kind.isin("reading", "news") & (F.col("event_url") == F.col("canonical_url")), "the event URL must be that of a release or update"),
        cross("author", "required", (kind == "reading") & empty("author"), "a reading needs its author"),
        cross("original_date", "required", (kind == "reading") & F.col("original_date").isNull(), "a reading needs its original date"),
        cross("detail", "required", (level == "weekly") & empty("detail"), "a weekly item needs detail"),
        cross("retention_reason", "required", (level == "monthly") & empty("retention_reason"), "a monthly item needs a retention reason"),
    ]
    return validate(rows, ["issue_id", "item_id"], rules)


MOST_OPPORTUNITIES = 2


def validate_final_issues(items: DataFrame, issues: DataFrame) -> DataFrame:
    """What a formal issue needs beyond a draft: items, the monthly minimum, and a period that has ended.

    issues: issue_id, ranking_type, period, prepared_at, screened_count, verified_count (null: not stated); items: issue_id.
    """
    from curator.functions.times import local_date, period_window

    end = F.coalesce(*[F.when(F.col("ranking_type") == r, period_window("period", r)["end_date"]) for r in K.RANKINGS])
    counted = issues.join(items.groupBy("issue_id").agg(F.count(F.lit(1)).alias("items")), "issue_id", "left").fillna(0, ["items"])
    low = lambda c: cross(c, "below_selection", F.col(c) < F.col("items"), f"{c} cannot be below the selected count")
    rules = [
        cross("items", "no_items", F.col("items") == 0, "an issue without items stays a draft"),
        cross("items", "monthly_short", (F.col("ranking_type") == "monthly") & F.col("items").between(1, ISSUE_SIZE["monthly"][0] - 1), "a monthly issue needs more items"),
        cross("period", "open", local_date(F.col("prepared_at")) <= F.col("_end"), "the natural period has not ended"),
        low("screened_count"), low("verified_count"),
    ]
    return validate(counted.withColumn("_end", end), ["issue_id"], rules)


def validate_opportunities(opportunities: DataFrame, issues: DataFrame) -> DataFrame:
    """Development opportunities of an issue: at most two, explained, and with evidence that is not from the future.

    opportunities: issue_id, problem, audience, existing_solutions, validation, evidence_urls[], evidence_date.
    """
    from curator.functions.times import local_date
    from curator.functions.urls import is_http_url

    rows = opportunities.join(issues.select("issue_id", local_date(F.col("prepared_at")).alias("_day")), "issue_id")
    each = validate(rows, ["issue_id"], [
        *[required(c) for c in ("problem", "audience", "existing_solutions", "validation")],
        cross("evidence_urls", "required", F.coalesce(F.size("evidence_urls"), F.lit(0)) < 1, "evidence_urls must be a nonempty array"),
        cross("evidence_urls", "url", F.exists("evidence_urls", lambda u: ~is_http_url(u)), "evidence_urls holds an invalid URL"),
        cross("evidence_date", "future", F.col("evidence_date") > F.col("_day"), "evidence cannot be from the future"),
    ])
    return each.unionByName(validate_groups(opportunities, ["issue_id"], {"_n": F.count(F.lit(1))}, [
        cross("opportunities", "too_many", F.col("_n") > MOST_OPPORTUNITIES, "an issue has two opportunities at most")]))


def validate_batch_sources(sources: DataFrame, key: Sequence[str]) -> DataFrame:
    """Row contract of the sources of a collection batch: name, url, status, detail (which may be empty)."""
    from curator.functions.urls import is_http_url

    return validate(sources, key, [
        required("name"), ("url", "url", ~is_http_url("url"), "url must be an HTTP(S) URL without credentials"),
        one_of("status", ("ok", "empty", "failed")), cross("detail", "type", F.col("detail").isNull(), "detail must be text, which may be empty"),
    ])


def publication_form(name: str = "published_at") -> Rule:
    """A stated publication is a date or a time with a zone; null is allowed."""
    day = F.col(name).rlike(r"^\d{4}-\d{2}-\d{2}$") & F.col(name).try_cast("date").isNotNull()
    time = F.col(name).rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$") & F.col(name).try_cast("timestamp").isNotNull()
    return (name, "form", ~(day | time), f"{name} must be a date or a time with a zone")


def validate_candidates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Row contract of collected candidates.

    df: url, title, summary, reason, category, kind, evidence_status,
    source_urls[], evidence_urls[], collected_at, discovered_at, verified_at,
    verification_level, event_id, event_url.
    """
    from curator.functions.urls import is_http_url

    verified = F.col("evidence_status") == "verified"
    bad_urls = lambda c: F.exists(F.col(c), lambda u: ~is_http_url(u))
    has_event = F.col("event_url").isNotNull()
    rules = [
        ("url", "url", ~is_http_url("url"), "url must be an HTTP(S) URL without credentials"),
        required("title"), required("summary"), required("reason"),
        one_of("category", K.CATEGORIES), one_of("kind", K.KINDS), one_of("evidence_status", ("discovered", "verified")),
        ("source_urls", "required", F.size("source_urls") < 1, "source_urls must be a nonempty array"),
        ("source_urls", "url", bad_urls("source_urls"), "source_urls holds an invalid URL"),
        ("evidence_urls", "required", verified & (F.size("evidence_urls") < 1), "verified candidates need evidence_urls"),
        ("evidence_urls", "url", bad_urls("evidence_urls"), "evidence_urls holds an invalid URL"),
        cross("discovered_at", "order", F.col("discovered_at") > F.col("collected_at"), "discovered_at cannot be after collected_at"),
        cross("verified_at", "order", verified & ~F.col("verified_at").between(F.col("discovered_at"), F.col("collected_at")), "verified_at must be between discovered_at and collected_at"),
        cross("verified_at", "unverified", ~verified & F.col("verified_at").isNotNull(), "unverified candidates require verified_at=null"),
        one_of("verification_level", K.VERIFICATION_LEVELS),
        cross("event", "required", verified & F.col("kind").isin("update", "news") & ~has_event, "a verified update or news requires a stable event"),
        *([publication_form()] if "published_at" in df.columns else []),
        cross("evidence_urls", "event_missing", verified & (F.col("kind") == "news") & has_event & ~F.array_contains("evidence_urls", F.col("event_url")), "news event URL must be included in evidence_urls"),
    ]
    return validate(df, key, rules)


def validate_decisions(decisions: DataFrame, queue: DataFrame) -> DataFrame:
    """Release decisions: known and unique keys, consistent verdicts, quoted evidence.

    decisions: release_key, decision, change_types[], changes ARRAY<STRUCT<
    summary, evidence>>, decision_reason; queue: release_key, notes.
    """
    from curator.operators.joins import match_decisions

    keyed = match_decisions(queue, decisions, "release_key").select(
        "release_key", F.lit("release_key").alias("path"), F.concat(F.lit("key_"), "problem").alias("code"), F.lit("every queued release is decided exactly once").alias("message")
    )
    accept, reject = F.col("decision") == "accept", F.col("decision") == "reject"
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    rows = validate(decisions, ["release_key"], [
        one_of("decision", ("accept", "reject")),
        cross("change_types", "enum", F.exists("change_types", lambda t: ~t.isin(*K.CHANGE_TYPES)), "unknown change type"),
        cross("changes", "accept_shape", accept & (~F.size("changes").between(1, 3) | (F.size("change_types") == 0)), "accept needs one to three changes with types"),
        cross("changes", "reject_shape", reject & ((F.size("changes") > 0) | (F.size("change_types") > 0)), "reject cannot contain changes"),
        cross("changes", "summary", F.exists("changes", lambda c: blank(c["summary"])), "a change needs a summary"),
        required("decision_reason"),
    ])
    quoted = decisions.select("release_key", F.explode("changes").alias("c")).select("release_key", F.col("c.evidence").alias("evidence"))
    notes = queue.select("release_key", normalize_evidence("notes").alias("_notes"))
    missing = quoted.withColumn("_e", normalize_evidence("evidence")).join(notes, "release_key").where(
        (F.col("_e") == "") | ~F.contains("_notes", "_e")
    ).select("release_key", F.lit("changes.evidence").alias("path"), F.lit("evidence_not_in_notes").alias("code"), F.lit("evidence must quote the release notes").alias("message"))
    return keyed.unionByName(rows).unionByName(missing)


def validate_assessments(df: DataFrame, key: Sequence[str] = ("candidate_id",)) -> DataFrame:
    """Score assessments: shapes, ranges, citations and flag policy.

    df: kind, ranking_type, allowed_urls[], precheck, precheck_refs[], scores
    ARRAY<STRUCT<dimension, score, reason, refs>> (null = none), flags
    ARRAY<STRUCT<code, reason, refs, basis_kind, basis_quote, basis_url, gap>>,
    texts MAP<url, text> of the supplied originals, reason.
    """
    dims = F.array(*[F.lit(d) for d in sorted(K.DIMENSIONS)])
    scored = F.col("scores").isNotNull()
    foreign = lambda refs: F.size(F.array_except(refs, F.col("allowed_urls"))) > 0
    table = lambda pairs: F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]) if isinstance(v, tuple) else F.lit(v))])
    kinds = table(K.FLAG_KINDS)
    basis = table(K.FLAG_BASIS)
    gaps = F.try_element_at(table(K.USAGE_GAPS), F.col("ranking_type"))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    any_flag = lambda broken: F.exists("flags", broken)
    codes = F.transform("flags", lambda f: f["code"])
    rules = [
        one_of("precheck", ("PASS", "UNKNOWN", "BLOCK")),
        cross("precheck_refs", "foreign_ref", foreign(F.col("precheck_refs")), "a citation is not in the supplied material"),
        cross("precheck_refs", "required", (F.col("precheck") != "UNKNOWN") & (F.size("precheck_refs") == 0), "a settled precheck cites a source"),
        cross("scores", "pass_without_scores", (F.col("precheck") == "PASS") & ~scored, "PASS needs scores"),
        cross("scores", "no_material", scored & (F.size("allowed_urls") == 0), "scores need readable material"),
        cross("scores", "dimensions", scored & (F.array_sort(F.transform("scores", lambda s: s["dimension"])) != dims), "exactly the five dimensions are scored"),
        cross("scores", "range", scored & F.exists("scores", lambda s: ~F.coalesce(s["score"].between(0, 10), F.lit(False))), "a score is an integer from 0 to 10"),
        cross("scores", "reason", scored & F.exists("scores", lambda s: blank(s["reason"])), "a score needs a reason"),
        cross("scores", "foreign_ref", scored & F.exists("scores", lambda s: (F.size(s["refs"]) == 0) | foreign(s["refs"])), "a score cites supplied sources"),
        cross("flags", "unknown_code", any_flag(lambda f: ~f["code"].isin(*K.FLAG_CAPS)), "unknown flag"),
        cross("flags", "repeated", F.size(F.array_distinct(codes)) < F.size(codes), "a flag occurs once"),
        cross("flags", "kind", any_flag(lambda f: ~F.coalesce(F.array_contains(F.try_element_at(kinds, f["code"]), F.col("kind")), F.lit(True))), "flag does not apply to the kind"),
        cross("flags", "basis_kind", any_flag(lambda f: F.coalesce(f["basis_kind"] != F.try_element_at(basis, f["code"]), f["code"].isin(*K.FLAG_BASIS))), "flag basis kind differs from the policy"),
        cross("flags", "basis_ref", any_flag(lambda f: ~F.coalesce(F.array_contains(f["refs"], f["basis_url"]), F.lit(False))), "flag basis cites one of the flag's sources"),
        cross("flags", "basis_quote", any_flag(lambda f: ~F.coalesce(F.contains(F.try_element_at(F.col("texts"), f["basis_url"]), f["basis_quote"]), F.lit(False))), "flag basis quote is not in the original"),
        cross("flags", "gap", any_flag(lambda f: (f["code"] == "insufficient_usage_evidence") & ~F.coalesce(F.array_contains(gaps, f["gap"]), F.lit(False))), "evidence gap does not apply to the level"),
        cross("flags", "foreign_ref", any_flag(lambda f: (F.size(f["refs"]) == 0) | foreign(f["refs"])), "a flag cites supplied sources"),
        required("reason"),
    ]
    return validate(df, key, rules)


_POSITIVE = ("supported", "editorial_judgment")
_NEGATIVE = ("not_supported", "scope_conflict")


def validate_checks(units: DataFrame, statements: DataFrame, checks: DataFrame) -> DataFrame:
    """Statement checks of reason units: complete, cited, and consistent.

    units: unit_id, verdict, passage_ids[]; statements: unit_id, statement_id;
    checks: unit_id, statement_id, status, passage_ids[].
    """
    given = checks.groupBy("unit_id").agg(F.bool_or(F.col("status").isin(*_NEGATIVE)).alias("_negative"))
    unit_rules = validate(units.join(given, "unit_id", "left"), ["unit_id"], [
        one_of("verdict", ("accept", "defer")),
        cross("verdict", "contradiction", (F.col("verdict") == "defer") != F.coalesce("_negative", F.lit(False)), "the verdict contradicts its checks"),
    ])
    expected = statements.select("unit_id", "statement_id").withColumn("_e", F.lit(True))
    answered = checks.groupBy("unit_id", "statement_id").agg(F.count(F.lit(1)).alias("_n"))
    coverage = validate(expected.join(answered, ["unit_id", "statement_id"], "full_outer"), ["unit_id"], [
        cross("checks", "statement_unchecked", F.col("_n").isNull(), "a statement has no check"),
        cross("checks", "statement_repeated", F.col("_n") > 1, "a statement has several checks"),
        cross("checks", "statement_unknown", F.col("_e").isNull(), "a check names an unknown statement"),
    ])
    supplied = units.select("unit_id", F.col("passage_ids").alias("_supplied"))
    row_rules = validate(checks.join(supplied, "unit_id"), ["unit_id"], [
        one_of("status", _POSITIVE + _NEGATIVE),
        cross("passage_ids", "required", F.col("status").isin("supported", "scope_conflict") & (F.size("passage_ids") == 0), "the status needs a passage"),
        cross("passage_ids", "foreign", F.size(F.array_except("passage_ids", "_supplied")) > 0, "a passage was not supplied"),
    ])
    return unit_rules.unionByName(coverage).unionByName(row_rules)


def uncovered_units(units: DataFrame, checks: DataFrame) -> DataFrame:
    """Reason units whose excerpt checks leave written words unchecked.

    units: unit_id, text; checks: unit_id, text (an exact excerpt). Every
    occurrence of an excerpt counts; punctuation and space need no check.
    """
    from curator.functions.spans import running_sums
    from curator.operators.windows import merge_intervals

    text, piece = F.col("text"), F.col("excerpt")
    # Cut before every occurrence, overlapping ones too: each part but perhaps the first starts one.
    quoted = F.concat(F.lit("(?=\\Q"), F.replace(piece, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    starts = running_sums(F.transform(F.split(text, quoted), lambda part: F.length(part)))
    held = F.when(F.length(piece) == 0, F.array().cast("array<int>")).when(F.startswith(text, piece), starts).otherwise(F.slice(starts, F.lit(2), F.size(starts)))

    excerpts = checks.select("unit_id", F.col("text").alias("excerpt")).distinct()
    placed = units.join(excerpts, "unit_id").select("unit_id", F.length(piece).alias("size"), held.alias("starts"))
    unknown = placed.where(F.size("starts") == 0).select("unit_id", F.lit("excerpt_not_in_text").alias("code"))
    found = placed.select("unit_id", F.explode("starts").alias("start"), "size").select("unit_id", "start", (F.col("start") + F.col("size")).cast("int").alias("end"))
    # Disjoint ranges of a unit: fewer than its characters.
    ranges = merge_intervals(found, ["unit_id"], "start", "end").groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("r"))
    # What lies before, between and after the merged ranges.
    lows = F.concat(F.array(F.lit(0)), F.transform("r", lambda x: x["end"]))
    highs = F.concat(F.transform("r", lambda x: x["start"]), F.array(F.length(text)))
    parts = F.zip_with(lows, highs, lambda a, b: F.substring(text, a + 1, b - a))
    judged = units.join(ranges, "unit_id", "left").withColumn("r", F.coalesce("r", F.array().cast("array<struct<start:int,end:int>>")))
    left = F.exists(parts, lambda part: part.rlike(r"(?U)[^\p{P}\p{C}\p{Z}\s]"))
    return unknown.unionByName(judged.where(left).select("unit_id", F.lit("text_uncovered").alias("code")))


def validate_bindings(df: DataFrame, frozen: DataFrame, key: Sequence[str], bound: Sequence[str]) -> DataFrame:
    """Values that differ from their frozen snapshot, and rows that have none."""
    old = frozen.select(*key, *[F.col(b).alias(f"_{b}") for b in bound], F.lit(True).alias("_known"))
    rules = [cross("key", "unbound", F.col("_known").isNull(), "no frozen snapshot for this row")]
    rules += [
        cross(b, "changed", F.col("_known").isNotNull() & ~F.col(b).eqNullSafe(F.col(f"_{b}")), f"{b} differs from the frozen value") for b in bound
    ]
    return validate(df.join(old, list(key), "left"), key, rules)


def validate_lifecycle(log: DataFrame) -> DataFrame:
    """Experiment results and confirmations against the approvals in one log.

    log: run_id, event ('approved', 'result', 'confirmed'), at, binding (hash of
    the approved state), criteria (ordered names joined), result_hash. Judged
    from per-run aggregates: a run with many entries costs no more per row.
    """
    kind = lambda e: F.col("event") == e
    one = lambda e, c: F.max(F.when(kind(e), F.col(c)))
    least = lambda e, c: F.min(F.when(kind(e), F.col(c)))
    runs = log.groupBy("run_id").agg(
        *[F.count_if(kind(e)).alias(f"n_{e}") for e in ("approved", "result", "confirmed")],
        one("approved", "binding").alias("a_binding"), least("result", "binding").alias("r_binding"), one("result", "binding").alias("r_binding_max"),
        one("approved", "criteria").alias("a_criteria"), least("result", "criteria").alias("r_criteria"), one("result", "criteria").alias("r_criteria_max"),
        one("approved", "at").alias("approved_at"), least("result", "at").alias("first_result_at"),
        least("result", "result_hash").alias("r_hash"), one("result", "result_hash").alias("r_hash_max"),
        least("confirmed", "result_hash").alias("c_hash"), one("confirmed", "result_hash").alias("c_hash_max"),
    )
    has = lambda e: F.col(f"n_{e}") > 0
    single = F.col("n_approved") == 1
    return validate(runs, ["run_id"], [
        cross("result", "approval_count", has("result") & ~single, "a result needs exactly one approval"),
        cross("result", "binding", has("result") & single & ((F.col("r_binding") != F.col("a_binding")) | (F.col("r_binding_max") != F.col("a_binding"))), "the result does not match the approved state"),
        cross("result", "order", has("result") & single & (F.col("first_result_at") < F.col("approved_at")), "a result cannot precede its approval"),
        cross("result", "criteria", has("result") & single & ((F.col("r_criteria") != F.col("a_criteria")) | (F.col("r_criteria_max") != F.col("a_criteria"))), "every approved criterion is reported in order"),
        cross("result", "conflict", has("result") & (F.col("r_hash") != F.col("r_hash_max")), "a recorded result cannot be replaced"),
        cross("confirmed", "result_count", has("confirmed") & (~has("result") | (F.col("r_hash") != F.col("r_hash_max"))), "a confirmation needs exactly one result"),
        cross("confirmed", "conflict", has("confirmed") & has("result") & ((F.col("c_hash") != F.col("r_hash")) | (F.col("c_hash_max") != F.col("r_hash"))), "the confirmation names another result"),
    ])


def scope_overclaims(claims: DataFrame, documents: DataFrame) -> DataFrame:
    """Claims of having read a whole source where every cited source is an excerpt.

    claims: claim_id, text, refs[]; documents: evidence_url, coverage.
    """
    stated = claims.where(F.col("text").rlike(K.FULL_READ) & ~F.col("text").rlike(K.NOT_A_READ_CLAIM))
    cited = stated.select("claim_id", F.explode(F.array_distinct("refs")).alias("evidence_url"))
    judged = cited.join(documents.select("evidence_url", "coverage"), "evidence_url", "left")
    only = judged.groupBy("claim_id").agg(F.bool_and(F.coalesce(F.col("coverage") == "excerpt", F.lit(False))).alias("_only"))
    return judged.join(only.where("_only"), "claim_id").select("claim_id", "evidence_url", "coverage")


def fit_budget(df: DataFrame, columns: Sequence[str], budget: int | Column, overhead: Column, ceiling: int = 500, lowest: int = 8) -> DataFrame:
    """Shorten prose columns by one common ceiling until the whole set fits.

    Text is left whole if it fits, else the ceiling halves down to `lowest`; the
    size at every step comes from one aggregate. `budget` is a number or a
    scalar subquery, `overhead` is the size of a row
    without its prose; rows are never dropped. No ceiling that fits leaves all
    text null, which callers must treat as an error.
    """
    steps = [None]
    while ceiling // 2 >= lowest:
        ceiling //= 2
        steps.append(ceiling)
    cut = lambda c, n: F.length(c) if n is None else F.when(F.length(c) > n, n + 1).otherwise(F.length(c))
    sizes = df.agg(*[
        (F.sum(overhead + sum((F.coalesce(cut(c, n), F.lit(0)) for c in columns), F.lit(0)))).alias(f"s{i}") for i, n in enumerate(steps)
    ])
    chosen = F.coalesce(*[F.when(F.col(f"s{i}") <= budget, F.lit(i)) for i in range(len(steps))])
    step = sizes.select(chosen.alias("_step")).scalar()

    def shortened(c: str) -> Column:
        out = F.lit(None).cast("string")
        for i, n in enumerate(steps):
            value = F.col(c) if n is None else F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(F.col(c))
            out = F.when(F.col("_step") == i, value).otherwise(out)
        return out

    return df.withColumn("_step", step).select(*[c for c in df.columns if c not in columns], *[shortened(c).alias(c) for c in columns])
