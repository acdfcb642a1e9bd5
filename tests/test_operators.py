"""Filters, scores, decisions and contracts on the cases that define them."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from curator import constants as K
from curator.operators import aggregates, filters, joins, scoring, sets, validation
from curator.operators.evaluation import completeness, impact_projects


@pytest.mark.parametrize("tag, prerelease, expected", [
    ("v1.2.3", False, []), ("v1.2.3-rc1", False, ["prerelease_tag", "tag_not_allowed"]), ("V2.0", None, []), ("v1.2.3", True, ["prerelease_tag"]),
    ("nightly", False, ["prerelease_tag", "tag_not_allowed"]), ("v0.9", False, ["tag_excluded"]), ("xv1.0", False, ["tag_not_allowed"]),
])
def test_release_filter(spark, tag, prerelease, expected):
    sources = spark.createDataFrame([("s", [r"v\d+(\.\d+)+"], [r"^v0\."])], "source_id string, accepted_tag_patterns array<string>, excluded_tag_patterns array<string>")
    df = spark.createDataFrame([("s", tag, prerelease, "u", "d", "n")], "source_id string, release_tag string, prerelease boolean, url string, published_at string, notes string")
    row = filters.filter_releases(df, sources).collect()[0]
    assert (row["reasons"], row["eligible"]) == (expected, not expected)


def test_late_news_needs_its_own_page(one):
    ok = lambda evidence, first: filters.period_eligible(
        F.lit("news"), F.lit("verified"), F.lit("2024-01-10 12:00:00").cast("timestamp"), F.lit(None).cast("date"), F.lit("https://e/"), F.array(F.lit(evidence)),
        F.lit(first).cast("timestamp"), F.lit("2024-01-08").cast("date"), F.lit("2024-01-14").cast("date"),
    )
    assert one(ok("https://e/", "2024-02-01")) and not one(ok("https://x/", "2024-02-01")) and one(ok("https://x/", "2024-01-14 15:59:59"))
    assert not one(ok("https://x/", "2024-01-14 16:00:00"))


@pytest.mark.parametrize("work, status, sources, age, total", [
    (True, "primary", 1, 0.5, 93), (False, "discovery_only", 1, 8, 9), (True, "multi_source", 3, 2, 85), (False, "insufficient", 2, 5, 48),
])
def test_additive_score(spark, work, status, sources, age, total):
    df = spark.createDataFrame(
        [("e", "An agent tool" if work else "Plain words", status, sources, False, False, datetime.fromtimestamp(1_700_000_000 - int(age * 86400)))],
        "event_id string, canonical_title string, evidence_status string, source_count bigint, body_workflow boolean, body_weak boolean, latest_published_at timestamp",
    )
    row = scoring.score_stories(df, F.timestamp_seconds(F.lit(1_700_000_000))).collect()[0]
    assert row["total"] == total
    assert set(row["components"].asDict()) == set(K.SCORE_WEIGHTS)
    assert (row["penalties"] == {"discovery_only": -20}) == (status == "discovery_only")


def test_recent_decision_costs_twenty(spark):
    df = spark.createDataFrame([("e", "Stock news rumor", "primary", 1, False, False, None)],
                               "event_id string, canonical_title string, evidence_status string, source_count bigint, body_workflow boolean, body_weak boolean, latest_published_at timestamp")
    plain = scoring.score_stories(df, F.current_timestamp()).collect()[0]
    recent = scoring.score_stories(df, F.current_timestamp(), df.select("event_id")).collect()[0]
    assert plain["total"] - recent["total"] == 20 and len(recent["penalty_reasons"]) == 3


def test_caps_apply_in_flag_order(spark):
    df = spark.createDataFrame([("reading", (9, 9, 9, 9, 9), ["unclear_usage", "unsupported_promotion", "insufficient_usage_evidence"])],
                               "profile string, scores struct<value:int,novelty:int,evidence:int,usability:int,interest:int>, flags array<string>")
    row = scoring.weighted_score(df).collect()[0]
    assert (row["raw_score"], row["total_score"]) == (90, 3 * 4 + 3 * 9 + 2 * 3 + 3 + 9)
    assert [(c["flag"], c["dimension"], c["from"], c["to"]) for c in row["applied_caps"]] == [
        ("unclear_usage", "usability", 9, 3), ("unsupported_promotion", "value", 9, 4), ("unsupported_promotion", "evidence", 9, 3)
    ]


@pytest.mark.parametrize("precheck, state, flags, total, expected", [
    ("BLOCK", "available", [], 90, "reject"), ("UNKNOWN", "available", [], 90, "defer"), ("PASS", "needs_evidence", [], 90, "defer"), ("PASS", "available", ["reader_mismatch"], 90, "defer"),
    ("PASS", "available", ["routine_update"], 65, "select"), ("PASS", "available", [], 44, "reject"), ("PASS", "available", [], 45, "defer"), ("PASS", "available", [], None, "defer"),
])
def test_decisions(one, precheck, state, flags, total, expected):
    marks = F.array(*[F.lit(f) for f in flags]) if flags else F.array().cast("array<string>")
    assert one(scoring.decide(F.lit(precheck), F.lit(state), marks, F.lit(total).cast("int"))) == expected


def test_routing(one):
    why = lambda conf, score: one(scoring.escalation_reasons(F.lit("PASS"), F.array(*[F.lit(c).cast("double") for c in conf]), F.lit(score).cast("int")))
    assert why([0.9, 0.8], 55) == [] and why([0.9, None], 55) == ["low_confidence"] and why([0.9], 60) == ["near_threshold"] and why([0.9], None) == []


def dedup(spark, candidate, history):
    c = spark.createDataFrame([candidate], "row_id int, canonical_url string, kind string, event_id string, event_url string, reported_url string, earliest timestamp")
    h = spark.createDataFrame(history, "canonical_url string, h_seq int, h_event_id string, h_event_url string, h_latest timestamp, h_verified_at timestamp, h_evidence array<string>")
    return scoring.dedup_verdict(c, h).collect()[0]["selection_block"]


def test_dedup_verdicts(spark):
    old, mid, new = datetime(2024, 1, 1), datetime(2024, 2, 1), datetime(2024, 3, 1)
    event = ("u", 1, "i1", "e1", mid, mid, ["e1"])
    intro = ("u", 2, None, None, None, old, ["x1"])
    case = lambda kind, eid, eurl, at, hist, reported=None: dedup(spark, (1, "u", kind, eid, eurl, reported or eurl, at), hist)
    assert case("project", None, None, None, []) is None
    assert case("project", None, None, None, [intro]) == scoring.ALREADY
    assert case("update", "i1", "e9", new, [event, intro]) == scoring.SAME_EVENT
    assert case("update", "i2", "e2", mid, [event, intro]) == scoring.NOT_NEWER
    assert case("update", "i2", "e2", new, [event, intro]) is None
    assert case("update", "i2", "x1", new, [event, intro]) == scoring.EVIDENCE_USED
    assert dedup(spark, (1, "other", "reading", None, None, "e1", None), [event]) == scoring.CROSS_URL
    # The newest history entry speaks first.
    assert case("update", "i3", "x1", mid, [event, intro]) == scoring.NOT_NEWER


def test_admission_conditions(spark):
    metrics = "struct<screened_candidate_count:int,deep_read_count:int,search_query_count:int,direct_candidate_count:int,adjacent_candidate_count:int,selected_repository:string>"
    schema = f"seq int, event string, status string, run_id string, entry_mode string, feedback string, error_class string, attempt_sha256 string, discovery_metrics {metrics}"
    good, crowded = (10, 2, 2, 8, 2, "a/b"), (10, 2, 2, 7, 3, "a/b")
    rows = [(i, "learning_finalized", "success", f"r{i}", "discovered" if i < 4 else "nominated", None, None, None, (good if i else crowded)) for i in range(11)]
    rows += [(20 + i, "feedback_recorded", None, f"r{i}", None, "watch", None, None, None) for i in range(7)]
    rows += [(40, "learning_review_failed", None, "r1", None, None, "dual_evidence", "x", None)] * 2
    row = aggregates.admission(spark.createDataFrame(rows, schema)).collect()[0]
    assert (row["completed_runs"], row["discovered_runs"], row["nominated_runs"], row["positive_feedback_runs"], row["dual_evidence_errors"]) == (10, 3, 7, 6, 1)
    assert row["eligible_for_automation"] and row["unmet_requirements"] == []


def test_impact_evidence(spark):
    schema = "project_id string, path string, line_start int, line_end int, symbol string"
    pred = spark.createDataFrame([("p", "/root/Repo/src/A.py", 10, 20, None), ("p", "src/b.py", None, None, "Sym"), ("q", "src/a.py", 1, 2, None)], schema)
    gold = spark.createDataFrame([(1, "p", "src\\a.py", 20, 30, None), (2, "p", "src/a.py", 21, 30, None), (3, "p", "b.py", 500, 600, "Sym"), (4, "q", "xsrc/a.py", 1, 2, None)], "gold_id int, " + schema)
    found = joins.match_evidence(pred, gold)
    assert sorted(r["gold_id"] for r in found.collect()) == [1, 3]
    assert completeness(gold, found).collect()[0]["completeness"] == 0.5
    pairs = lambda *xs: spark.createDataFrame(list(xs), "case_id string, project_id string")
    score = impact_projects(pairs(("c1", "a"), ("c2", "b")), pairs(("c1", "x")), pairs(("c1", ""), ("c2", ""))).collect()[0]
    assert (score["true_positive_projects"], score["critical_misses"], score["repeated_critical_misses"], score["project_recall"]) == (0, 2, True, 0.0)


def test_uncovered_words(spark):
    units = spark.createDataFrame([(1, "One fact. Two facts!"), (2, "One fact. Two facts!"), (3, "abc")], "unit_id int, text string")
    checks = spark.createDataFrame([(1, "One fact"), (1, "Two facts"), (2, "Two facts"), (3, "xyz"), (3, "abc")], "unit_id int, text string")
    got = sorted((r["unit_id"], r["code"]) for r in validation.uncovered_units(units, checks).collect())
    assert got == [(2, "text_uncovered"), (3, "excerpt_not_in_text")]


def test_reading_claims(spark):
    claims = spark.createDataFrame([
        (1, "We reviewed the full license text.", ["e"]), (2, "已经完整阅读了许可证全文", ["e"]), (3, "Please read the full document", ["e"]), (4, "read the entire readme", ["e", "c"]), (5, "尚未阅读完全文", ["e"]),
    ], "claim_id int, text string, refs array<string>")
    docs = spark.createDataFrame([("e", "excerpt"), ("c", "complete_text")], "evidence_url string, coverage string")
    assert sorted(r["claim_id"] for r in validation.scope_overclaims(claims, docs).collect()) == [1, 2]


def test_merge_and_sets(spark):
    prior = spark.createDataFrame([("a",), ("b",)], "k string")
    decided = spark.createDataFrame([("b", "reject"), ("c", "accept"), ("a", "accept")], "k string, decision string")
    assert sorted(r["k"] for r in sets.merge_accepted(prior, decided, "k").collect()) == ["a", "c"]
    assert sets.same_set(prior, prior, ["k"]).collect()[0]["same"] is True


@pytest.mark.usefixtures("small_ranges")
def test_medians_by_selection(spark, monkeypatch):
    import math
    import random
    import statistics

    rng, values = random.Random(2), {}
    values["even"] = [rng.random() for _ in range(4000)]
    values["skewed"] = [math.exp(rng.gauss(0, 12)) for _ in range(3001)] + [1e300, -1e300]
    values["equal"] = [3.5] * 2000
    values["two"] = [1.0] * 1000 + [2.0] * 1000
    values["near"] = [1.0 + i * 2**-52 for i in range(501)]
    values["single"] = [-7.25]
    values[None] = [float(rng.randrange(5)) for _ in range(900)]
    df = spark.createDataFrame([(g, v) for g, own in values.items() for v in own] + [("gone", None)], "g string, v double").repartition(5)
    passes, write = [], aggregates.materialize
    monkeypatch.setattr(aggregates, "materialize", lambda d, label: passes.append(label) or write(d, label))
    got = {r.g: r.median for r in aggregates.exact_median(df, ["g"], "v").collect()}
    assert got == {g: statistics.median(own) for g, own in values.items()} and 2 < len(passes) < 90
    whole = aggregates.exact_median(df, [], "v").first().median
    assert whole == statistics.median([v for own in values.values() for v in own])
    odd = spark.createDataFrame([(float(i),) for i in range(2000)] + [(math.inf,), (-math.inf,), (math.nan,)], "v double")
    assert aggregates.exact_median(odd, [], "v").first().median == 1000.0


def test_exact_median(spark):
    df = spark.createDataFrame([("a", float(i)) for i in (5, 1, 9, 3)] + [("b", 2.0), ("b", None), ("b", 7.0), ("b", 4.0)], "g string, v double")
    assert {r["g"]: r["median"] for r in aggregates.exact_median(df, ["g"], "v").collect()} == {"a": 4.0, "b": 4.0}


def test_line_cells(spark):
    """Coverage by masks against plain sets, ranges over several cells included."""
    import random

    rng = random.Random(3)
    lines = [(rng.choice("ab"), rng.randrange(400)) for _ in range(500)]
    facts = [(rng.choice("ab"), i, s := rng.randrange(400), s + rng.randrange(150), i % 2 == 0) for i in range(60)]
    out = aggregates.fact_coverage(
        spark.createDataFrame(lines, "file string, line int"), spark.createDataFrame(facts, "file string, fact_id int, line_start int, line_end int, critical boolean"), ["file"]
    )
    held = set(lines)
    got = {r["fact_id"]: (r["covered_lines"], r["hit"]) for r in out.collect()}
    for f, i, a, b, _ in facts:
        n = sum((f, x) in held for x in range(a, b + 1))
        assert got[i] == (n, n == b - a + 1)


def test_one_file_name_in_all_folders(spark):
    schema = "project_id string, path string, line_start int, line_end int, symbol string"
    pred = spark.createDataFrame([("p", f"repo/m{i}/__init__.py", 1, 5, "") for i in range(300)], schema)
    gold = spark.createDataFrame([(f"m{i}/__init__.py", i, 3 if i % 2 else 9) for i in range(300)], "path string, gold_id int, line_start int").selectExpr(
        "'p' as project_id", "path", "gold_id", "line_start", "line_start as line_end", "'' as symbol")
    found = joins.match_evidence(pred, gold)
    assert {r["gold_id"] for r in found.collect()} == {i for i in range(300) if i % 2}
    bogus = pred.limit(1).withColumn("line_end", F.lit(2_000_000_000))
    with pytest.raises(Exception, match="line range is too long"):
        joins.match_evidence(bogus, gold).collect()


def test_a_batch_that_contradicts_itself_is_refused(spark, tmp_path):
    from curator.operators import ledger

    path = str(tmp_path / "log")
    rows = lambda *r: spark.createDataFrame(r, "run_id string, content_hash string")
    rows(("a", "1")).write.parquet(path)
    assert ledger.append_state(rows(("a", "1"), ("b", "2"), ("b", "2")), path, "run_id", "content_hash") == 1
    for bad in (rows(("c", "1"), ("c", "2"), ("c", "1")), rows(("a", "2"))):
        with pytest.raises(ValueError, match="already exists with different content"):
            ledger.append_state(bad, path, "run_id", "content_hash")
    assert sorted(r["run_id"] for r in ledger.read_state(spark, path, rows(("a", "1")).schema).collect()) == ["a", "b"]


@pytest.mark.parametrize("seed", range(3))
def test_recent_decisions_against_all_pairs(spark, seed):
    import datetime
    import random

    from curator.operators.similarity import recently_decided

    rng, start = random.Random(seed), datetime.date(2023, 12, 1)
    title = lambda: sorted({f"w{rng.randrange(25)}" for _ in range(rng.randrange(0, 7))})
    day = lambda: start + datetime.timedelta(days=rng.randrange(60)) if rng.random() < 0.95 else None
    stories, decided = [(i, title(), day()) for i in range(150)], [(title(), day()) for _ in range(120)]
    got = recently_decided(
        spark.createDataFrame(stories, "id int, features array<string>, run_date date"), spark.createDataFrame(decided, "features array<string>, decided_on date"), 0.4, 7)
    alike = lambda a, b: bool(a and b) and len({*a} & {*b}) / len({*a} | {*b}) >= 0.4
    want = [i for i, f, d in stories if d and any(o and 1 <= (d - o).days <= 7 and alike(f, g) for g, o in decided)]
    assert sorted(r.id for r in got.collect()) == want and 5 < len(want) < 140


def test_of_two_conflicting_writers_one_fails(spark, tmp_path, monkeypatch):
    from curator.operators import commits, ledger

    path, commit = str(tmp_path / "log"), commits.commit
    rows = lambda *r: spark.createDataFrame(r, "run_id string, content_hash string")
    schema = rows(("a", "1")).schema
    assert ledger.append_state(rows(("a", "1")), path, "run_id", "content_hash") == 1

    def raced(other):
        def slower(*args):
            monkeypatch.setattr(commits, "commit", commit)
            ledger.append_state(other, path, "run_id", "content_hash")  # commits between check and commit
            return commit(*args)

        monkeypatch.setattr(commits, "commit", slower)

    raced(rows(("b", "2")))
    with pytest.raises(ValueError, match="different content"):
        ledger.append_state(rows(("b", "3"), ("c", "1")), path, "run_id", "content_hash")
    raced(rows(("d", "1")))
    assert ledger.append_state(rows(("d", "1"), ("e", "1")), path, "run_id", "content_hash") == 1
    seen = lambda v=None: sorted(tuple(r) for r in ledger.read_state(spark, path, schema, v).collect())
    assert seen() == [("a", "1"), ("b", "2"), ("d", "1"), ("e", "1")]
    # A version stays what it was, and rows without a commit belong to none.
    assert seen(1) == [("a", "1")] and seen(0) == []
    rows(("z", "9")).write.parquet(f"{path}/{commits.new_folder()}")
    assert len(seen()) == 4 and not commits.commit(spark, path, 2, [])


def test_rules_come_from_a_table(spark):
    from curator.policy import ScoreConfig, SelectionPolicy

    table = spark.createDataFrame([("7", "weight", "novelty", "", "1"), ("7", "noise_term", "x", "", ""), ("7", "threshold", "select_at", "", "90"), ("8", "weight", "no", "", "1")],
                                  "version string, section string, name string, item string, value string")
    config, policy = ScoreConfig.from_table(table, "7"), SelectionPolicy.from_table(table, "7")
    assert config.weights["novelty"] == 1 and config.noise_terms == ("x",) and config.penalties == K.SCORE_PENALTIES
    assert policy.select_at == 90 and policy.profiles == K.PROFILES
    for version in ("8", "9"):
        with pytest.raises(ValueError):
            ScoreConfig.from_table(table, version)


def test_an_advisory_meets_one_source_per_key(spark):
    sources = [(i, 1000 - i, "o/shared" if i % 2 else f"o/r{i}", ["Pkg", f"p{i}"]) for i in range(60)] + [(None, None, "o/r2", ["null"])]
    advisories = [(f"h{i}", "https://GitHub.com/o/shared/", ["x"]) for i in range(40)] + [("a", "", ["PKG", "p3"]), ("b", "https://github.com/o/r4", None), ("c", None, ["P7"]), ("d", "", ["null"])]
    found = joins.map_advisories(
        spark.createDataFrame(advisories, "advisory_id string, location string, packages array<string>"),
        spark.createDataFrame(sources, "source_id long, ord long, repository string, aliases array<string>"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [_key") == 2  # both kinds of key are reduced to their first source before they meet advisories
    got = {r.advisory_id: r.source_id for r in found.collect()}
    assert got == {f"h{i}": 59 for i in range(40)} | {"a": 59, "b": 4, "c": 7, "d": None}


def test_costly_rows_of_one_file_are_dealt_over_all_cores(spark, tmp_path):
    import __spark_entry__ as entry

    spark.range(400).selectExpr("id as p_partkey", "'Brand#1' as p_brand", "'red ring' as p_name", "cast(id as int) as p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(400).selectExpr(
        "id as event_id", "'view' as event_type", "id as user_id", "cast(id as double) as value", "timestamp '2024-01-01' as ts", """concat('{"k": ', id, '}') as props"""
    ).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    for name in ("f16_classify_repo_url", "v01_candidate_contract"):
        found = entry.queries()[name](spark, str(tmp_path))
        assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and found.count() > 0
