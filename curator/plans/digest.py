"""Digest issue: candidates -> scores -> decisions -> selected items -> Markdown lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curator.functions.expr import let
from curator.operators.filters import eligibility
from curator.operators.ledger import candidate_query
from curator.operators.scoring import decide, profile_of, weighted_score
from curator.operators.topk import rotating_page, select_issue
from curator.runtime import materialize

# Candidates screened and items published per ranking level.
SCREENED = {"daily": 30, "weekly": 80, "monthly": 150}
PUBLISHED = {"daily": 8, "weekly": 25, "monthly": 30}


def screening_page(candidates: DataFrame, ranking_type: str, period: str) -> DataFrame:
    """The candidates looked at for one issue; blocked ones never take a place."""
    # Paging reads the candidates several times, and the short page is read again later.
    open_ = materialize(
        candidates.where("selection_status <> 'blocked'").withColumn("ranking_type", F.lit(ranking_type)).withColumn("period", F.lit(period)),
        "open-candidates",
    )
    return materialize(rotating_page(open_, ["ranking_type", "period"], ["canonical_url"], SCREENED[ranking_type]), "screening-page")


def judged(candidates: DataFrame, assessments: DataFrame) -> DataFrame:
    """Candidates with total score and decision.

    candidates: candidate_id, kind, category, evidence_status, selection_status,
    selection_block; assessments: candidate_id, precheck, scores, flags,
    has_context (null when nothing was judged).
    """
    joined = candidates.join(assessments, "candidate_id").withColumn("profile", profile_of(F.col("kind"), F.col("category")))
    scored = weighted_score(joined)
    state = let(
        eligibility(F.col("selection_block"), F.col("selection_status"), F.col("evidence_status"), F.col("has_context")), lambda e: e["state"]
    )
    return scored.withColumn("decision", decide(F.col("precheck"), state, F.col("flags"), F.col("total_score")))


def issue(obs: DataFrame, history: DataFrame, assessments: DataFrame, ranking_type: str, period: str) -> DataFrame:
    """The selected items of one issue, best first, featured ones marked.

    obs additionally holds candidate_id and category; see ledger.candidate_query.
    """
    candidates, _ = candidate_query(obs, history, ranking_type, period)
    page = screening_page(candidates, ranking_type, period)
    selected = judged(page, assessments).where("decision = 'select'").withColumn("total", F.col("total_score"))
    return select_issue(selected, PUBLISHED[ranking_type])
