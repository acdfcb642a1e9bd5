"""Daily story ranking: items -> clusters -> scored stories -> report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curator.constants import RECENT_DAYS, RECENT_THRESHOLD, TITLE_THRESHOLD, WINDOW_HOURS
from curator.functions.text import title_features
from curator.operators.aggregates import stories_from_clusters
from curator.operators.clustering import cluster_items
from curator.operators.scoring import mark_aggregates, score_stories, term_marks
from curator.operators.similarity import recently_decided
from curator.operators.topk import top_n
from curator.plans.items import page_items
from curator.policy import ScoreConfig
from curator.runtime import materialize, shuffled


def story_members(items: DataFrame, threshold: float = TITLE_THRESHOLD, hours: float = WINDOW_HOURS) -> DataFrame:
    """Items with the cluster they belong to."""
    slim = items.select("id", "url", "features", "published_at")
    return items.join(shuffled(cluster_items(slim, threshold, hours)), "id")


def rank_stories(items: DataFrame, as_of: Column, top: int, decisions: DataFrame | None = None, config: ScoreConfig | None = None) -> DataFrame:
    """The best `top` linked stories with their score explained.

    items: see plans.items; decisions: title, decided_on of earlier choices;
    config: weights, penalties and terms.
    """
    # Clustering reads the items several times: parse pages once, and keep marks instead of texts.
    slim = items.select(
        "id", "title", "url", "source_id", "source_class", "evidence_allowed", "published_at", "features",
        ((F.col("url") != "") | (F.size("source_links") > 0)).alias("has_link"), *term_marks(config))
    members = story_members(materialize(slim, "items"))
    stories = stories_from_clusters(members, [*mark_aggregates(), F.bool_or("has_link").alias("linked")]).where("linked")
    recent = None
    if decisions is not None:
        stories = materialize(stories, "stories")
        recent = recently_decided(
            stories.select("event_id", title_features("canonical_title").alias("features"), F.to_date(as_of).alias("run_date")),
            decisions.select(title_features("title").alias("features"), "decided_on"),
            RECENT_THRESHOLD, RECENT_DAYS,
        )
    scored = score_stories(stories, as_of, recent, config=config)
    return top_n(scored, top, [F.col("total").desc(), F.col("event_id").asc()])


def page_ranking(spark: SparkSession, root: str, top: int = 10) -> DataFrame:
    """Ranking of the web pages of a data set as of the end of its month."""
    ranked = rank_stories(page_items(spark, root), F.lit("2024-01-31").cast("timestamp"), top)
    return ranked.select(
        F.col("rank").cast("long").alias("rank"), "event_id", "canonical_title", F.col("total").cast("long").alias("total"),
        "evidence_status", "primary_source_url", F.col("item_count").alias("items"), F.col("source_count").cast("long").alias("sources"),
    )
