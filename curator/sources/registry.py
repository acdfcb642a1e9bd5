"""Source registries: validation and scheduling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curator import constants as K
from curator.functions.urls import is_public_url
from curator.operators.validation import Rule, cross, matches, required, validate

_STRING, _STRINGS = T.StringType(), T.ArrayType(T.StringType())


def _schema(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


SCHEMAS = {
    "ranking": _schema(
        id=_STRING, url=_STRING, parser=_STRING, format=_STRING, source_class=_STRING, owner=_STRING, evidence_allowed=T.BooleanType()
    ),
    "release": _schema(
        id=_STRING, repository=_STRING, category=_STRING, feed_url=_STRING, accepted_tag_patterns=_STRINGS, excluded_tag_patterns=_STRINGS,
        tier=_STRING, policy_version=_STRING, package_aliases=_STRINGS,
    ),
    "discovery": _schema(
        id=_STRING, url=_STRING, type=_STRING, weekdays=T.ArrayType(T.IntegerType()), max_items=T.IntegerType(), category=_STRING, kind=_STRING,
        enabled=T.BooleanType(),
    ),
}
# Discovery source types.
DISCOVERY_TYPES = ("rss", "show_hn", "hf_models", "hf_spaces")


def rules(kind: str) -> list[Rule]:
    """Rules of one kind of registry: ranking, release or discovery."""
    if kind == "ranking":
        from curator.sources.feeds import READERS

        return [
            required("id"), required("url"), required("source_class"),
            ("parser", "enum", ~F.col("parser").isin(*READERS), "unsupported parser"),
            ("format", "enum", ~F.col("format").isin("json", "xml"), "unsupported format"),
        ]
    if kind == "release":
        expected = F.concat(F.lit("https://github.com/"), "repository", F.lit("/releases.atom"))
        return [
            matches("id", r"^[a-z][a-z0-9_]{0,63}$"), matches("repository", r"^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$"),
            cross("feed_url", "expected", ~F.coalesce(F.col("feed_url") == expected, F.lit(False)), "feed_url must be the repository's release feed"),
            cross("accepted_tag_patterns", "required", F.coalesce(F.size("accepted_tag_patterns"), F.lit(0)) < 1, "a tag pattern is required"),
            cross("excluded_tag_patterns", "required", F.col("excluded_tag_patterns").isNull(), "excluded_tag_patterns is required"),
            required("policy_version"),
        ]
    days = F.col("weekdays")
    return [
        matches("id", r"^[a-z0-9][a-z0-9-]{0,63}$"),
        ("type", "enum", ~F.coalesce(F.col("type").isin(*DISCOVERY_TYPES), F.lit(False)), "unsupported source type"),
        ("url", "public", ~is_public_url("url"), "only public HTTP(S) hosts are allowed"),
        ("weekdays", "range", (F.size(days) < 1) | F.exists(days, lambda d: ~d.between(0, 6)), "weekdays run from Monday=0 to Sunday=6"),
        ("max_items", "range", ~F.col("max_items").between(1, 80), "max_items must be 1 to 80"),
        ("category", "enum", ~F.col("category").isin(*K.CATEGORIES), "unknown category"),
        ("kind", "enum", ~F.col("kind").isin("project", "reading", "news"), "discovery may not label an update"),
    ]


def load_registry(spark: SparkSession, rows: list[dict], kind: str) -> tuple[DataFrame, DataFrame]:
    """(registry, violations) of configured sources; `ord` keeps the configured order."""
    schema = T.StructType([*SCHEMAS[kind].fields, T.StructField("ord", T.IntegerType())])
    names = [f.name for f in schema][:-1]
    table = spark.createDataFrame([tuple(r.get(n) for n in names) + (i,) for i, r in enumerate(rows)], schema)
    broken = validate(table, ["id"], rules(kind))
    twice = table.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        "id", F.lit("id").alias("path"), F.lit("repeated").alias("code"), F.lit("source ids must be unique").alias("message")
    )
    return table, broken.unionByName(twice)


def due_sources(registry: DataFrame, at: Column, chosen: Column | None = None) -> DataFrame:
    """Sources scheduled for the weekday of `at` (Monday = 0), or the chosen ones.

    registry: source_id, weekdays[] (null = every day), enabled (optional). An
    explicit choice overrides the weekday, not a disabled source.
    """
    enabled = F.coalesce(F.col("enabled"), F.lit(True)) if "enabled" in registry.columns else F.lit(True)
    today = F.col("weekdays").isNull() | F.array_contains("weekdays", F.weekday(at))
    return registry.where(enabled & (today if chosen is None else chosen))
