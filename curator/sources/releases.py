"""Release feeds, release API pages and security advisories to release records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curator.functions.markup import evidence_text
from curator.functions.text import normalize_evidence
from curator.functions.urls import release_tag, split_url
from curator.operators.joins import map_advisories
from curator.sources.feeds import _atom_entries, _child, _json_items, _links

def read_release_atom(raw: DataFrame, sources: DataFrame) -> DataFrame:
    """Release entries of registered repositories.

    raw: source_id, body; sources: source_id, repository. An entry needs a tag,
    a title, a date and an https release page of its own repository.
    """
    entries = _atom_entries(raw).join(sources.select("source_id", "repository"), "source_id")
    named = entries.select("source_id", "repository", _links(True).alias("url"), _child("id").alias("entry_id"), _child("title").alias("title"),
                           F.coalesce(F.get("e.content", 0), F.lit("")).alias("release_notes_html"), _child("published", "updated").alias("published_at"))
    tagged = named.withColumn("release_tag", release_tag(F.col("url"), F.col("entry_id"))).withColumn("_u", split_url("url"))
    own_page = (
        (F.col("_u.scheme") == "https") & (F.lower("_u.authority") == "github.com")
        & F.startswith(F.lower("_u.path"), F.lower(F.concat(F.lit("/"), "repository", F.lit("/releases/tag/"))))
    )
    complete = (F.col("release_tag") != "") & (F.col("title") != "") & (F.col("published_at") != "")
    return tagged.where(own_page & complete).select(
        F.concat("repository", F.lit("@"), "release_tag").alias("release_key"), "source_id", "repository", "release_tag", "title",
        "release_notes_html", evidence_text("release_notes_html").alias("release_notes_text"), "url", "published_at",
        F.lit("release").alias("item_type"), F.lit(None).cast("boolean").alias("prerelease"),
    )


def read_release_rest(raw: DataFrame, sources: DataFrame) -> DataFrame:
    """Releases of API pages. raw: source_id, body (a JSON array)."""
    field = lambda n: F.trim(F.coalesce(F.get_json_object("item", f"$.{n}"), F.lit("")))
    items = _json_items(raw, "$").join(sources.select("source_id", "repository"), "source_id").where(field("draft") != "true")
    tag, notes = field("tag_name"), F.coalesce(F.get_json_object("item", "$.body"), F.lit(""))
    return items.select(
        F.concat("repository", F.lit("@"), tag).alias("release_key"), "source_id", "repository", tag.alias("release_tag"),
        F.coalesce(F.nullif(field("name"), F.lit("")), tag).alias("title"), notes.alias("release_notes_html"), normalize_evidence(notes).alias("release_notes_text"),
        field("html_url").alias("url"), field("published_at").alias("published_at"), F.lit("release").alias("item_type"),
        (field("prerelease") == "true").alias("prerelease"),
    ).where("release_tag <> '' and url <> '' and published_at <> ''")


_ADVISORY = (
    "ghsa_id string, type string, severity string, withdrawn_at string, html_url string, published_at string, updated_at string, "
    "summary string, description string, source_code_location string, vulnerabilities array<struct<"
    "package:struct<ecosystem:string,name:string>,vulnerable_version_range:string,first_patched_version:string>>"
)


def read_advisories(raw: DataFrame, sources: DataFrame, known: DataFrame) -> DataFrame:
    """Security advisories that qualify, and known ones that no longer do.

    sources: source_id, ord, repository, aliases[]; known: advisory_id,
    repository of advisories in the ledger. content_hash covers the facts that
    matter, in canonical JSON.
    """
    items = raw.select(F.explode(F.from_json(F.trim("body"), "array<string>")).alias("item")).where(F.startswith("item", F.lit("{")))
    a = items.select(F.from_json("item", _ADVISORY).alias("a")).select("a.*").withColumn("advisory_id", F.trim(F.coalesce("ghsa_id", F.lit(""))))
    none = F.array().cast("array<string>")
    keyed = a.withColumn("location", F.coalesce("source_code_location", F.lit(""))).withColumn(
        "packages",
        F.coalesce(F.filter(F.transform("vulnerabilities", lambda v: F.coalesce(v["package"]["name"], F.lit(""))), lambda n: n != ""), none),
    )
    mapped = map_advisories(keyed, sources).withColumnRenamed("source_id", "mapped_source")
    homes = sources.select(F.col("source_id").alias("mapped_source"), F.col("repository").alias("mapped_repository"))
    held = known.select("advisory_id", F.col("repository").alias("known_repository"), F.lit(True).alias("is_known"))
    full = mapped.join(homes, "mapped_source", "left").join(held, "advisory_id", "left").join(
        sources.select(F.col("repository").alias("known_repository"), F.col("source_id").alias("known_source")), "known_repository", "left"
    )
    repository = F.coalesce("mapped_repository", F.when(F.col("known_source").isNotNull(), F.col("known_repository")))
    qualifies = F.coalesce(
        (F.col("type") == "reviewed") & F.lower("severity").isin("high", "critical") & F.col("mapped_source").isNotNull()
        & (F.coalesce("withdrawn_at", F.lit("")) == ""), F.lit(False)
    )
    facts = F.array_sort(F.transform("vulnerabilities", lambda v: F.to_json(
        F.struct(v["package"]["ecosystem"].alias("ecosystem"), v["first_patched_version"].alias("first_patched_version"), v["package"]["name"].alias("name"),
                 v["vulnerable_version_range"].alias("vulnerable_version_range")), {"ignoreNullFields": "false"}
    )))
    head = F.to_json(F.struct(*[F.col(c) for c in ("description", "severity", "source_code_location", "summary", "type")]), {"ignoreNullFields": "false"})
    tail = F.to_json(F.struct("withdrawn_at"), {"ignoreNullFields": "false"})
    # Keys stay in alphabetical order: ..., type, vulnerabilities, withdrawn_at.
    canonical = F.concat(
        F.regexp_replace(head, r"\}$", ""), F.lit(',"vulnerabilities":['), F.coalesce(F.array_join(facts, ","), F.lit("")), F.lit("],"), F.regexp_replace(tail, r"^\{", "")
    )
    notes = F.concat_ws(" ", F.nullif("summary", F.lit("")), F.nullif("description", F.lit("")), canonical)
    published = F.coalesce(F.nullif("published_at", F.lit("")), F.nullif("updated_at", F.lit("")))
    return full.where((qualifies | F.col("is_known")) & repository.isNotNull()).select(
        F.concat(F.lit("github-advisory@"), "advisory_id").alias("release_key"), F.lit("github_advisories").alias("source_id"), repository.alias("repository"),
        F.col("advisory_id").alias("release_tag"), F.coalesce(F.nullif("summary", F.lit("")), "advisory_id").alias("title"),
        notes.alias("release_notes_html"), normalize_evidence(notes).alias("release_notes_text"), F.trim("html_url").alias("url"), published.alias("published_at"),
        F.lit("security").alias("item_type"), F.lit(None).cast("boolean").alias("prerelease"), F.lower("severity").alias("severity"), "withdrawn_at",
        F.sha2(canonical, 256).alias("content_hash"), qualifies.alias("qualifies"),
    ).where("release_tag <> '' and url <> '' and published_at is not null")
