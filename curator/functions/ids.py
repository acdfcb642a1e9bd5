"""Stable identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curator.functions.text import normalize_title
from curator.functions.urls import canonical_url, event_url, normalize_url


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def item_id(source_id: Column | str, url: Column | str, title: Column | str) -> Column:
    link = normalize_url(url)
    identity = F.when(link != "", link).otherwise(normalize_title(title))
    return F.sha2(F.concat(_col(source_id), F.lit("\n"), identity), 256)


def story_id(primary_url: Column, representative_url: Column, title: Column) -> Column:
    chosen = normalize_url(F.when(F.coalesce(primary_url, F.lit("")) != "", primary_url).otherwise(representative_url))
    identity = F.when(chosen != "", chosen).otherwise(normalize_title(title))
    return F.sha2(F.concat(F.lit("event:"), identity), 256)


def json_string(c: Column | str) -> Column:
    """A JSON string literal (quotes and escapes included)."""
    # to_json of a one-field object, without the field.
    text = F.to_json(F.struct(_col(c).alias("v")), {"ignoreNullFields": "false"})
    return F.substring(text, F.lit(6), F.length(text) - 6)


def canonical_object(fields: dict[str, Column]) -> Column:
    """Compact JSON with sorted keys, for hashing."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def canonical_hash(fields: dict[str, Column]) -> Column:
    return F.sha2(canonical_object(fields), 256)


def candidate_id(url: Column | str, kind: Column, original_event_url: Column) -> Column:
    """First 24 hex digits over identity URL, kind and event URL."""
    anchor = F.when(original_event_url.isNotNull(), event_url(original_event_url)).when(
        kind == "news", event_url(url)
    ).otherwise("")
    return F.substring(
        canonical_hash({"canonical_url": canonical_url(url, kind), "kind": kind, "event_url": anchor}), 1, 24
    )


def passage_id(url: Column | str, text: Column | str, start: Column | str) -> Column:
    nul = F.lit("\x00")
    return F.concat(
        F.lit("p_"),
        F.substring(F.sha2(F.concat(_col(url), nul, F.sha2(_col(text), 256), nul, _col(start).cast("string")), 256), 1, 24),
    )


def evidence_id(kind: Column, url: Column, commit_sha: Column, text: Column) -> Column:
    whole = F.concat_ws("\n", kind, url, F.coalesce(commit_sha, F.lit("")), F.sha2(text, 256))
    return F.concat(F.lit("ext-"), F.substring(F.sha2(whole, 256), 1, 12))
