"""Links found in feed payloads and their provenance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curator.constants import AGGREGATOR, LINK_KEYS, ORIGINAL_LINK_KEYS
from curator.functions.urls import normalize_url


def _no_links() -> Column:
    return F.array().cast("array<string>")


def _depth(json_text: Column) -> Column:
    """Levels that opening a JSON value can take: its nesting, and every bracket inside strings, which may hold JSON."""
    outside = F.regexp_replace(json_text, '(?s)"(?:[^"\\\\]++|\\\\.)*+"', "")
    marks = F.split(F.regexp_replace(outside, r"[^\[\]{}]", ""), "")
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(s: Column, mark: Column) -> Column:
        now = s["now"] + F.when(mark.isin("{", "["), 1).when(mark.isin("}", "]"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    opens = lambda c: F.length(F.regexp_replace(c, r"[^\[{]", ""))
    return F.aggregate(marks, zero, step, lambda s: s["most"]) + opens(json_text) - opens(outside)


def harvest(json_text: Column) -> Column:
    """Every http(s) string inside a JSON value, preferred keys of an object first, however deep.

    A list that starts with the value is opened one level at a time, each object or array giving way to its members in
    place, as often as the value is deep.
    """
    is_url = lambda x: x.rlike(r"^https?://")

    def opened(x: Column) -> Column:
        fields = F.from_json(x, "map<string,string>")
        preferred = F.transform(F.array(*[F.lit(k) for k in LINK_KEYS]), lambda k: F.try_element_at(fields, k))
        others = F.map_values(F.map_filter(fields, lambda k, v: ~k.isin(*LINK_KEYS)))
        members = F.when(is_url(x), F.array(x)).when(x.startswith("{"), F.concat(preferred, others)).when(
            x.startswith("["), F.from_json(x, "array<string>"))
        return F.coalesce(F.filter(members, lambda m: m.isNotNull()), _no_links())

    levels = F.when(json_text.isNotNull(), F.sequence(F.lit(1), F.greatest(_depth(json_text), F.lit(1))))
    every = F.aggregate(levels, F.array(json_text), lambda held, _: F.flatten(F.transform(held, opened)))
    return F.filter(every, is_url)


def declared_links(*values: Column) -> Column:
    """STRUCT<url, extra_urls, relation> from the link fields of one record.

    A declared original wins over the page that reported it; without one the
    first link found is only a discovery link.
    """
    originals = F.flatten(F.array(*[
        F.flatten(F.array(*[
            F.coalesce(harvest(F.get_json_object(v, f"$.{k}")), _no_links())
            for k in ORIGINAL_LINK_KEYS
        ])) for v in values
    ]))
    everything = F.transform(F.flatten(F.array(*[F.coalesce(harvest(v), _no_links()) for v in values])), normalize_url)
    primary = normalize_url(F.get(originals, 0))
    distinct = F.array_distinct(everything)
    has_original = F.size(originals) > 0
    url = F.when(has_original, primary).otherwise(F.coalesce(F.get(distinct, 0), F.lit("")))
    return F.struct(
        url.alias("url"),
        F.when(has_original, F.filter(distinct, lambda u: (u != primary) & (u != "")))
        .otherwise(F.slice(distinct, 2, F.greatest(F.size(distinct) - 1, F.lit(0)))).alias("extra_urls"),
        F.when(has_original, F.lit("original_link")).otherwise(F.lit("discovery_link")).alias("relation"),
    )


def source_links(
    url: Column, extra_urls: Column, source_id: Column, source_class: Column, relation: Column
) -> Column:
    """Provenance-labelled links of one item, distinct, sorted by all fields."""
    aggregated = source_class == AGGREGATOR
    primary = F.when(aggregated & (relation == "original_link"), F.lit("original_link_from_aggregator")).when(
        aggregated, F.lit("discovery_link")
    ).otherwise("direct_source")
    extra = F.when(aggregated, F.lit("discovery_link")).otherwise("related_source")

    def link(u: Column, provenance: Column) -> Column:
        return F.struct(
            normalize_url(u).alias("url"), source_id.alias("source_id"),
            source_class.alias("source_class"), provenance.alias("provenance"),
        )

    every = F.concat(F.array(link(url, primary)), F.transform(extra_urls, lambda u: link(u, extra)))
    return F.array_sort(F.array_distinct(F.filter(every, lambda x: x["url"] != "")))
