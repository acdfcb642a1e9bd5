"""Landed feed payloads to records.

A payload is one row (source_id, body): feeds are small files, and a file that
cannot be read fails its own source only. Parsing is `from_json` / `from_xml`
over that column, so many payloads are parsed in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curator.functions.links import declared_links
from curator.functions.text import collapse, plain_text
from curator.functions.times import to_utc
from curator.functions.urls import resolve_url, split_url

RECORD = (
    "source_id", "title", "summary", "url", "published_at", "categories", "owner", "extra_urls", "link_relation", "metadata",
)


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """source_id (file name without suffix), format, body of every landed file."""
    name = F.col("_metadata.file_name")
    return spark.read.text(path, wholetext=True).select(
        F.regexp_replace(name, r"\.[^.]*$", "").alias("source_id"), F.regexp_extract(name, r"\.([^.]*)$", 1).alias("format"),
        F.col("value").alias("body"),
    )


def _text(c: Column) -> Column:
    return F.coalesce(collapse(c), F.lit(""))


def _first(*values: Column) -> Column:
    """First value with visible text."""
    return F.coalesce(*[F.nullif(_text(v), F.lit("")) for v in values], F.lit(""))


def _strings(value: Column) -> Column:
    """JSON string or list of strings as an array without blanks."""
    many = F.from_json(value, "array<string>")
    one = F.when(~value.startswith("["), F.array(value))
    return F.filter(F.transform(F.coalesce(F.when(value.startswith("["), many), one, F.array().cast("array<string>")), _text), lambda s: s != "")


def _owner(value: Column) -> Column:
    named = _first(*[F.get_json_object(value, f"$.{k}") for k in ("name", "title", "id", "source")])
    return F.when(value.startswith("{"), named).otherwise(_text(value))


def _metadata(fields: dict[str, Column]) -> Column:
    return F.map_filter(
        F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v.cast("string"))]), lambda k, v: v.isNotNull()
    )


def _json_items(raw: DataFrame, path: str) -> DataFrame:
    """One row per object of the array at `path` ('$' for a top-level array)."""
    items = F.from_json(F.get_json_object("body", path) if path != "$" else F.trim("body"), "array<string>")
    return raw.select("source_id", F.explode(items).alias("item")).where(F.col("item").startswith("{"))


def _members(df: DataFrame, body: str, *names: str) -> DataFrame:
    """Top-level members of a JSON object as columns `_<name>`: text, numbers and nested values as JSON. One parse a row."""
    return df.select("*", F.json_tuple(body, *names).alias(*[f"_{n}" for n in names]))


def _field(name: str) -> Column:
    return F.col(f"_{name}")


def read_json_feed(raw: DataFrame, kind: str) -> DataFrame:
    """Records of a JSON feed: 'selected', 'hot_topics' or 'models'."""
    field = _field
    if kind == "models":
        return _read_models(_json_items(raw, "$"))
    items = _members(
        _json_items(raw, "$.items"), "item", "links", "url", "id", "source", "title", "originalTitle", "summary", "publishedAt", "category", "categories",
        "sourceCount", "signalCount", "latestAt", "rank")
    found = items.select("*", declared_links(field("links"), field("url")).alias("l"))
    if kind == "selected":
        title = _first(field("title"), field("originalTitle"))
        summary, published = plain_text(field("summary")), field("publishedAt")
        # An empty category falls through to the list.
        categories = _strings(F.coalesce(F.nullif(field("category"), F.lit("")), field("categories")))
        metadata = _metadata({"upstream_id": _text(field("id"))})
    else:
        title = _text(field("title"))
        summary = F.concat(
            F.coalesce(field("sourceCount"), F.lit("0")), F.lit(" sources, "), F.coalesce(field("signalCount"), F.lit("0")), F.lit(" signals.")
        )
        published, categories = field("latestAt"), F.array(F.lit("hot-topic"))
        metadata = _metadata({"upstream_id": _text(field("id")), "rank": field("rank")})
    return found.select(
        "source_id", title.alias("title"), summary.alias("summary"), F.col("l.url").alias("url"), to_utc(published).alias("published_at"),
        categories.alias("categories"), _owner(field("source")).alias("owner"), F.col("l.extra_urls").alias("extra_urls"),
        F.col("l.relation").alias("link_relation"), metadata.alias("metadata"),
    ).where("title <> ''")


def _read_models(items: DataFrame) -> DataFrame:
    items, field = _members(
        items, "item", "modelId", "id", "trendingScore", "likes", "downloads", "tags", "pipeline_tag", "library_name", "createdAt"), _field
    name = _first(field("modelId"), field("id"))
    metrics = F.concat_ws(", ", *[F.when(field(m).isNotNull(), F.concat(F.lit(m + "="), field(m))) for m in ("trendingScore", "likes", "downloads")])
    tags = _strings(field("tags"))
    extra = F.filter(F.array(_text(field("pipeline_tag")), _text(field("library_name"))), lambda x: (x != "") & ~F.array_contains(tags, x))
    return items.select(
        "source_id", name.alias("title"),
        F.when(metrics != "", F.concat(F.lit("Hugging Face model signal: "), metrics)).otherwise("Hugging Face model signal.").alias("summary"),
        F.concat(F.lit("https://huggingface.co/"), name).alias("url"), to_utc(field("createdAt")).alias("published_at"),
        F.concat(tags, F.array_distinct(extra)).alias("categories"),
        F.when(F.contains(name, F.lit("/")), F.substring_index(name, "/", 1)).otherwise("").alias("owner"),
        F.array().cast("array<string>").alias("extra_urls"), F.lit("direct_source").alias("link_relation"),
        _metadata({m: field(m) for m in ("likes", "downloads", "trendingScore")}).alias("metadata"),
    ).where("title <> ''")


_XML = {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
_ITEM = (
    "struct<title:array<string>,link:array<string>,guid:array<string>,description:array<string>,encoded:array<string>,"
    "pubDate:array<string>,published:array<string>,updated:array<string>,category:array<string>>"
)
_RSS = f"channel struct<title:string,item:array<{_ITEM}>>, item array<{_ITEM}>, _bad string"
_ENTRY = (
    "struct<id:array<string>,title:array<string>,link:array<struct<_rel:string,_href:string>>,updated:array<string>,"
    "published:array<string>,summary:array<string>,content:array<string>,author:array<struct<name:array<string>>>,"
    "category:array<struct<_term:string>>>"
)
_ATOM = f"entry array<{_ENTRY}>, _bad string"


def _child(*names: str) -> Column:
    """First non-blank text among repeated children, name by name."""
    every = F.concat(*[F.coalesce(F.col(f"e.{n}"), F.array().cast("array<string>")) for n in names])
    return F.coalesce(F.get(F.filter(F.transform(every, _text), lambda s: s != ""), 0), F.lit(""))


def _plain_record(entries: DataFrame, title, summary, url, published, categories, owner) -> DataFrame:
    return entries.select(
        "source_id", title.alias("title"), plain_text(summary).alias("summary"), url.alias("url"), to_utc(published).alias("published_at"),
        categories.alias("categories"), owner.alias("owner"), F.array().cast("array<string>").alias("extra_urls"),
        F.lit("direct_source").alias("link_relation"), F.create_map().cast("map<string,string>").alias("metadata"),
    ).where("title <> ''")


def read_rss(raw: DataFrame) -> DataFrame:
    parsed = raw.select("source_id", F.from_xml("body", _RSS, _XML).alias("x"))
    entries = parsed.select(
        "source_id", _text(F.col("x.channel.title")).alias("channel"), F.explode(F.coalesce("x.channel.item", "x.item")).alias("e")
    )
    names = F.filter(F.transform(F.coalesce("e.category", F.array().cast("array<string>")), _text), lambda s: s != "")
    return _plain_record(
        entries, _child("title"), _child("description", "encoded"), _child("link", "guid"), _child("pubDate", "published", "updated"), names, F.col("channel")
    )


def _atom_entries(raw: DataFrame) -> DataFrame:
    return raw.select("source_id", F.explode(F.from_xml("body", _ATOM, _XML)["entry"]).alias("e"))


def _links(alternate_only: bool) -> Column:
    links = F.filter(F.coalesce("e.link", F.array().cast("array<struct<_rel:string,_href:string>>")), lambda l: F.coalesce(l["_href"], F.lit("")) != "")
    best = F.get(F.filter(links, lambda l: F.coalesce(l["_rel"], F.lit("alternate")) == "alternate"), 0)["_href"]
    return F.coalesce(best, F.lit("")) if alternate_only else F.coalesce(best, F.get(links, 0)["_href"], _child("id"))


def read_atom(raw: DataFrame, default_owner: str = "") -> DataFrame:
    entries = _atom_entries(raw)
    terms = F.filter(F.transform(F.coalesce("e.category", F.array().cast("array<struct<_term:string>>")), lambda c: F.coalesce(c["_term"], F.lit(""))), lambda s: s != "")
    author = F.coalesce(F.nullif(_text(F.get(F.get("e.author", 0)["name"], 0)), F.lit("")), F.lit(default_owner))
    return _plain_record(entries, _child("title"), _child("summary", "content"), _links(False), _child("published", "updated"), terms, author)


READERS = {
    "selected": lambda raw: read_json_feed(raw, "selected"),
    "hot_topics": lambda raw: read_json_feed(raw, "hot_topics"),
    "huggingface_models": lambda raw: read_json_feed(raw, "models"),
    "rss": read_rss,
    "atom": read_atom,
    "arxiv_atom": lambda raw: read_atom(raw, "arXiv"),
}
EXPECTED_SHAPE = {
    "selected": "items", "hot_topics": "items", "huggingface_models": "array", "rss": "rss", "atom": "feed", "arxiv_atom": "feed",
}


def validate_payloads(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, failed): payloads by whether they have their parser's root.

    raw: source_id, parser, body. A failed payload names its problem.
    """
    body = F.trim(F.regexp_replace("body", "^﻿", ""))
    expected = F.lit(None).cast("string")
    for parser, shape in EXPECTED_SHAPE.items():
        expected = F.when(F.col("parser") == parser, F.lit(shape)).otherwise(expected)
    is_json = expected.isin("items", "array")
    valid_json = F.try_parse_json(body).isNotNull()
    root = F.regexp_extract(body, r"(?s)^(?:<\?xml.*?\?>\s*|<!--.*?-->\s*|<!DOCTYPE[^>]*>\s*)*<(?:[\w.-]+:)?([\w.-]+)", 1)
    well_formed = F.from_xml(body, "_bad string", _XML)["_bad"].isNull()
    error = (
        F.when(expected.isNull(), F.lit("unsupported parser"))
        .when(is_json & ~valid_json, F.lit("invalid JSON"))
        .when((expected == "items") & ~F.coalesce(body.startswith("{") & F.get_json_object(body, "$.items").startswith("["), F.lit(False)), F.lit("an object with an items list is required"))
        .when((expected == "array") & ~body.startswith("["), F.lit("a JSON array is required"))
        .when(~is_json & ~well_formed, F.lit("invalid XML"))
        .when(~is_json & (root != expected), F.concat(F.lit("<"), expected, F.lit("> XML is required, got <"), root, F.lit(">")))
    )
    judged = raw.withColumn("error", error)
    return judged.where("error is null").drop("error"), judged.where("error is not null").drop("body")


_ENTRY = (
    "struct<title:array<string>,guid:array<string>,published:array<string>,pubDate:array<string>,date:array<string>,updated:array<string>,"
    "summary:array<string>,description:array<string>,content:array<string>,encoded:array<string>,"
    "link:array<struct<_VALUE:string,_rel:string,_href:string>>>"
)
# Fixed value: characters kept of a feed's titles and summaries.
FEED_TEXT = 1000


def _feed_items(raw: DataFrame) -> DataFrame:
    """All entries of each feed in one array, and how many of them its source reads."""
    shape = f"channel struct<item:array<{_ENTRY}>>, item array<{_ENTRY}>, entry array<{_ENTRY}>, _bad string"
    parsed = raw.withColumn("_x", F.from_xml("body", shape, {**_XML, "valueTag": "_VALUE"}))
    every = F.coalesce("_x.channel.item", "_x.item", "_x.entry", F.array().cast(f"array<{_ENTRY}>"))
    most = F.col("max_items") if "max_items" in raw.columns else F.lit(None).cast("int")
    return parsed.withColumn("_items", every).withColumn("_read", F.least(F.size("_items"), most))


def feed_counts(raw: DataFrame) -> DataFrame:
    """source_id, max_items, available, read, truncated: what each fetched feed holds and how much of it is read."""
    items = _feed_items(raw)
    most = F.col("max_items") if "max_items" in raw.columns else F.lit(None).cast("int").alias("max_items")
    return items.select(
        "source_id", most, F.size("_items").cast("long").alias("available"), F.col("_read").cast("long").alias("read"),
        (F.size("_items") > F.col("_read")).alias("truncated"))


# What discovery records of two indexes are called.
_HN_PAGE = "https://news.ycombinator.com/item?id="
_HF_SITE = "https://huggingface.co/"
_HF_HINT = "Hugging Face %s发现线索；具体用途、运行条件和许可待原文核验。"
_DISCOVERY = ("source_id", "place", "url", "title", "summary", "source_url", "observed_at", "kind", "category")


def _indexed(raw: DataFrame, *kept: str) -> DataFrame:
    """source_id, what else is `kept` of the payload, place, entry: the entries of a JSON array that the source reads."""
    entries = F.from_json(F.trim("body"), "array<string>")
    most = F.col("max_items") if "max_items" in raw.columns else F.lit(None).cast("int")
    return raw.select("source_id", *kept, F.posexplode(F.slice(entries, 1, F.least(F.size(entries), most))).alias("place", "entry"))


def read_show_hn(index: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(discovery records, errors) of an index of item numbers and the landed items.

    index: source_id, body (an array of numbers), max_items where the registry sets one; items: item_id, body. Deleted
    and dead items and those without a link are passed over; an entry that is no number, or whose item has not landed
    or is no JSON object, is an error of that entry only.
    """
    entries = _indexed(index).withColumn("item_id", F.when(F.col("entry").rlike(r"^-?\d+$"), F.col("entry").cast("long")))
    joined = entries.join(items.select("item_id", F.col("body").alias("item")), "item_id", "left")
    joined, field = _members(joined, "item", "deleted", "dead", "url", "title", "text", "time"), _field
    error = F.when(F.col("item_id").isNull(), "invalid item number").when(F.col("item").isNull(), "item has not landed").when(
        F.trim("item") == "null", None).when(F.from_json("item", "map<string,string>").isNull() | ~F.trim("item").startswith("{"), "item is no JSON object")
    judged = joined.withColumn("error", error)
    gone = F.coalesce(field("deleted"), F.lit("false")) == "true"
    dead = F.coalesce(field("dead"), F.lit("false")) == "true"
    live = judged.where(F.col("error").isNull() & ~gone & ~dead & (F.coalesce(field("url"), F.lit("")) != ""))
    url = field("url")
    records = live.select(
        "source_id", "place", url.alias("url"), plain_text(field("title"), FEED_TEXT).alias("title"), plain_text(field("text"), FEED_TEXT).alias("summary"),
        F.concat(F.lit(_HN_PAGE), F.col("item_id").cast("string")).alias("source_url"), to_utc(field("time"), naive="null", epoch=True).alias("observed_at"),
        F.lit("project").alias("kind"), F.when(split_url(url)["host"] == "github.com", "开源项目").otherwise("AI 应用").alias("category"))
    return records.select(*_DISCOVERY), judged.where("error is not null").select("source_id", "place", "entry", "error")


def read_hub_index(raw: DataFrame) -> DataFrame:
    """Discovery records of a hub's index of models or spaces.

    raw: source_id, final_url, type ('hf_models' or 'hf_spaces'), body, max_items where the registry sets one; a source
    may have several payloads, each with its own type and place numbers. Entries without an owner/name identifier are
    passed over.
    """
    entries, field = _members(_indexed(raw, "final_url", "type"), "entry", "id", "modelId", "description", "lastModified"), _field
    name, model = F.coalesce(F.nullif(field("id"), F.lit("")), field("modelId")), F.col("type") == "hf_models"
    said = plain_text(field("description"), FEED_TEXT)
    return entries.where(name.rlike(r"^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$")).select(
        "source_id", "place", F.concat(F.lit(_HF_SITE), F.when(model, "").otherwise("spaces/"), name).alias("url"), name.alias("title"),
        F.when(said != "", said).otherwise(F.format_string(_HF_HINT, F.when(model, "模型").otherwise("Space"))).alias("summary"),
        F.col("final_url").alias("source_url"), to_utc(field("lastModified"), naive="null").alias("observed_at"), F.lit("project").alias("kind"),
        F.when(model, "模型与运行工具").otherwise("AI 应用").alias("category")).select(*_DISCOVERY)


def read_feed_entries(raw: DataFrame, text_limit: int = FEED_TEXT) -> DataFrame:
    """Discovery entries of any feed that has `item` or `entry` elements.

    raw: source_id, final_url, body, kind and, where the registry sets one, max_items (null: all entries are read;
    `feed_counts` reports what a limit leaves out). The first value per tag counts, relative links are resolved, an
    opaque guid is not a URL, and a refresh date is an observation time but no publication date.
    """
    entries = _feed_items(raw).select("source_id", "final_url", "kind", F.posexplode(F.slice("_items", 1, F.col("_read"))).alias("place", "e"))
    one = lambda n: F.trim(F.coalesce(F.get(f"e.{n}", 0), F.lit("")))
    links = F.filter(
        F.transform(
            F.filter(F.coalesce("e.link", F.array().cast("array<struct<_VALUE:string,_rel:string,_href:string>>")), lambda l: F.coalesce(l["_rel"], F.lit("alternate")) == "alternate"),
            lambda l: F.trim(F.coalesce(F.nullif(l["_href"], F.lit("")), l["_VALUE"], F.lit(""))),
        ),
        lambda u: u != "",
    )
    guid = F.when(split_url(one("guid"))["scheme"].isin("http", "https"), one("guid"))
    link = F.coalesce(F.try_element_at(links, F.lit(-1)), guid, F.lit(""))
    stated = to_utc(F.coalesce(*[F.nullif(one(n), F.lit("")) for n in ("published", "pubDate", "date")]), naive="null", keep_fraction=True)
    refreshed = to_utc(one("updated"), naive="null", keep_fraction=True)
    body = F.coalesce(*[F.nullif(one(n), F.lit("")) for n in ("summary", "description", "content", "encoded")], F.lit(""))
    return entries.withColumn("_link", link).where("_link <> ''").select(
        "source_id", "place", resolve_url(F.col("final_url"), F.col("_link")).alias("url"), plain_text(one("title"), text_limit).alias("title"),
        plain_text(body, text_limit).alias("summary"), F.coalesce(stated, refreshed).alias("observed_at"),
        F.when(F.col("kind").isin("reading", "news"), stated).alias("published_at"), "kind",
    )
