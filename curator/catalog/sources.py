"""Queries of the sources (S) and sinks (K): payloads are built from the tables, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from curator.catalog import sqltext as S
from curator.catalog.registry import query
from curator.functions import markup, text, urls
from curator.operators import ledger
from curator.plans.items import page_times
from curator.runtime import load, scratch_path
from curator.sinks import render, writers
from curator.sources import feeds, landing, registry, releases
from curator.sources.splitting import json_array_entries, xml_entries

_K = "cast(json_extract(props, '$.k') as bigint)"


def k():
    return F.get_json_object("props", "$.k").cast("long")


def title():
    return text.unescape(F.regexp_extract("html", "<title>([^<]*)</title>", 1))


def dated_pages(spark, root):
    """Pages with their times, as one payload row each."""
    pages, events = load(spark, root, "pages"), load(spark, root, "events")
    return pages.join(page_times(events), "page_id", "left").select(
        "page_id", F.col("page_id").cast("string").alias("source_id"), "url", title().alias("title"), "ts",
        F.coalesce(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("unknown")).alias("iso"),
    )


def xml(c):
    """Text escaped for XML."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def cat(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


_TITLES = f"""
with p as (select page_id, page_id::varchar as source_id, url, {S.collapse(S.TITLE)} as title, epoch(date_trunc('second', ts))::bigint as sec from pages left join (select event_id // 40 as page_id, arg_max(ts, (value, event_id)) as ts from events group by 1) using (page_id))"""


def seconds():
    return F.unix_seconds("published_at").alias("sec")


@query("s01_selected_feed", _TITLES + f"""
select source_id, title, 'one < two' as summary, {S.normalize_url('url')} as url, sec, 'original_link' as link_relation, 'a|b' as categories, 'Desk' as owner from p where title <> ''""")
def s01(spark, root):
    item = F.to_json(F.struct(
        F.col("title"), F.lit("<b>one</b> &lt;  two").alias("summary"), F.struct(F.col("url").alias("original"), F.lit("https://agg.example/x").alias("url")).alias("links"),
        F.col("iso").alias("publishedAt"), F.array(F.lit("a"), F.lit(" "), F.lit("b")).alias("categories"), F.struct(F.lit("Desk").alias("name")).alias("source"),
    ))
    raw = dated_pages(spark, root).select("source_id", cat('{"items":[', item, ',"skipped",{"summary":"no title"}]}').alias("body"))
    records = feeds.read_json_feed(raw, "selected")
    return records.select("source_id", "title", "summary", "url", seconds(), "link_relation", F.array_join("categories", "|").alias("categories"), "owner")


@query("s01_hot_topics_feed", _TITLES + f"""
select source_id, title, page_id || ' sources, 0 signals.' as summary, {S.normalize_url('url')} as url, 'discovery_link' as link_relation from p where title <> ''""")
def s01h(spark, root):
    item = F.to_json(F.struct(F.col("title"), F.col("page_id").alias("sourceCount"), F.array("url").alias("links")))
    raw = dated_pages(spark, root).select("source_id", cat('{"items":[', item, "]}").alias("body"))
    return feeds.read_json_feed(raw, "hot_topics").select("source_id", "title", "summary", "url", "link_relation")


@query("s01_models_feed", """
select p_partkey::varchar as source_id, replace(p_brand, '#', '-') || '/' || replace(p_name, ' ', '-') as title,
 'Hugging Face model signal: likes=' || p_size || ', downloads=7' as summary, replace(p_brand, '#', '-') as owner, lower(p_type) || '|text' as categories from part""")
def s01m(spark, root):
    model = F.concat(F.replace(F.col("p_brand"), F.lit("#"), F.lit("-")), F.lit("/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("-")))
    item = F.to_json(F.struct(model.alias("modelId"), F.col("p_size").alias("likes"), F.lit(7).alias("downloads"), F.array(F.lower("p_type")).alias("tags"), F.lit("text").alias("pipeline_tag")))
    raw = load(spark, root, "part").select(F.col("p_partkey").cast("string").alias("source_id"), cat("[", item, "]").alias("body"))
    return feeds.read_json_feed(raw, "models").select("source_id", "title", "summary", "owner", F.array_join("categories", "|").alias("categories"))


@query("s02_rss", _TITLES + """
select source_id, title, 'hi x & y' as summary, url, sec, 'c1|c2' as categories, 'Chan' as owner from p where title <> ''""")
def s02(spark, root):
    mail = F.coalesce(cat(F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), " GMT"), F.lit("someday"))
    body = cat(
        '<?xml version="1.0"?><rss version="2.0"><channel><title>Chan</title><item><title>', xml(F.col("title")), "</title><guid>", xml(F.col("url")),
        "</guid><description><![CDATA[<b>hi</b> x &amp; y]]></description><pubDate>", mail, "</pubDate><category>c1</category><category>c2</category></item><item><link>untitled</link></item></channel></rss>",
    )
    records = feeds.read_rss(dated_pages(spark, root).select("source_id", body.alias("body")))
    return records.select("source_id", "title", "summary", "url", seconds(), F.array_join("categories", "|").alias("categories"), "owner")


@query("s03_atom", _TITLES + """
select source_id, title, 'deep' as summary, url, sec, 'x' as categories, case when page_id % 2 = 0 then 'N' else 'arXiv' end as owner from p where title <> ''""")
def s03(spark, root):
    body = cat(
        '<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title><entry><id>urn:1</id><title type="html">', xml(F.col("title")), '</title><link rel="self" href="https://h/self"/><link href="', xml(F.col("url")),
        '"/><updated>', F.col("iso"), '</updated><summary>deep</summary>', F.when(F.col("page_id") % 2 == 0, "<author><name>N</name></author>").otherwise(""), '<category term="x"/></entry></feed>',
    )
    records = feeds.READERS["arxiv_atom"](dated_pages(spark, root).select("source_id", body.alias("body")))
    return records.select("source_id", "title", "summary", "url", seconds(), F.array_join("categories", "|").alias("categories"), "owner")


_REPO = "replace(p_brand, '#', '-') || '/' || replace(p_name, ' ', '-')"


def repositories(spark, root):
    repo = F.concat(F.replace(F.col("p_brand"), F.lit("#"), F.lit("-")), F.lit("/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("-")))
    return load(spark, root, "part").select(F.col("p_partkey").cast("string").alias("source_id"), repo.alias("repository"), "p_size", "p_type", "p_partkey", "p_retailprice")


@query("s04_release_atom", f"""
select {_REPO} || '@v' || p_size as release_key, p_partkey::varchar as source_id, 'v' || p_size as release_tag, 'Fixed <x> & more' as release_notes_text from part where p_type <> 'PROMO'""")
def s04(spark, root):
    parts = repositories(spark, root)
    # Promotional parts point to another repository's page.
    owner = F.when(F.col("p_type") == "PROMO", "other/repo").otherwise(F.col("repository"))
    body = cat(
        '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>tag:x/v1</id><title>R</title><link rel="alternate" href="https://github.com/', owner, "/releases/tag/v", F.col("p_size").cast("string"),
        '"/><updated>2024-01-01T00:00:00Z</updated><content type="html">&lt;p&gt;Fixed &amp;amp;lt;x&amp;amp;gt; &amp;amp;amp; more&lt;/p&gt;&lt;script&gt;no()&lt;/script&gt;</content></entry></feed>',
    )
    records = releases.read_release_atom(parts.select("source_id", body.alias("body")), parts.select("source_id", "repository"))
    return records.select("release_key", "source_id", "release_tag", "release_notes_text")


@query("s05_release_rest", f"""
select {_REPO} || '@v' || p_size as release_key, case when p_size > 25 then 'Named' else 'v' || p_size end as title, p_type = 'SMALL' as prerelease from part where p_type <> 'LARGE'""")
def s05(spark, root):
    parts = repositories(spark, root)
    tag = F.concat(F.lit("v"), F.col("p_size").cast("string"))
    item = F.to_json(F.struct(
        tag.alias("tag_name"), F.when(F.col("p_size") > 25, "Named").otherwise("").alias("name"), F.lit("https://github.com/x").alias("html_url"), F.lit("2024-01-01T00:00:00Z").alias("published_at"),
        (F.col("p_type") == "LARGE").alias("draft"), (F.col("p_type") == "SMALL").alias("prerelease"), F.lit("notes").alias("body"),
    ))
    records = releases.read_release_rest(parts.select("source_id", cat("[", item, "]").alias("body")), parts.select("source_id", "repository"))
    return records.select("release_key", "title", "prerelease")


@query("s06_advisories", """
select 'github-advisory@GHSA-' || p_partkey as release_key, case when p_size % 25 = n_nationkey then 'org/n' || n_nationkey end as repository,
  p_type in ('SMALL', 'LARGE') as qualifies from part join nation on p_size % 25 = n_nationkey where p_type in ('SMALL', 'LARGE') or p_retailprice > 1000""")
def s06(spark, root):
    sources = load(spark, root, "nation").select(
        F.col("n_name").alias("source_id"), F.col("n_nationkey").alias("ord"), F.concat(F.lit("org/n"), F.col("n_nationkey").cast("string")).alias("repository"), F.array(F.col("n_name")).alias("aliases")
    )
    parts = load(spark, root, "part")
    kind = F.col("p_type")
    item = F.to_json(F.struct(
        F.concat(F.lit("GHSA-"), F.col("p_partkey").cast("string")).alias("ghsa_id"), F.lit("reviewed").alias("type"),
        F.when(kind == "SMALL", "HIGH").when(kind == "LARGE", "critical").when(kind == "PROMO", "low").otherwise("high").alias("severity"),
        F.when(kind == "ECONOMY", "2024-02-01").when(kind == "MEDIUM", "2024-02-02").when(kind == "STANDARD", "2024-02-03").alias("withdrawn_at"), F.lit("https://h/a").alias("html_url"),
        F.lit("2024-01-01").alias("published_at"), F.col("p_name").alias("summary"), F.concat(F.lit("https://github.com/ORG/n"), (F.col("p_size") % 25).cast("string")).alias("source_code_location"),
    ))
    known = parts.where("p_retailprice > 1000").select(
        F.concat(F.lit("GHSA-"), F.col("p_partkey").cast("string")).alias("advisory_id"), F.concat(F.lit("org/n"), (F.col("p_size") % 25).cast("string")).alias("repository")
    )
    return releases.read_advisories(parts.select(cat("[", item, "]").alias("body")), sources, known).select("release_key", "repository", "qualifies")


@query("s07_feed_entries", _TITLES + f"""
select source_id, lower({S.part('url', 1)}) || '://' || {S.part('url', 2)} || '/post/' || page_id as url, title, case when page_id % 2 = 0 then sec end as published, sec as observed from p""")
def s07(spark, root):
    pages = dated_pages(spark, root)
    stamp = F.when(F.col("page_id") % 2 == 0, cat("<pubDate>", F.col("iso"), "</pubDate>")).otherwise(cat("<updated>", F.col("iso"), "</updated>"))
    body = cat("<rss><channel><item><title>", xml(F.col("title")), "</title><link>../post/", F.col("page_id").cast("string"), "</link>", stamp, "</item><item><title>opaque</title><guid>id-7</guid></item></channel></rss>")
    site = cat(urls.split_url("url")["scheme"], "://", urls.split_url("url")["authority"])
    entries = feeds.read_feed_entries(pages.select("source_id", cat(site, "/feeds/main.xml").alias("final_url"), body.alias("body"), F.lit("reading").alias("kind")))
    return entries.select("source_id", "url", "title", F.unix_seconds("published_at").alias("published"), F.unix_seconds("observed_at").alias("observed"))


@query("s07_feed_counts", """
select source || '/' || (doc_id // 64) as source, case when source = 'src0' then 3 end as max_items, count(*)::bigint as available,
  least(count(*), case when source = 'src0' then 3 else count(*) end)::bigint as read, count(*) > case when source = 'src0' then 3 else count(*) end as truncated
from documents group by source, doc_id // 64""")
def s07c(spark, root):
    # Each source has a feed for every 64 document ids with an entry for each of its documents; one source has a reading limit.
    docs = load(spark, root, "documents")
    entry = cat("<item><title>d</title><link>https://h/", F.col("doc_id").cast("string"), "</link></item>")
    part = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 64).cast("string"))
    raw = docs.groupBy(F.col("source").alias("name"), part.alias("source_id")).agg(F.array_join(F.collect_list(entry), "").alias("items")).select(
        "source_id", F.lit("https://h/feed.xml").alias("final_url"), cat("<rss><channel>", F.col("items"), "</channel></rss>").alias("body"),
        F.lit("reading").alias("kind"), F.when(F.col("name") == "src0", 3).alias("max_items"))
    return feeds.feed_counts(raw).withColumnRenamed("source_id", "source")


@query("s01_show_hn", """
select event_type || '/' || (event_id // 256) as source_id, case when event_id % 2 = 0 then 'https://github.com/o/' || event_id else 'https://h.example/' || event_id end as url, 'T ' || event_id as title,
  'https://news.ycombinator.com/item?id=' || event_id as source_url, epoch(date_trunc('second', ts))::bigint as seconds, case when event_id % 2 = 0 then '开源项目' else 'AI 应用' end as category
from events where event_id % 11 not in (1, 2, 3, 4)""")
def s01hn(spark, root):
    return _show_hn(spark, root)[0].select("source_id", "url", "title", "source_url", F.unix_seconds("observed_at").alias("seconds"), "category")


@query("s01_show_hn_errors", """
select event_type || '/' || (event_id // 256) as source_id, event_id::varchar as entry, case event_id % 11 when 4 then 'item has not landed' else 'item is no JSON object' end as error from events where event_id % 11 in (3, 4)
union all select distinct event_type || '/' || (event_id // 256), 'bad', 'invalid item number' from events""")
def s01hne(spark, root):
    return _show_hn(spark, root)[1].select("source_id", "entry", "error")


def _show_hn(spark, root):
    """An index per event type and 256 event ids; some items are deleted, dead, broken or missing."""
    events, n = load(spark, root, "events"), F.col("event_id")
    ids = F.concat(F.array_join(F.sort_array(F.collect_list(n)).cast("array<string>"), ","), F.lit(',"bad"'))
    index = events.groupBy(F.concat_ws("/", "event_type", F.floor(n / 256).cast("string")).alias("source_id")).agg(F.concat(F.lit("["), ids, F.lit("]")).alias("body"))
    link = F.concat(F.when(n % 2 == 0, "https://github.com/o/").otherwise("https://h.example/"), n.cast("string"))
    body = F.to_json(F.struct(
        link.alias("url"), F.concat(F.lit("<b>T</b> "), n.cast("string")).alias("title"), F.unix_seconds("ts").alias("time"),
        F.when(n % 11 == 1, True).alias("deleted"), F.when(n % 11 == 2, True).alias("dead")))
    items = events.where(n % 11 != 4).select(n.alias("item_id"), F.when(n % 11 == 3, "[1]").otherwise(body).alias("body"))
    return feeds.read_show_hn(index, items)


@query("s01_hub_index", """
select 'hub/' || (doc_id // 64) as source_id, 'https://huggingface.co/' || case when doc_id % 2 = 0 then '' else 'spaces/' end || lang || '/d' || doc_id as url,
  lang || '/d' || doc_id as title, case when doc_id % 3 = 0 then 'About ' || doc_id when doc_id % 2 = 0 then 'Hugging Face 模型发现线索；具体用途、运行条件和许可待原文核验。' else 'Hugging Face Space发现线索；具体用途、运行条件和许可待原文核验。' end as summary,
  1704067200 + doc_id as seconds, case when doc_id % 2 = 0 then '模型与运行工具' else 'AI 应用' end as category
from documents where doc_id % 7 <> 0""")
def s01hub(spark, root):
    n = F.col("doc_id")
    # Every seventh entry has no owner.
    entry = F.to_json(F.struct(
        F.when(n % 7 == 0, "nameless").otherwise(F.concat("lang", F.lit("/d"), n.cast("string"))).alias("id"),
        F.when(n % 3 == 0, F.concat(F.lit("About "), n.cast("string"))).alias("description"),
        F.date_format(F.timestamp_seconds(F.lit(1704067200) + n), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("lastModified")))
    # Each source has a payload of models and one of spaces.
    part = F.concat(F.lit("hub/"), F.floor(n / 64).cast("string"))
    raw = load(spark, root, "documents").groupBy(part.alias("source_id"), F.when(n % 2 == 0, "hf_models").otherwise("hf_spaces").alias("type")).agg(
        F.concat(F.lit("["), F.array_join(F.collect_list(entry), ","), F.lit("]")).alias("body")).select(
        "source_id", F.lit("https://huggingface.co/api").alias("final_url"), "type", "body")
    return feeds.read_hub_index(raw).select("source_id", "url", "title", "summary", F.unix_seconds("observed_at").alias("seconds"), "category")


def _payload_files(spark, root, entry, opens, between, closes):
    """A landed file for every 64 document ids, with an entry per document in their order."""
    part = F.floor(F.col("doc_id") / 64).alias("part")
    listed = load(spark, root, "documents").groupBy(part).agg(F.array_sort(F.collect_list(F.struct("doc_id", entry.alias("e")))).alias("l"))
    path = scratch_path(spark, "payloads")
    listed.select("part", F.concat(F.lit(opens), F.array_join(F.col("l")["e"], between), F.lit(closes)).alias("value")).write.partitionBy("part").text(path)
    return path


@query("s01_split_array_entries", """
select doc_id as id, row_number() over (partition by doc_id // 64 order by doc_id) - 1 as place, sha256(text) as digest, '}]{"' || lang as mark from documents""")
def s01split(spark, root):
    entry = F.to_json(F.struct(F.col("doc_id").alias("id"), "text", F.struct(F.concat(F.lit('}]{"'), "lang").alias("m")).alias("in")))
    found = json_array_entries(spark, _payload_files(spark, root, entry, "[", ",\n", "]"))
    field = lambda name: F.get_json_object("entry", name)
    return found.select(field("$.id").cast("long").alias("id"), "place", F.sha2(field("$.text"), 256).alias("digest"), field("$.in.m").alias("mark"))


@query("s07_split_feed_entries", """
select doc_id as id, row_number() over (partition by doc_id // 64 order by doc_id) - 1 as place, sha256(text) as digest from documents""")
def s07split(spark, root):
    entry = cat("<item><guid>", F.col("doc_id").cast("string"), "</guid><description>", xml(F.col("text")), "</description></item>")
    found = xml_entries(spark, _payload_files(spark, root, entry, "<rss><channel><title>x</title>", "\n", "</channel></rss>"))
    body = F.regexp_extract("entry", "(?s)<description>(.*)</description>", 1)
    for a, b in (("&quot;", '"'), ("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&")):
        body = F.replace(body, F.lit(a), F.lit(b))
    return found.select(F.regexp_extract("entry", "<guid>([0-9]+)</guid>", 1).cast("long").alias("id"), "place", F.sha2(body, 256).alias("digest"))


@query("s08_validate_payloads", """
select p_partkey::varchar as source_id, case p_type when 'SMALL' then 'invalid JSON' when 'LARGE' then 'an object with an items list is required' when 'PROMO' then '<rss> XML is required, got <feed>' when 'MEDIUM' then 'invalid XML' end as error
from part where p_type in ('SMALL', 'LARGE', 'PROMO', 'MEDIUM')""")
def s08(spark, root):
    kind = F.col("p_type")
    parser = F.when(kind.isin("SMALL", "LARGE", "ECONOMY"), "selected").otherwise("rss")
    body = (
        F.when(kind == "SMALL", "{broken").when(kind == "LARGE", '{"items": 3}').when(kind == "ECONOMY", '{"items": []}')
        .when(kind == "PROMO", "<feed><entry/></feed>").when(kind == "MEDIUM", "<rss><channel>").otherwise("<rss><channel/></rss>")
    )
    raw = load(spark, root, "part").select(F.col("p_partkey").cast("string").alias("source_id"), parser.alias("parser"), body.alias("body"))
    _, failed = feeds.validate_payloads(raw)
    return failed.select("source_id", "error")


@query("s09_land_or_replay", """
select 'complete' as run, o_orderkey as source_id, 'reuse' as action from orders
union all select 'partial', o_orderkey, case when (select count(*) from orders where o_orderstatus <> 'F') = 0 then 'reuse' else 'fetch' end from orders
""")
def s09(spark, root):
    # The first day landed every order, the second failed for all that aren't finished.
    orders = load(spark, root, "orders").select(F.col("o_orderkey").alias("source_id"), "o_orderstatus")
    row = lambda dt, ok: orders.select(F.lit(dt).alias("dt"), "source_id", F.lit("c").alias("config_hash"), F.when(ok, "ok").otherwise("failed").alias("status"), F.lit("body").alias("body"))
    landed = row("1996-01-01", F.lit(True)).unionByName(row("1996-01-02", F.col("o_orderstatus") == "F"))
    runs = [landing.land_or_replay(orders, landed, dt, "c").select(F.lit(run).alias("run"), "source_id", "action") for run, dt in (("complete", "1996-01-01"), ("partial", "1996-01-02"))]
    return runs[0].unionByName(runs[1])


@query("s10_registry", """
select s_suppkey::varchar as id, case when s_suppkey % 3 = 0 then 'pattern' else 'expected' end as code from supplier where s_suppkey % 3 = 0 or s_nationkey < 5
 and s_suppkey % 3 <> 0 union all select s_suppkey::varchar, 'expected' from supplier where s_suppkey % 3 = 0 and s_nationkey < 5""")
def s10(spark, root):
    from curator.operators.validation import validate

    table = load(spark, root, "supplier").select(
        F.col("s_suppkey").cast("string").alias("key"), F.when(F.col("s_suppkey") % 3 == 0, "Bad Id").otherwise(cat("s", F.col("s_suppkey").cast("string"))).alias("id"), F.lit("a/b").alias("repository"),
        F.when(F.col("s_nationkey") < 5, "https://github.com/a/c/releases.atom").otherwise("https://github.com/a/b/releases.atom").alias("feed_url"),
        F.array(F.lit(".*")).alias("accepted_tag_patterns"), F.array().cast("array<string>").alias("excluded_tag_patterns"), F.lit("1").alias("policy_version"),
    )
    return validate(table, ["key"], registry.rules("release")).select(F.col("key").alias("id"), "code")


@query("s12_event_log", f"select 'e' || event_id as run_id, event_type as event, {_K}::int::bigint as screened from events")
def s12(spark, root):
    path = scratch_path(spark, "event-log")
    entry = F.to_json(F.struct(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("run_id"), F.col("event_type").alias("event"), F.struct(k().alias("screened_candidate_count")).alias("discovery_metrics")))
    # A blank line after every entry: the reader must skip it.
    load(spark, root, "events").select(F.concat(entry, F.lit("\n")).alias("value")).write.text(path)
    return landing.read_event_log(spark, path).select("run_id", "event", F.col("discovery_metrics.screened_candidate_count").cast("long").alias("screened"))


@query("s13_manifest_days", """
select distinct event_type as source_id, strftime(ts::date, '%Y-%m-%d') as day, user_id % 7 = 0 as gapped from events where ts >= timestamp '2024-01-08' and ts < timestamp '2024-01-22'""")
def s13(spark, root):
    path = scratch_path(spark, "manifests")
    gap = F.when(F.col("user_id") % 7 == 0, F.array(F.struct(F.col("event_type").alias("source_id"), F.lit("no_ledger_overlap").alias("reason")))).otherwise(F.array().cast("array<struct<source_id:string,reason:string>>"))
    load(spark, root, "events").select(
        F.to_date("ts").alias("dt"), F.to_json(F.struct(F.lit("partial").alias("status"), F.array("event_type").alias("successful_sources"), gap.alias("known_gaps"))).alias("value")
    ).write.partitionBy("dt").text(path)
    # One manifest per line and day folder.
    manifests = landing.read_manifests(spark, path, "2024-01-08", 14, multi_line=False)
    return landing.manifest_days(manifests).select("source_id", F.col("day").cast("string").alias("day"), "gapped").distinct()


@query("s14_latest_receipts", f"""
with f as (select user_id as url, ts, event_id, case event_type when 'view' then 200 when 'click' then 304 end as st, {_K} as sha from events),
b as (select url, max(ts) as bt, arg_max(sha, (ts, event_id)) as sha from f where st = 200 group by 1), r as (select url, max(ts) as rt from f where st = 304 group by 1)
select url, sha, epoch_us(bt)::bigint as fetched_us, epoch_us(greatest(bt, rt))::bigint as checked_us, case when rt > bt then 'revalidated' else 'fetched' end as cache_status from b left join r using (url)""")
def s14(spark, root):
    log = load(spark, root, "events").select(
        F.col("user_id").alias("url"), F.col("ts").alias("checked_at"), F.col("event_id").alias("fetch_id"), F.when(F.col("event_type") == "view", 200).when(F.col("event_type") == "click", 304).alias("http_status"),
        k().alias("sha256"), F.col("ts").alias("fetched_at"),
    )
    return landing.latest_receipts(log).select("url", F.col("sha256").alias("sha"), F.unix_micros("fetched_at").alias("fetched_us"), F.unix_micros("checked_at").alias("checked_us"), "cache_status")


_HIDDEN = r"regexp_replace(regexp_replace({x}, '(?s)<script[^>]*>.*?</script>', '{r}', 'g'), '(?s)<style[^>]*>.*?</style>', '{r}', 'g')"
_NO_COMMENT = r"regexp_replace({x}, '(?s)<!--.*?-->', '', 'g')"


@query("s15_evidence_text", f"""
select page_id, {S.collapse(S.unescape("regexp_replace(" + _HIDDEN.format(x=_NO_COMMENT.format(x=S.unescape('html')), r=' ') + r", '</?[A-Za-z][^>]*>|<![^>]*>', ' ', 'g')"))} as visible from pages""")
def s15(spark, root):
    return load(spark, root, "pages").select("page_id", markup.page_text("html", "evidence").alias("visible"))


def _page_sql(before, after):
    body = _HIDDEN.format(x=_NO_COMMENT.format(x="html"), r="")
    body = rf"regexp_replace({body}, '<h1[^>]*>', chr(10) || '# ', 'g')"
    body = rf"regexp_replace({body}, '<(?:{before})(?:\s[^>]*)?>', chr(10), 'g')"
    body = rf"regexp_replace({body}, '</(?:h1|{after})>', chr(10), 'g')"
    return body


_FINISH = r"trim(regexp_replace(regexp_replace({x}, '[^\S\n]+', ' ', 'g'), '\n(?: *\n){{2,}}', chr(10) || chr(10), 'g'), ' ' || chr(10))"


@query("s15_product_text", f"""
select page_id, {_FINISH.format(x=S.unescape("regexp_replace(" + _page_sql('p|div|section|article|li|br|hr|tr', 'p|div|li|section|article|tr') + ", '<[^>]*>', '', 'g')"))} as body from pages""")
def s15p(spark, root):
    return load(spark, root, "pages").select("page_id", markup.page_text("html", "product").alias("body"))


@query("s15_structured_text", f"""
select page_id, {_FINISH.format(x=S.unescape("regexp_replace(regexp_replace(" + _page_sql('p|div|section|article|blockquote|ul|ol|pre|br|hr|tr', 'p|div|section|article|blockquote|li|ul|ol|pre|tr') + ", '<li[^>]*>', chr(10) || '- ', 'g'), '<[^>]*>', '', 'g')"))} as body from pages""")
def s15s(spark, root):
    return load(spark, root, "pages").select("page_id", markup.page_text("html", "structured").alias("body"))


@query("s16_decode_pages", """
select page_id, sha256(html) as digest, 'utf-8' as encoding, case when page_id % 3 = 0 then 'http-header' when page_id % 3 = 1 then 'html-meta' else 'bom' end as origin, null as error, true as conflict_rejected from pages""")
def s16(spark, root):
    page = F.col("page_id") % 3
    raw = F.when(page == 2, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("html", "UTF-8"))).otherwise(F.encode("html", "UTF-8"))
    header = F.when(page == 0, "text/html; charset=UTF-8").otherwise("text/html")
    clash = F.encode(F.replace(F.col("html"), F.lit('<meta charset="utf-8">'), F.lit('<meta charset="utf-8"><meta charset="gbk">')), "UTF-8")
    decoded = load(spark, root, "pages").select(
        "page_id", markup.decode_page(raw, header).alias("d"), markup.decode_page(clash, F.lit("text/html")).alias("c")
    )
    return decoded.select("page_id", F.sha2("d.text", 256).alias("digest"), "d.encoding", "d.origin", "d.error", F.col("c.text").isNull().alias("conflict_rejected"))


@query("s16_encodings", """
select page_id, case when page_id % 8 < 3 then '<p>caf' || chr(233) || ' ' || page_id end as text, ['iso8859-1', 'utf-16-le', 'iso8859-1', 'utf-8', 'utf-8', 'utf-8', 'utf-8', 'utf-8'][page_id % 8 + 1] as encoding,
  ['http-header', 'bom', 'html-meta', 'utf-8-default', 'http-header', 'utf-8-default', 'utf-8-default', 'utf-8-default'][page_id % 8 + 1] as origin,
  case page_id % 8 when 3 then 'invalid bytes for utf-8' when 4 then 'unsupported declared charset: x-none' when 5 then 'binary document' when 6 then 'control characters' when 7 then 'unsupported media type' end as error from pages""")
def s16e(spark, root):
    n = F.col("page_id")
    body, latin = F.concat(F.lit("<p>café "), n.cast("string")), lambda c: F.encode(c, "ISO-8859-1")
    raw = (
        F.when(n % 8 == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode(body, "UTF-16LE"))).when(n % 8 == 2, latin(F.concat(F.lit('<meta charset="latin1">'), body)))
        .when(n % 8 == 5, F.concat(F.encode(F.lit("%PDF-1.4 "), "UTF-8"), latin(body))).when(n % 8 == 6, F.encode(F.concat(body, F.lit("\x01")), "UTF-8"))
        .when((n % 8).isin(4, 7), F.encode(body, "UTF-8")).otherwise(latin(body)))
    header = F.when(n % 8 == 0, "text/html; charset=latin1").when(n % 8 == 4, "text/html; charset=x-none").when(n % 8 == 7, "image/png").otherwise("text/html")
    found = load(spark, root, "pages").select("page_id", markup.decode_page(raw, header).alias("d"))
    text = F.regexp_replace("d.text", '^<meta charset="latin1">', "")
    return found.select("page_id", text.alias("text"), "d.encoding", "d.origin", "d.error")


@query("k01_write_run", "select o_orderkey, o_totalprice from orders where o_orderstatus <> 'O'")
def k01(spark, root):
    path = scratch_path(spark, "run")
    orders = load(spark, root, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    # The second day fails after a good run: its rows must be gone.
    for dt, status, kept in (("2024-01-01", "success", "F"), ("2024-01-02", "success", "O"), ("2024-01-02", "failed", "O"), ("2024-01-03", "success", "P")):
        writers.write_run(orders.where(F.col("o_orderstatus") == kept).drop("o_orderstatus"), path, dt, status)
    return spark.read.schema("o_orderkey long, o_totalprice double, dt date").json(f"{path}/rows").drop("dt")


@query("k02_issue_lines", """
with d as (select doc_id, lang, source, n_chars > 3000 as f, case lang when 'en' then 1 when 'fr' then 2 when 'de' then 3 else 4 end as section, case lang when 'en' then '开源项目' when 'fr' then 'Skills' when 'de' then 'AI 应用' else 'Agent 框架与编排' end as cat from documents)
select source as issue_id, section::bigint as section, doc_id + 1 as place, n::bigint as line_no,
  case n when 0 then '### ' || case when f then '★ ' else '' end || 'Doc ' || doc_id when 2 then lang when 4 then '[Doc ' || doc_id || ' 官方入口](https://h/' || doc_id || ')' else '' end as line from d, (select unnest(range(6)) as n)
union all select distinct source, section, 0, n, case n when 0 then '## ' || cat else '' end from d, (select unnest(range(2)) as n)""")
def k02(spark, root):
    lang = F.col("lang")
    items = load(spark, root, "documents").select(
        F.col("source").alias("issue_id"), (F.col("doc_id") + 1).alias("place"),
        F.when(lang == "en", "开源项目").when(lang == "fr", "Skills").when(lang == "de", "AI 应用").otherwise("Agent 框架与编排").alias("category"),
        (F.col("n_chars") > 3000).alias("featured"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"), lang.alias("summary"),
        F.concat(F.lit("https://h/"), F.col("doc_id").cast("string")).alias("url"), F.lit("project").alias("kind"), F.lit(None).cast("string").alias("event_url"),
    )
    return render.issue_lines(items).select("issue_id", F.col("section").cast("long").alias("section"), "place", F.col("line_no").cast("long").alias("line_no"), "line")


@query("k02_status_lines", """
with s as (select distinct event_type as issue_id, user_id::varchar as name, case when user_id % 9 = 0 then 'failed' else 'ok' end as st from events)
select issue_id, row_number() over (partition by issue_id order by name)::bigint as place, '- [' || name || '](https://h/' || name || ')：' || st || '；d' as line from s""")
def k02s(spark, root):
    name = F.col("user_id").cast("string")
    sources = load(spark, root, "events").select(
        F.col("event_type").alias("issue_id"), name.alias("name"), F.concat(F.lit("https://h/"), name).alias("url"), F.when(F.col("user_id") % 9 == 0, "failed").otherwise("ok").alias("status"), F.lit("d").alias("detail")
    )
    return render.status_lines(sources).select("issue_id", "place", "line")


@query("k03_append_state", "select o_orderkey as run_id, o_orderstatus as content_hash from orders")
def k03(spark, root):
    path = scratch_path(spark, "state-log")
    rows = load(spark, root, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("content_hash"))
    rows.where("content_hash <> 'P'").write.parquet(path)
    ledger.append_state(rows, path, "run_id", "content_hash")
    # A full replay must add nothing.
    ledger.append_state(rows, path, "run_id", "content_hash")
    return ledger.read_state(spark, path, rows.schema)


@query("k03_state_conflicts", "select o_orderkey as run_id, 'x' as content_hash, o_orderstatus as recorded_hash from orders where o_orderstatus = 'P'")
def k03c(spark, root):
    rows = load(spark, root, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("content_hash"))
    changed = rows.withColumn("content_hash", F.when(F.col("content_hash") == "P", "x").otherwise(F.col("content_hash")))
    return ledger.new_entries(changed, rows, "run_id", "content_hash")[1]


@query("k04_run_manifest", """
select (select count(*) from supplier where s_acctbal >= 0)::bigint as successful_sources, (select count(*) from supplier where s_acctbal < 0)::bigint as failed_sources, (select count(*) from orders)::bigint as queued_count,
  (select count(*) from lineitem)::bigint as filtered_count, case when exists (select 1 from supplier where s_acctbal < 0) then 'partial' else 'success' end as status""")
def k04(spark, root):
    sources = load(spark, root, "supplier").select(F.col("s_suppkey").alias("source_id"), F.when(F.col("s_acctbal") < 0, "timeout").alias("error"))
    return writers.run_manifest(sources, {"queued": load(spark, root, "orders"), "filtered": load(spark, root, "lineitem")}).drop("review_error")


@query("k06_expired_partitions", "select distinct strftime(ts, '%Y-%m-%d') as name from events where ts::date < date '2024-01-25' - 10")
def k06(spark, root):
    names = load(spark, root, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("name")).distinct()
    odd = load(spark, root, "nation").select(F.col("n_name").alias("name"))
    return writers.expired_partitions(names.unionByName(odd), F.lit("2024-01-25").cast("date"), 10)


@query("k07_audit_snapshot", """
select doc_id::varchar as path, case when doc_id % 10 = 0 then 'missing' when doc_id % 10 = 1 then 'unlisted' when doc_id % 10 = 2 then 'changed' else 'ok' end as state from documents""")
def k07(spark, root):
    docs = load(spark, root, "documents").select(
        "doc_id", F.col("doc_id").cast("string").alias("path"), F.octet_length("text").alias("bytes"), F.sha2("text", 256).alias("sha256")
    )
    manifest = docs.where("doc_id % 10 <> 1").drop("doc_id")
    files = docs.where("doc_id % 10 <> 0").withColumn("sha256", F.when(F.col("doc_id") % 10 == 2, F.sha2("sha256", 256)).otherwise(F.col("sha256"))).drop("doc_id")
    return writers.audit_snapshot(manifest, files)


@query("k07_export_state", """
select doc_id::varchar as path, case doc_id % 6 when 0 then 'orphan' when 1 then 'missing' when 2 then 'previous_revision' when 3 then 'conflict' when 4 then 'legacy_untracked' else 'ok' end as state from documents""")
def k07e(spark, root):
    n = F.col("doc_id") % 6
    docs = load(spark, root, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha256"))
    old = F.sha2("path", 256)
    expected = docs.where(n != 0).select("path", "sha256", F.when(n == 2, old).alias("previous_sha256"), (n != 4).alias("tracked"))
    files = docs.where(n != 1).select("path", F.when(n.isin(2, 3), old).otherwise(F.col("sha256")).alias("sha256"))
    return writers.export_state(expected, files)
