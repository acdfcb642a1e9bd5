"""Queries of the scalar functions (F) over whole columns of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from curator.catalog import sqltext as S
from curator.catalog.registry import query
from curator.functions import ids, links, markup, paths, spans, text, times, urls
from curator.operators import windows
from curator.runtime import load, spread


@query("f01_normalize_url", f"select page_id, url, {S.normalize_url('url')} as normalized from pages")
def f01(spark, root):
    return load(spark, root, "pages").select("page_id", "url", urls.normalize_url("url").alias("normalized"))


@query("f02_canonical_url", f"""
select page_id, {S.canonical_reading('url')} as project_url, {S.canonical_reading('url')} as reading_url from pages""")
def f02(spark, root):
    return load(spark, root, "pages").select(
        "page_id",
        urls.canonical_url("url", "project").alias("project_url"),
        urls.canonical_url("url", "reading").alias("reading_url"),
    )


@query("f03_event_url", f"select page_id, {S.event_url('url')} as event_url from pages")
def f03(spark, root):
    return load(spark, root, "pages").select("page_id", urls.event_url("url").alias("event_url"))


@query("f04_normalize_title", f"select doc_id, {S.normalize_title('text')} as title from documents")
def f04(spark, root):
    return load(spark, root, "documents").select("doc_id", text.normalize_title("text").alias("title"))


@query("f05_normalize_evidence", f"select page_id, {S.collapse(S.unescape('html'))} as evidence from pages")
def f05(spark, root):
    return load(spark, root, "pages").select("page_id", text.normalize_evidence("html").alias("evidence"))


@query("f06_plain_text", f"""
select page_id, {S.collapse(S.unescape("regexp_replace(html, '<[^>]+>', ' ', 'g')"))} as plain from pages""")
def f06(spark, root):
    return load(spark, root, "pages").select("page_id", text.plain_text("html").alias("plain"))


@query("f07_to_utc", """
select event_id, epoch(date_trunc('second', ts))::bigint as from_zulu,
       epoch(date_trunc('second', ts))::bigint as from_offset,
       epoch(date_trunc('second', ts))::bigint as from_naive,
       epoch(date_trunc('second', ts))::bigint as from_mail,
       cast(null as bigint) as from_unknown_zone,
       cast(null as bigint) as from_junk
from events""")
def f07(spark, root):
    ts = F.col("ts")
    second = lambda c: F.unix_seconds(c)
    return load(spark, root, "events").select(
        "event_id",
        second(times.to_utc(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))).alias("from_zulu"),
        second(times.to_utc(F.concat(F.date_format(ts + F.expr("INTERVAL 8 HOURS"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+08:00")))).alias("from_offset"),
        second(times.to_utc(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))).alias("from_naive"),
        second(times.to_utc(F.concat(F.date_format(ts, "EEE, d MMM yyyy HH:mm:ss"), F.lit(" GMT")))).alias("from_mail"),
        second(times.to_utc(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), naive="null")).alias("from_unknown_zone"),
        second(times.to_utc(F.concat(F.lit("about "), F.date_format(ts, "yyyy-MM-dd")))).alias("from_junk"),
    )


@query("f07_epoch_seconds", """
select event_id, case when event_id % 2 = 0 then epoch_us(ts) else epoch_us(date_trunc('second', ts)) end::bigint as at_us, (event_id % 2 = 0) as fractional from events""")
def f07e(spark, root):
    # Odd events state whole seconds.
    even = F.col("event_id") % 2 == 0
    given = F.when(even, F.format_string("%.6f", F.unix_micros("ts") / 1_000_000)).otherwise(F.unix_seconds("ts").cast("string"))
    at = times.to_utc(given, keep_fraction=True, epoch=True)
    return load(spark, root, "events").select("event_id", F.unix_micros(at).alias("at_us"), even.alias("fractional"))


@query("f08_parse_publication", """
select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day, 'date' as day_precision,
       epoch(o_orderdate)::bigint as moment, 'timestamp' as moment_precision, true as naive_is_unknown
from orders""")
def f08(spark, root):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    stated = times.parse_publication(day)
    clock = times.parse_publication(F.concat(day, F.lit(" 00:00:00 GMT")))
    naive = times.parse_publication(F.concat(day, F.lit("T00:00:00")))
    return load(spark, root, "orders").select(
        "o_orderkey",
        stated["event_date"].cast("string").alias("day"), stated["precision"].alias("day_precision"),
        F.unix_seconds(clock["event_at"]).alias("moment"), clock["precision"].alias("moment_precision"),
        naive.isNull().alias("naive_is_unknown"),
    )


@query("f09_date_supported", """
select o_orderkey, true as iso, true as named, true as cjk, false as clock_known,
       day(o_orderdate) > 12 as us_meta, true as instant, false as other_day
from orders""")
def f09(spark, root):
    d = F.col("o_orderdate")
    day = F.date_format(d, "yyyy-MM-dd")
    zulu = F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    says = lambda quote: times.date_supported(day, quote)
    return load(spark, root, "orders").select(
        "o_orderkey",
        says(F.concat(F.lit("released on "), day)).alias("iso"),
        says(F.concat(F.lit("Released "), F.date_format(d, "MMMM d, yyyy"))).alias("named"),
        says(F.concat(F.lit("发布于 "), F.date_format(d, "yyyy年M月d日"))).alias("cjk"),
        says(F.concat(F.lit("time "), zulu)).alias("clock_known"),
        says(F.concat(F.lit("<meta name='publication-date' content='"), F.date_format(d, "MM-dd-yyyy"), F.lit("'>"))).alias("us_meta"),
        times.date_supported(zulu, F.concat(F.lit("at "), F.date_format(d + F.expr("INTERVAL 8 HOURS"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+08:00"))).alias("instant"),
        says(F.date_format(d + F.expr("INTERVAL 1 DAY"), "yyyy-MM-dd")).alias("other_day"),
    )


@query("f10_harvest_links", f"""
with p as (select page_id, {S.normalize_url('url')} as u,
           regexp_extract_all(html, '<a href="([^"]*)"', 1) as hrefs,
           lower({S.part('url', 1)}) || '://' || {S.part('url', 2)} as site from pages)
select page_id, u as url, array_to_string(list_filter(list_distinct(list_transform(hrefs, lambda h: site || h)), lambda x: x <> u).list_sort(), ' ') as extra_urls,
       'original_link' as relation from p""")
def f10(spark, root):
    pages = load(spark, root, "pages")
    hrefs = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    site = F.concat(urls.split_url("url")["scheme"], F.lit("://"), urls.split_url("url")["authority"])
    payload = F.to_json(F.struct(
        F.transform(hrefs, lambda h: F.concat(site, h)).alias("related"),
        F.struct(F.col("url").alias("original")).alias("links"),
    ))
    field = lambda name: F.get_json_object("payload", f"$.{name}")
    found = pages.withColumn("payload", payload).select(
        "page_id", links.declared_links(field("links"), field("related")).alias("l")
    )
    return found.select(
        "page_id", "l.url",
        F.array_join(F.array_sort("l.extra_urls"), " ").alias("extra_urls"), "l.relation",
    )


@query("f11_source_links", f"""
with p as (select page_id, {S.normalize_url('url')} as u,
           list_transform(regexp_extract_all(html, '<a href="([^"]*)"', 1),
             lambda h: lower({S.part('url', 1)}) || '://' || {S.part('url', 2)} || h) as e,
           case when starts_with({S.part('url', 2)}, 'www.') then 'aggregator' else 'open_source' end as cls from pages),
l as (select page_id, u as url, case when cls = 'aggregator' then 'original_link_from_aggregator' else 'direct_source' end as provenance from p
      union select page_id, unnest(e), case when cls = 'aggregator' then 'discovery_link' else 'related_source' end from p)
select page_id, string_agg(provenance || ' ' || url, '|' order by url, provenance) as links from l group by page_id""")
def f11(spark, root):
    hrefs = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    site = F.concat(urls.split_url("url")["scheme"], F.lit("://"), urls.split_url("url")["authority"])
    cls = F.when(urls.split_url("url")["authority"].startswith("www."), F.lit("aggregator")).otherwise("open_source")
    labelled = links.source_links(
        F.col("url"), F.transform(hrefs, lambda h: F.concat(site, h)), F.lit("pages"), cls, F.lit("original_link")
    )
    return load(spark, root, "pages").select(
        "page_id",
        F.array_join(F.transform(labelled, lambda x: F.concat(x["provenance"], F.lit(" "), x["url"])), "|").alias("links"),
    )


@query("f12_periods", """
with e as (select event_id, ts + interval 8 hour as l from events),
d as (select event_id, l::date as d, date_trunc('week', l)::date as w, date_trunc('month', l)::date as m from e)
select event_id, strftime(d, '%Y-%m-%d') as daily, strftime(w, '%Y-%m-%d') as weekly, strftime(m, '%Y-%m') as monthly,
       strftime((w + interval 6 day)::date, '%Y-%m-%d') as week_end,
       strftime((m + interval 1 month - interval 1 day)::date, '%Y-%m-%d') as month_end,
       epoch(d + interval 1 day + interval 1 hour)::bigint as daily_due,
       epoch(w + interval 7 day + interval 2 hour)::bigint as weekly_due,
       epoch(m + interval 1 month + interval 3 hour)::bigint as monthly_due
from d""")
def f12(spark, root):
    named = load(spark, root, "events").select(
        "event_id", *[times.period_of("ts", r).alias(r) for r in ("daily", "weekly", "monthly")]
    )
    window = {r: times.period_window(r, r) for r in ("daily", "weekly", "monthly")}
    return named.select(
        "*",
        window["weekly"]["end_date"].cast("string").alias("week_end"),
        window["monthly"]["end_date"].cast("string").alias("month_end"),
        *[F.unix_seconds(window[r]["due_at"]).alias(f"{r}_due") for r in window],
    )


@query("f13_event_bounds", """
select o_orderkey, epoch_us(o_orderdate)::bigint as point_earliest, epoch_us(o_orderdate)::bigint as point_latest,
       epoch_us(o_orderdate - interval 14 hour)::bigint as date_earliest,
       epoch_us(o_orderdate + interval 36 hour)::bigint - 1 as date_latest from orders""")
def f13(spark, root):
    at, none_at = F.col("o_orderdate"), F.lit(None).cast("timestamp")
    point = times.event_bounds(at, F.lit(None).cast("date"))
    day = times.event_bounds(none_at, F.to_date("o_orderdate"))
    micros = F.unix_micros
    return load(spark, root, "orders").select(
        "o_orderkey",
        micros(point["earliest"]).alias("point_earliest"), micros(point["latest"]).alias("point_latest"),
        micros(day["earliest"]).alias("date_earliest"), micros(day["latest"]).alias("date_latest"),
    )


@query("f14_event_time_key", """
select event_id, case when event_type = 'error' then 'date|' || strftime(ts, '%Y-%m-%d') || '|date|unknown'
       else 'timestamp|' || epoch_us(ts) end as time_key from events""")
def f14(spark, root):
    dated = F.col("event_type") == "error"
    return load(spark, root, "events").select(
        "event_id",
        times.event_time_key(F.when(~dated, F.col("ts")), F.when(dated, F.to_date("ts"))).alias("time_key"),
    )


@query("f15_stable_ids", f"""
select d.doc_id, sha256(source || chr(10) || {S.normalize_title('text')}) as item_id,
       sha256('event:' || {S.normalize_title('text')}) as event_id,
       'p_' || substr(sha256(source || chr(0) || sha256(text) || chr(0) || '0'), 1, 24) as passage_id,
       'ext-' || substr(sha256(lang || chr(10) || source || chr(10) || '' || chr(10) || sha256(text)), 1, 12) as evidence_id,
       sha256('{{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '"}}') as canonical_hash
from documents d""")
def f15(spark, root):
    none = F.lit("")
    return load(spark, root, "documents").select(
        "doc_id",
        ids.item_id("source", none, F.col("text")).alias("item_id"),
        ids.story_id(none, none, F.col("text")).alias("event_id"),
        ids.passage_id("source", "text", F.lit(0)).alias("passage_id"),
        ids.evidence_id(F.col("lang"), F.col("source"), F.lit(None).cast("string"), F.col("text")).alias("evidence_id"),
        ids.canonical_hash({"source": F.col("source"), "lang": F.col("lang"), "doc_id": F.col("doc_id")}).alias("canonical_hash"),
    )


@query("f16_classify_repo_url", """
with p as (select p_partkey, replace(p_brand, '#', '-') as o, replace(p_name, ' ', '_') as r, p_size as n from part)
select p_partkey, 'repository' as repo_kind, o || '/' || r as repository, 'release' as release_kind, 'v' || n as release_ref,
       'pull' as pull_kind, cast(n as varchar) as pull_ref, 'tree' as tree_kind, 'main/src' as tree_ref, true as plain_host_rejected,
       'v' || n || '+b' as tag, 'docs/a.md' as pinned from p""")
def f16(spark, root):
    home = F.concat(F.lit("https://github.com/"), F.replace(F.col("p_brand"), F.lit("#"), F.lit("-")), F.lit("/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")))
    repo = F.regexp_replace(home, "^https://github.com/", "")
    size = F.col("p_size").cast("string")
    of = lambda tail: urls.classify_repo_url(F.concat(home, *tail))
    # Each page is classified once; the table is small for what its rows cost.
    pages = spread(load(spark, root, "part").select("p_partkey", "p_brand", "p_name", "p_size")).select(
        "p_partkey", of([F.lit(".git")]).alias("repo"), of([]).alias("plain"), of([F.lit("/releases/tag/v"), size]).alias("release"),
        of([F.lit("/pull/"), size]).alias("pull"), of([F.lit("/tree/main/src")]).alias("tree"),
        urls.classify_repo_url(F.concat(F.lit("https://example.org/"), repo)).isNull().alias("plain_host_rejected"),
        urls.release_tag(F.concat(home, F.lit("/releases/tag/v"), size, F.lit("%2Bb")), F.lit("")).alias("tag"),
        urls.pinned_blob_path(F.concat(home, F.lit("/blob/abc/docs/a.md")), repo, F.lit("abc")).alias("pinned"),
    )
    return pages.select(
        "p_partkey", F.col("repo.kind").alias("repo_kind"), "plain.repository", F.col("release.kind").alias("release_kind"), F.col("release.ref").alias("release_ref"),
        F.col("pull.kind").alias("pull_kind"), F.col("pull.ref").alias("pull_ref"), F.col("tree.kind").alias("tree_kind"), F.col("tree.ref").alias("tree_ref"),
        "plain_host_rejected", "tag", "pinned",
    )


@query("f17_address_ranges", """
select doc_id, doc_id % 64 not between 16 and 31 as in_172, doc_id % 256 not between 64 and 127 as in_100, doc_id % 16 <> 8 as in_192,
  doc_id % 256 not in (0, 10, 127) and doc_id % 256 < 240 as first_octet, doc_id % 3 <> 0 as six, doc_id % 2 = 0 as named, doc_id * 97 % 80000 <= 65535 as port from documents""")
def f17a(spark, root):
    n = F.col("doc_id")
    at = lambda *parts: urls.is_public_url(F.concat(F.lit("http://"), *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts], F.lit("/x")))
    return load(spark, root, "documents").select(
        "doc_id", at("172.", n % 64, ".0.1").alias("in_172"), at("100.", n % 256, ".0.1").alias("in_100"), at("192.", n % 16 + 160, ".3.4").alias("in_192"),
        at(n % 256, ".1.1.1").alias("first_octet"), at(F.when(n % 3 == 0, "[fd00::1]").otherwise("[2606:4700::1]")).alias("six"),
        at("h", n, F.when(n % 2 == 0, ".example.org").otherwise(".internal")).alias("named"), at("h.example.org:", n * 97 % 80000).alias("port"))


@query("f17_is_public_url", f"""
with h as (select page_id, url, {S.part('url', 2)} as host from pages)
select page_id, host not like '%.local' as as_is, true as by_name, false as credentials, false as loopback, false as internal, true as public_address from h""")
def f17(spark, root):
    rest = F.regexp_replace("url", r"^https?://[^/]*", "")
    host = urls.split_url("url")["authority"]
    at = lambda name: urls.is_public_url(F.concat(F.lit("http://"), name, rest))
    return load(spark, root, "pages").select(
        "page_id",
        urls.is_public_url("url").alias("as_is"),
        at(host).alias("by_name"),
        at(F.concat(F.lit("user:pw@"), host)).alias("credentials"),
        at(F.lit("127.0.0.1")).alias("loopback"),
        at(F.concat(host, F.lit(".internal"))).alias("internal"),
        at(F.lit("8.8.8.8:80")).alias("public_address"),
    )


@query("f18_extract_urls", """
with c as (select doc_id, coalesce(url, 'https://h.example/' || doc_id) as url, text from documents left join pages on page_id = doc_id)
select doc_id, 2 as n, url || ' ' || 'https://github.com/a/b' as urls from c""")
def f18(spark, root):
    pages, docs = load(spark, root, "pages"), load(spark, root, "documents")
    both = docs.join(pages, pages.page_id == docs.doc_id, "left").withColumn("url", F.coalesce("url", F.concat(F.lit("https://h.example/"), F.col("doc_id").cast("string"))))
    message = F.concat("text", F.lit(" see <"), "url", F.lit("> and github.com/a/b; or again "), "url", F.lit(".;"))
    found = text.extract_urls(message)
    return both.select("doc_id", F.size(found).alias("n"), F.array_join(found, " ").alias("urls"))


@query("f19_title_features", f"""
select doc_id, len({S.features('text')})::bigint as n, sha256(array_to_string(list_sort({S.features('text')}), ' ')) as digest from documents""")
def f19(spark, root):
    f = text.title_features("text")
    return load(spark, root, "documents").select("doc_id", f.alias("f")).select(
        "doc_id", F.size("f").cast("long").alias("n"), F.sha2(F.array_join(F.array_sort("f"), " "), 256).alias("digest")
    )


@query("f20_jaccard", f"""
with t as (select page_id, {S.features(S.TITLE)} as a from pages),
     b as (select d.doc_id, coalesce(a, []) as a, {S.features('d.text')} as b from documents d left join t on t.page_id = d.doc_id)
select doc_id, round(case when len(a) = 0 or len(b) = 0 then 0.0
       else len(list_intersect(a, b))::double / len(list_distinct(list_concat(a, b))) end, 6) as similarity from b""")
def f20(spark, root):
    pages, docs = load(spark, root, "pages"), load(spark, root, "documents")
    title = text.unescape(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    both = docs.select("doc_id", text.title_features("text").alias("b")).join(
        pages.select("page_id", text.title_features(title).alias("a")), F.col("page_id") == F.col("doc_id"), "left"
    ).withColumn("a", F.coalesce("a", F.array().cast("array<string>")))
    return both.select("doc_id", F.round(text.jaccard("a", "b"), 6).alias("similarity"))


@query("f21_doc_purpose", """
with p as (select p_partkey, replace(p_name, ' ', '/') as folder, lower(p_type) as t from part)
select p_partkey, case t when 'small' then 'license' when 'medium' then 'installation' when 'large' then 'usage' end as basic,
       case t when 'small' then 'license' when 'medium' then 'installation' when 'large' then 'usage'
              when 'economy' then 'overview' when 'promo' then 'usage' end as discovery,
       true as safe, false as escapes, true as sensitive from p""")
def f21(spark, root):
    folder = F.concat(F.lit("docs/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("/")), F.lit("/"))
    kind = F.lower("p_type")
    name = (
        F.when(kind == "small", F.lit("LICENSE.txt")).when(kind == "medium", F.lit("Getting Started.md"))
        .when(kind == "large", F.lit("User_Guide.rst")).when(kind == "economy", F.lit("features.html"))
        .when(kind == "promo", F.lit("My FAQ.htm")).otherwise("main.py")
    )
    path = F.concat(folder, name)
    return load(spark, root, "part").select(
        "p_partkey", paths.doc_purpose(path).alias("basic"), paths.doc_purpose(path, "discovery").alias("discovery"),
        paths.is_safe_path(path).alias("safe"), paths.is_safe_path(F.concat(F.lit("../"), path)).alias("escapes"),
        paths.is_sensitive_path(F.concat(folder, F.lit("secrets.md"))).alias("sensitive"),
    )


@query("f22_clean_categories", """
with g as (select c_custkey, [c_mktsegment, ' ' || lower(c_mktsegment) || '  x', c_mktsegment, ' '] as c from customer)
select c_custkey, c[1] || '|' || lower(c[1]) || ' x' as categories from g""")
def f22(spark, root):
    seg = F.col("c_mktsegment")
    given = F.array(seg, F.concat(F.lit(" "), F.lower(seg), F.lit("  x")), seg, F.lit(" "))
    return load(spark, root, "customer").select("c_custkey", F.array_join(text.clean_categories(given), "|").alias("categories"))


@query("f23_split_statements", """
select doc_id, sha256(text) as whole, true as ids_in_order from documents where trim(text) <> ''""")
def f23(spark, root):
    docs = load(spark, root, "documents").select("doc_id", text.split_statements("text").alias("s")).where("s is not null")
    joined = F.array_join(F.transform("s", lambda x: x["text"]), "")
    ordered = F.forall(
        F.arrays_zip(F.transform("s", lambda x: x["id"]).alias("id"), F.sequence(F.lit(0), F.size("s") - 1).alias("n")),
        lambda z: z["id"] == F.concat(F.lit("s"), z["n"].cast("string")),
    )
    return docs.select("doc_id", F.sha2(joined, 256).alias("whole"), ordered.alias("ids_in_order"))


@query("f24_headings", f"""
select page_id, trim({S.TITLE}) as first_title, 1 as level, 1 as n, 2 as start from pages""")
def f24(spark, root):
    title = text.unescape(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    markdown = F.concat(F.lit("\n\n# "), title, F.lit("\n```\n# not a heading\n```\nplain words\n"))
    found = load(spark, root, "pages").select("page_id", markup.headings_of(markdown).alias("h"))
    first = F.get("h", 0)
    return found.select(
        "page_id", first["title"].alias("first_title"), first["level"].alias("level"),
        F.size("h").alias("n"), first["start"].alias("start"),
    )


@query("f25_passages", """
select doc_id, sha256(text) as whole, true as within_limit from documents where trim(text) <> ''""")
def f25(spark, root):
    docs = load(spark, root, "documents")
    cut = docs.select("doc_id", "text", markup.passages_of("text").alias("p")).where(F.size("p") > 0)
    rebuilt = F.aggregate(
        "p", F.lit(""),
        # The gap before a passage can only be blank; take it from the source.
        lambda done, x: F.concat(done, F.substring(F.col("text"), F.length(done) + 1, x["start"] - F.length(done)), x["quote"]),
    )
    tail = F.substring(F.col("text"), F.length(rebuilt) + 1, F.length("text"))
    return cut.select(
        "doc_id",
        F.sha2(F.concat(rebuilt, tail), 256).alias("whole"),
        (F.forall("p", lambda x: F.length(x["quote"]) <= 2400) & (F.trim(F.regexp_replace(tail, r"\s", "")) == "")).alias("within_limit"),
    )


@query("f26_quote_span", """
select doc_id, instr(text, lang_word) - 1 as first_at, instr(text, lang_word) - 1 + length(lang_word) as last_at
from (select doc_id, text, regexp_extract(text, '[a-z]+\\.', 0) as lang_word from documents) where lang_word <> ''""")
def f26(spark, root):
    word = F.regexp_extract("text", r"[a-z]+\.", 0)
    span = text.quote_span(F.col("text"), word)
    return load(spark, root, "documents").where(word != "").select(
        "doc_id", span["start"].alias("first_at"), span["end"].alias("last_at")
    )


@query("f27_excerpt_ranges", """
with d as (select doc_id, length(text) as size, lower(text) as t, 4000 as lim, 2000 as pre, 1998 as rem from documents),
h as (select *, list_min(list_filter(list_transform(['than', 'les', 'nicht', 'que'],
        lambda k: case when instr(substr(t, pre + 1), k) > 0 then instr(substr(t, pre + 1), k) + pre - 1 else -1 end), lambda x: x >= 0)) as c from d),
s as (select *, greatest(pre, least(c - 200, size - rem)) as st from h)
select doc_id, case when size <= lim then '0-' || size when c is null or st = pre then '0-' || lim
       else '0-' || pre || ' ' || st || '-' || (st + rem) end as ranges from s""")
def f27(spark, root):
    words = F.array(*[F.lit(w) for w in ("than", "les", "nicht", "que")])
    r = text.excerpt_ranges("text", 4000, words)
    return load(spark, root, "documents").select(
        "doc_id",
        F.array_join(F.transform(r, lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), " ").alias("ranges"),
    )


@query("f28_merge_ranges", """
with l as (select l_orderkey, l_linenumber * 10 as a, l_linenumber * 10 + l_quantity::int as b from lineitem),
m as (select *, max(b) over (partition by l_orderkey order by a, b rows between unbounded preceding and 1 preceding) as prev from l),
g as (select *, sum(case when prev is null or a > prev then 1 else 0 end) over (partition by l_orderkey order by a, b rows unbounded preceding) as island from m)
select l_orderkey, min(a)::bigint as first_line, max(b)::bigint as last_line from g group by l_orderkey, island""")
def f28(spark, root):
    lines = load(spark, root, "lineitem").select(
        "l_orderkey", (F.col("l_linenumber") * 10).cast("long").alias("first_line"),
        (F.col("l_linenumber") * 10 + F.col("l_quantity")).cast("long").alias("last_line"),
    )
    return windows.merge_intervals(lines, ["l_orderkey"], "first_line", "last_line")


@query("f28_remap", """
with d as (select doc_id, length(text) + 40 as n from documents)
select doc_id, '5-' || (n // 2) || ' ' || (n - 4) || '-' || n as merged, (n // 2 - 5 + 4)::bigint as chars,
  '7-' || (n // 2) || ' ' || (n - 4) || '-' || (n - 3) as remapped from d""")
def f28r(spark, root):
    # Forty characters more than the text, so that short texts have room for the ranges too.
    n = F.length("text") + 40
    half = F.floor(n / 2).cast("int")
    span = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    shown = lambda r: F.array_join(F.transform(r, lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), " ")
    given = F.array(span(n - 4, n), span(F.lit(9), half), span(F.lit(5), F.lit(12)), span(F.lit(3), F.lit(3)))
    merged = load(spark, root, "documents").select("doc_id", "text", spans.merge_ranges(given).alias("m"))
    segments = spans.supplied_segments("m")
    # Drop the first two supplied characters and the last three.
    supplied = F.array(span(F.lit(2), F.try_element_at(segments, F.lit(-1))["supplied_end"] - 3))
    return merged.select(
        "doc_id", shown(F.col("m")).alias("merged"), spans.covered("m").cast("long").alias("chars"), shown(spans.remap(supplied, segments)).alias("remapped")
    )


@query("f29_json_field_ranges", """
with j as (select page_id, '{"id":' || page_id || ', "name": "' || regexp_extract(url, '^[^/]*//([^/]*)', 1) || '", "n":{"name":"x"},"homepage":"' || url || '"}' as t,
           length(regexp_extract(url, '^[^/]*//([^/]*)', 1)) as h, length(url) as u, length(page_id::varchar) as k from pages)
select page_id, (8 + k) || '-' || (8 + k + 10 + h) || ' ' || (8 + k + 10 + h + 19) || '-' || (8 + k + 10 + h + 19 + 13 + u) as ranges from j""")
def f29(spark, root):
    doc = F.concat(
        F.lit('{"id":'), F.col("page_id").cast("string"), F.lit(', "name": "'), urls.split_url("url")["authority"],
        F.lit('", "n":{"name":"x"},"homepage":"'), F.col("url"), F.lit('"}'),
    )
    r = load(spark, root, "pages").select("page_id", spans.json_field_ranges(doc).alias("r"))
    return r.select("page_id", F.array_join(F.transform("r", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), " ").alias("ranges"))


@query("f31_evaluation_target", """
select event_id, case event_type when 'click' then 'whole_project' when 'view' then 'content_and_method' else 'event_increment' end as unit from events""")
def f31(spark, root):
    from curator.operators.scoring import evaluation_target

    kind = F.when(F.col("event_type") == "click", F.lit("project")).when(F.col("event_type") == "view", F.lit("reading")).when(
        F.col("event_type") == "error", F.lit("news")).otherwise("update")
    return load(spark, root, "events").select("event_id", evaluation_target(kind).alias("unit"))


@query("f33_route_overview", """
select doc_id, case when length(text) <= 2000 and regexp_matches(text, '(?i)source[_ ]code|\\bdevelopment\\b|\\bbuilding\\b') then 'short_source_development_entry' else 'repository_overview' end as plain_route,
       case when length(text) + 12 <= 2000 then 'short_source_development_entry' else 'repository_overview' end as build_route,
       'generated_application_template' as template_route from documents""")
def f33(spark, root):
    add = lambda s: text.route_overview(F.concat(F.col("text"), F.lit(s)))
    return load(spark, root, "documents").select(
        "doc_id", text.route_overview("text").alias("plain_route"),
        add(" Source code").alias("build_route"), add(" AppWizard has created").alias("template_route"),
    )
