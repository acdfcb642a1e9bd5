"""Queries of the filters (P) and joins (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from curator.catalog import sqltext as S
from curator.catalog.registry import query
from curator.constants import NOISE_TERMS, WORKFLOW_TERMS
from curator.functions import text, urls
from curator.operators import filters, joins
from curator.runtime import load

_K = "cast(json_extract(props, '$.k') as bigint)"


def k():
    return F.get_json_object("props", "$.k").cast("long")


@query("p01_filter_releases", r"""
with s as (select n_nationkey, case when n_regionkey < 3 then '(red|old|small) .*' else '.*' end as acc, case when n_regionkey = 1 then 'ring$' else 'bolt' end as exc from nation),
r as (select p_partkey, p_name as tag, p_type = 'PROMO' as pre, p_retailprice > 950 as has_notes, p_size % 25 as nk from part)
select p_partkey, concat_ws(',', case when pre then 'prerelease_tag' end, case when not regexp_full_match(tag, acc) then 'tag_not_allowed' end,
   case when regexp_matches(tag, exc) then 'tag_excluded' end, case when not has_notes then 'incomplete_release' end) as reasons,
   not pre and regexp_full_match(tag, acc) and not regexp_matches(tag, exc) and has_notes as eligible
from r join s on nk = n_nationkey""")
def p01(spark, root):
    sources = load(spark, root, "nation").select(
        F.col("n_nationkey").alias("source_id"),
        F.when(F.col("n_regionkey") < 3, F.array(F.lit("(red|old) .*"), F.lit("small .*"))).otherwise(F.array(F.lit(".*"))).alias("accepted_tag_patterns"),
        F.when(F.col("n_regionkey") == 1, F.array(F.lit("RING$"))).otherwise(F.array(F.lit("bolt"))).alias("excluded_tag_patterns"),
    )
    releases = load(spark, root, "part").select(
        "p_partkey", (F.col("p_size") % 25).alias("source_id"), F.col("p_name").alias("release_tag"),
        (F.col("p_type") == "PROMO").alias("prerelease"), F.lit("https://h/").alias("url"), F.lit("2024-01-01").alias("published_at"),
        F.when(F.col("p_retailprice") > 950, "notes").otherwise("").alias("notes"),
    )
    return filters.filter_releases(releases, sources).select("p_partkey", F.array_join("reasons", ",").alias("reasons"), "eligible")


@query("p02_window_filter", """
select event_type, count(*) filter (where ts > timestamp '2024-01-20')::bigint as future, count(*) filter (where ts < timestamp '2024-01-18')::bigint as outside,
       count(*) filter (where ts between timestamp '2024-01-18' and timestamp '2024-01-20')::bigint as inside from events group by 1""")
def p02(spark, root):
    state = filters.window_state(F.col("ts"), F.lit("2024-01-20").cast("timestamp"), 48)
    return load(spark, root, "events").groupBy("event_type").agg(
        *[F.count_if(state == s).alias(s) for s in ("future", "outside", "inside")]
    )


@query("p02_window_rows", "select event_id from events where ts between timestamp '2024-01-18' and timestamp '2024-01-20'")
def p02r(spark, root):
    return filters.window_filter(load(spark, root, "events"), "ts", F.lit("2024-01-20").cast("timestamp"), 48).select("event_id")


@query("p03_period_eligible", """
with j as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, o_orderdate, o_orderstatus,
   date '1998-03-01' as s, date '1998-03-31' as e from lineitem join orders on l_orderkey = o_orderkey),
x as (select *, o_orderdate - interval 14 hour + interval 8 hour >= s and o_orderdate + interval 44 hour - interval 1 microsecond < e + interval 1 day as inside,
   (o_orderdate - interval 6 hour)::date > e as after, (l_shipdate + interval 8 hour)::date <= e as in_time from j)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
  case when o_orderstatus = 'F' then inside and (in_time or l_linenumber > 3)
       when after then false else in_time or (inside and l_linenumber > 3) end as eligible from x""")
def p03(spark, root):
    lines, orders = load(spark, root, "lineitem"), load(spark, root, "orders")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    ok = filters.period_eligible(
        F.when(F.col("o_orderstatus") == "F", "news").otherwise("update"), F.lit("verified"),
        F.lit(None).cast("timestamp"), F.to_date("o_orderdate"), F.lit("u"),
        F.when(F.col("l_linenumber") > 3, F.array(F.lit("u"))).otherwise(F.array(F.lit("v"))),
        F.col("l_shipdate"), F.lit("1998-03-01").cast("date"), F.lit("1998-03-31").cast("date"),
    )
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", ok.alias("eligible"))


@query("p04_eligibility", """
select d.doc_id, case when l.toxic = 1 then 'blocked' when coalesce(l.quality, 0) = 0 or n_chars < 1000 then 'needs_evidence' else 'available' end as state,
   case when l.toxic = 1 then 1 else (coalesce(l.quality, 0) = 0)::int + (n_chars < 1000)::int end as reasons
from documents d left join labels l using (doc_id)""")
def p04(spark, root):
    joined = load(spark, root, "documents").select("doc_id", "n_chars").join(load(spark, root, "labels"), "doc_id", "left")
    verdict = filters.eligibility(
        F.when(F.col("toxic") == 1, "toxic"), F.lit("available"),
        F.when(F.col("quality") == 1, "verified").otherwise("discovered"), F.col("n_chars") >= 1000,
    )
    return joined.select("doc_id", verdict["state"].alias("state"), F.size(verdict["reasons"]).alias("reasons"))


@query("p05_source_risk", """
with s as (select s_suppkey, s_acctbal < 0 as archived, s_suppkey % 7 = 0 as fork,
   case n_regionkey when 0 then 'MIT' when 1 then 'NOASSERTION' when 2 then 'GPL-3.0' when 3 then null else 'Apache-2.0' end as lic from supplier join nation on s_nationkey = n_nationkey),
k as (select *, case when lic <> 'NOASSERTION' then lic end as known from s)
select s_suppkey, archived or known is null or known not in ('MIT', 'Apache-2.0') as learning_only,
   concat_ws(',', case when fork then 'fork_redirected_to_upstream' end, case when archived then 'archived_repository' end,
     case when known is null then 'license_unknown' end, case when known not in ('MIT', 'Apache-2.0') then 'license_requires_review' end) as reasons from k""")
def p05(spark, root):
    region = F.col("n_regionkey")
    license_id = F.when(region == 0, "MIT").when(region == 1, "NOASSERTION").when(region == 2, "GPL-3.0").when(region == 4, "Apache-2.0")
    joined = joins.with_source(
        load(spark, root, "supplier").withColumnRenamed("s_nationkey", "n_nationkey"), load(spark, root, "nation"), "n_nationkey"
    )
    risk = filters.source_risk(F.col("s_suppkey") % 7 == 0, F.col("s_acctbal") < 0, license_id, F.array(F.lit("MIT"), F.lit("Apache-2.0")))
    return joined.select("s_suppkey", risk["learning_only"].alias("learning_only"), F.array_join(risk["reasons"], ",").alias("reasons"))


@query("p06_fresh", """
select l_orderkey, count(*)::bigint as n, count(*) filter (where l_shipdate + interval 1 hour - o_orderdate between interval 0 hour and interval 240 hour
   and (o_orderdate + interval 8 hour)::date >= date '1996-01-01')::bigint as fresh from lineitem join orders on l_orderkey = o_orderkey group by 1""")
def p06(spark, root):
    lines, orders = load(spark, root, "lineitem"), load(spark, root, "orders")
    fresh = filters.is_fresh(F.col("o_orderdate"), F.col("l_shipdate") + F.expr("INTERVAL 1 HOUR"), F.lit("1996-01-01").cast("date"), 240)
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(fresh).alias("fresh")
    )


@query("p08_has_term", f"""
select doc_id, {' or '.join(f"contains(lower(text), '{t}')" for t in WORKFLOW_TERMS)} as workflow,
   {' or '.join(f"contains(lower(text), '{t}')" for t in NOISE_TERMS)} as noise, contains(lower(text), 'than') or contains(lower(text), 'nicht') as common from documents""")
def p08(spark, root):
    return load(spark, root, "documents").select(
        "doc_id", text.has_term("text", WORKFLOW_TERMS).alias("workflow"), text.has_term("text", NOISE_TERMS).alias("noise"),
        text.has_term("text", ("Than", "nicht")).alias("common"),
    )


@query("p09_cooled_down", """
select event_id from events a where event_type = 'click' and not exists (select 1 from events b where b.event_type = 'purchase'
   and b.user_id = a.user_id and b.ts < a.ts and b.ts >= a.ts - interval 2 day)""")
def p09(spark, root):
    events = load(spark, root, "events").select("event_id", "user_id", "ts", "event_type")
    asked, log = events.where("event_type = 'click'"), events.where("event_type = 'purchase'")
    return filters.cooled_down(asked, log, "user_id", "ts", 2).select("event_id")


@query("j05_with_source", "select s_suppkey, n_name, n_regionkey from supplier join nation on s_nationkey = n_nationkey")
def j05(spark, root):
    suppliers = load(spark, root, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    return joins.with_source(suppliers, load(spark, root, "nation"), "n_nationkey").select("s_suppkey", "n_name", "n_regionkey")


@query("j06_map_advisories", """
with s as (select s_suppkey, s_suppkey as ord, lower('https://github.com/org/' || s_nationkey) as home, ['small gizmo ' || s_suppkey % 50, 'RED ring ' || s_suppkey % 50] as aliases from supplier),
a as (select p_partkey, 'https://GitHub.com/org/' || case when p_size > 25 then p_size else p_size end || '/' as loc, [p_name || ' ' || p_partkey % 50] as pk from part)
select p_partkey as advisory_id, (select arg_min(s_suppkey, ord) from s where home = rtrim(lower(loc), '/') or list_has_any(list_transform(aliases, lambda x: lower(x)), list_transform(pk, lambda x: lower(x)))) as source_id from a""")
def j06(spark, root):
    name = lambda s: F.concat(F.lit(s), (F.col("s_suppkey") % 50).cast("string"))
    sources = load(spark, root, "supplier").select(
        F.col("s_suppkey").alias("source_id"), F.col("s_suppkey").alias("ord"),
        F.concat(F.lit("org/"), F.col("s_nationkey").cast("string")).alias("repository"), F.array(name("small gizmo "), name("RED ring ")).alias("aliases"),
    )
    advisories = load(spark, root, "part").select(
        F.col("p_partkey").alias("advisory_id"), F.concat(F.lit("https://GitHub.com/org/"), F.col("p_size").cast("string"), F.lit("/")).alias("location"),
        F.array(F.concat("p_name", F.lit(" "), (F.col("p_partkey") % 50).cast("string"))).alias("packages"),
    )
    return joins.map_advisories(advisories, sources).select("advisory_id", "source_id")


@query("j07_needs_processing", """
with st as (select c_custkey, case c_mktsegment when 'BUILDING' then 'pending_review' when 'MACHINERY' then 'review_failed' else 'accepted' end as status,
   c_nationkey % 3 as pol, md5(c_name) as h from customer where c_acctbal > 0)
select o_orderkey from orders left join st on o_custkey = c_custkey
where c_custkey is null or pol <> 1 or status in ('pending_review', 'review_failed') or (o_orderstatus = 'F' and h is distinct from case when o_totalprice > 250000 then h else 'x' end)""")
def j07(spark, root):
    segment = F.col("c_mktsegment")
    state = load(spark, root, "customer").where("c_acctbal > 0").select(
        "c_custkey", F.when(segment == "BUILDING", "pending_review").when(segment == "MACHINERY", "review_failed").otherwise("accepted").alias("status"),
        (F.col("c_nationkey") % 3).alias("policy_version"), F.md5("c_name").alias("content_hash"),
    )
    # The order's content hash equals its customer's when the price is high.
    names = load(spark, root, "customer").select("c_custkey", F.md5("c_name").alias("h"))
    records = load(spark, root, "orders").withColumnRenamed("o_custkey", "c_custkey").join(names, "c_custkey", "left").select(
        "o_orderkey", "c_custkey", F.lit(1).alias("policy_version"), F.when(F.col("o_orderstatus") == "F", "security").otherwise("release").alias("item_type"),
        F.when(F.col("o_totalprice") > 250000, F.col("h")).otherwise("x").alias("content_hash"),
    )
    return joins.needs_processing(records, state, "c_custkey").select("o_orderkey")


@query("j08_observations", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, epoch(o_orderdate)::bigint as collected,
  epoch(case when l_returnflag = 'A' then l_shipdate else o_orderdate end)::bigint as discovered, case when l_linestatus = 'F' then epoch(o_orderdate)::bigint end as verified
from lineitem join orders on l_orderkey = o_orderkey where o_orderdate <= timestamp '1999-06-30'""")
def j08(spark, root):
    obs = load(spark, root, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        F.when(F.col("l_linestatus") == "F", "verified").otherwise("discovered").alias("evidence_status"),
        F.when(F.col("l_returnflag") == "A", F.col("l_shipdate")).alias("discovered_at"),
        F.lit(None).cast("timestamp").alias("verified_at"), F.lit(None).cast("string").alias("verification_level"),
    )
    batches = load(spark, root, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("collected_at"))
    seen = joins.observations(obs, batches, F.lit("1999-06-30").cast("timestamp"))
    return seen.select(
        F.col("run_id").alias("l_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        F.unix_seconds("collected_at").alias("collected"), F.unix_seconds("discovered_at").alias("discovered"), F.unix_seconds("verified_at").alias("verified"),
    )


@query("j09_match_verified", f"""
with i as (select event_id, user_id, {_K} as k from events where event_type = 'click'),
o as (select event_id as obs_id, user_id, {_K} as k, ts from events where event_type = 'view' and value > 5)
select i.event_id as item_id, arg_max(o.obs_id, (o.ts, o.obs_id)) as obs_id from i left join o on i.user_id = o.user_id and (i.k % 10) = (o.k % 10) and i.k <= o.k group by 1""")
def j09(spark, root):
    events = load(spark, root, "events").withColumn("k", k())
    common = lambda df: df.withColumn("canonical_url", F.col("user_id")).withColumns({
        "kind": F.lit("update"), "verified_at": F.lit(0), "level": F.lit("documented"), "event_key": F.col("k") % 10,
        # Item evidence is a subset exactly when its k does not exceed the observation's.
        "evidence": F.sequence(F.lit(0), F.col("k")),
    })
    items = common(events.where("event_type = 'click'")).select(F.col("event_id").alias("item_id"), "canonical_url", "kind", "verified_at", "level", "event_key", "evidence")
    obs = common(events.where("event_type = 'view'")).select(
        F.col("event_id").alias("obs_id"), F.col("ts").alias("collected_at"), F.when(F.col("value") > 5, "verified").otherwise("discovered").alias("evidence_status"),
        "canonical_url", "kind", "verified_at", "level", "event_key", "evidence",
    )
    return joins.match_verified(items, obs).select("item_id", "obs_id")


@query("j10_history", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, strftime(o_orderdate, '%Y-%m-%d') as period from lineitem join orders on l_orderkey = o_orderkey where o_orderpriority = '1-URGENT'""")
def j10(spark, root):
    issues = load(spark, root, "orders").select(
        F.col("o_orderkey").alias("issue_id"), F.when(F.col("o_orderpriority") == "1-URGENT", "daily").otherwise("weekly").alias("ranking_type"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("period"),
    )
    selections = load(spark, root, "lineitem").select(F.col("l_orderkey").alias("issue_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return joins.selection_history(selections, issues, "daily").drop("ranking_type").withColumnRenamed("issue_id", "l_orderkey")


@query("j11_bind_quotes", """
with r as (select item_id, item_id * 3 as doc_id, regexp_extract(b.text, '[A-Z][^.]*', 0) as quote from benchmark b)
select item_id, case when d.doc_id is null then 'unknown_source' when quote = '' or not contains(d.text, trim(quote)) then 'quote_not_found' end as violation
from r left join documents d on d.doc_id = r.doc_id
union all select doc_id + 1000000, null from documents where trim(text) <> ''""")
def j11(spark, root):
    docs = load(spark, root, "documents").select("doc_id", "text")
    foreign = load(spark, root, "benchmark").select(
        "item_id", (F.col("item_id") * 3).alias("doc_id"), F.regexp_extract("text", "[A-Z][^.]*", 0).alias("quote")
    )
    # Every document holds its own first word.
    own = docs.where(F.trim("text") != "").select(
        (F.col("doc_id") + 1000000).alias("item_id"), "doc_id", F.regexp_extract("text", r"(\S+)", 1).alias("quote")
    )
    return joins.bind_quotes(foreign.unionByName(own), docs, "doc_id").select("item_id", "violation")


@query("j12_match_decisions", """
with d as (select doc_id + case when toxic = 1 then 100000000 else 0 end as doc_id from labels union all select doc_id from labels where quality = 0 and toxic = 0),
c as (select doc_id, count(*) as n from d group by 1)
select coalesce(q.doc_id, c.doc_id) as doc_id, case when q.doc_id is null then 'unknown' when c.doc_id is null then 'missing' else 'duplicate' end as problem, coalesce(n, 0)::bigint as decisions
from (select distinct doc_id from documents) q full join c on q.doc_id = c.doc_id where q.doc_id is null or c.doc_id is null or n > 1""")
def j12(spark, root):
    labels = load(spark, root, "labels")
    decided = labels.select((F.col("doc_id") + F.when(F.col("toxic") == 1, 100000000).otherwise(0)).alias("doc_id")).unionByName(
        labels.where("quality = 0 and toxic = 0").select("doc_id")
    )
    return joins.match_decisions(load(spark, root, "documents"), decided, "doc_id")


@query("j13_reason_passages", """
with r as (select conv_id as unit_id, turn as field, unnest(list_distinct([conv_id, conv_id + turn * 1000])) as evidence_url from conversations)
select unit_id, field, evidence_url, doc_id as passage_id, doc_id is null as missing_ref from r left join documents on doc_id = evidence_url""")
def j13(spark, root):
    reasons = load(spark, root, "conversations").select(
        F.col("conv_id").alias("unit_id"), F.col("turn").alias("field"), F.array(F.col("conv_id"), F.col("conv_id") + F.col("turn") * 1000).alias("evidence_refs")
    )
    passages = load(spark, root, "documents").select(F.col("doc_id").alias("evidence_url"), F.col("doc_id").alias("passage_id"))
    return joins.reason_passages(reasons, passages)


@query("j13_overall_refs", """
select distinct conv_id as unit_id, unnest([conv_id, conv_id + turn * 1000]) as evidence_url from conversations""")
def j13o(spark, root):
    reasons = load(spark, root, "conversations").select(
        F.col("conv_id").alias("unit_id"), F.array(F.col("conv_id"), F.col("conv_id") + F.col("turn") * 1000).alias("evidence_refs")
    )
    return joins.overall_refs(reasons)


@query("j14_match_feed_items", f"""
with p as (select page_id, regexp_replace(lower({S.part('url', 2)}), '^www\\.', '') as publisher, {S.event_url('url')} as event_url from pages),
i as (select publisher, regexp_extract(event_url, '^([a-z]+://[^/]*/[a-z]*)', 1) as section, length(event_url)::varchar as raw_date, page_id as place from p),
a as (select publisher, section, arg_min(raw_date, place) as raw_date, min(place) as place from i group by 1, 2 having count(distinct raw_date) = 1)
select page_id as candidate_id, raw_date, place from p join a on p.publisher = a.publisher and regexp_extract(p.event_url, '^([a-z]+://[^/]*/[a-z]*)', 1) = a.section""")
def j14(spark, root):
    event = urls.event_url("url")
    pages = load(spark, root, "pages").select(
        "page_id", urls.publisher("url").alias("publisher"), F.regexp_extract(event, "^([a-z]+://[^/]*/[a-z]*)", 1).alias("event_url"),
        F.length(event).cast("string").alias("raw_date"),
    )
    items = pages.select("publisher", "event_url", "raw_date", F.col("page_id").alias("place"))
    cands = pages.select(F.col("page_id").alias("candidate_id"), "publisher", "event_url")
    return joins.match_feed_items(items, cands).select("candidate_id", "raw_date", "place")


@query("j15_match_evidence", """
with p as (select l_suppkey as project, l_partkey as f, l_linenumber * 100 as a, l_linenumber * 100 + l_quantity::int as b, l_returnflag as sym from lineitem where l_linestatus = 'F'),
g as (select l_orderkey * 1000000 + l_partkey * 10 + l_linenumber as gid, l_suppkey as project, l_partkey as f, l_linenumber * 100 + 20 as a, l_linenumber * 100 + 30 as b, l_returnflag as sym from lineitem where l_linestatus = 'O')
select distinct gid as gold_id from g join p on g.project = p.project and g.f = p.f and ((p.sym = 'R' and g.sym = 'R') or (p.a <= g.b and p.b >= g.a))""")
def j15(spark, root):
    lines = load(spark, root, "lineitem")
    file = F.concat(F.lit("src/"), F.col("l_partkey").cast("string"), F.lit(".py"))
    symbol = F.when(F.col("l_returnflag") == "R", "R")
    pred = lines.where("l_linestatus = 'F'").select(
        F.col("l_suppkey").alias("project_id"), F.concat(F.lit("Repo\\"), file).alias("path"), (F.col("l_linenumber") * 100).alias("line_start"),
        (F.col("l_linenumber") * 100 + F.col("l_quantity").cast("int")).alias("line_end"), symbol.alias("symbol"),
    )
    gold = lines.where("l_linestatus = 'O'").select(
        (F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("gold_id"), F.col("l_suppkey").alias("project_id"),
        file.alias("path"), (F.col("l_linenumber") * 100 + 20).alias("line_start"), (F.col("l_linenumber") * 100 + 30).alias("line_end"), symbol.alias("symbol"),
    )
    return joins.match_evidence(pred, gold)


_EVAL = """
with c as (select doc_id, n_chars from documents),
e as (select doc_id, n_chars, toxic is not null as labelled, case when toxic = 1 then 'either' when quality = 1 then 'select' else 'reject' end as label,
      case when doc_id % 4 = 0 then 'holdout' else 'dev' end as split, case when n_chars > 800 then case when n_chars > 3000 then 'select' else 'reject' end end as decision
      from c left join labels using (doc_id))"""


@query("j16_evaluation_rows", _EVAL + """
select doc_id as candidate_id, case when not labelled then 'unlabelled' when split <> 'dev' then 'other_split' when label = 'either' then 'either' when decision is null then 'unreviewed' end as excluded from e""")
def j16(spark, root):
    return evaluation(spark, root).select("candidate_id", "excluded")


def evaluation(spark, root, split="dev"):
    docs = load(spark, root, "documents").select(F.col("doc_id").alias("candidate_id"), F.col("n_chars").alias("total"))
    labels = load(spark, root, "labels").select(
        F.col("doc_id").alias("candidate_id"),
        F.when(F.col("toxic") == 1, "either").when(F.col("quality") == 1, "select").otherwise("reject").alias("label"),
        F.when(F.col("doc_id") % 4 == 0, "holdout").otherwise("dev").alias("split"),
    )
    reviews = docs.where("total > 800").select("candidate_id", F.when(F.col("total") > 3000, "select").otherwise("reject").alias("decision"))
    return joins.evaluation_rows(docs, reviews, labels, split)


@query("j17_missing_dates", """
with d as (select unnest(generate_series(date '2023-12-25', date '2024-02-05', interval 1 day))::date as d)
select strftime(d, '%Y-%m-%d') as missing_date from d where d not in (select ts::date from events)""")
def j17(spark, root):
    runs = load(spark, root, "events").select(F.to_date("ts").alias("day"))
    found = joins.missing_dates(runs, "day", F.lit("2023-12-25").cast("date"), F.lit("2024-02-05").cast("date"))
    return found.select(F.col("missing_date").cast("string").alias("missing_date"))


@query("j18_merge_backfill", """
with f as (select o_orderkey as release_key, o_totalprice as v from orders where o_orderstatus <> 'O'), r as (select o_orderkey as release_key, -o_totalprice as v from orders where o_orderstatus <> 'F')
select release_key, v, true as from_feed from f union all select release_key, v, false from r where release_key not in (select release_key from f)""")
def j18(spark, root):
    orders = load(spark, root, "orders")
    side = lambda status, sign: orders.where(F.col("o_orderstatus") != status).select(F.col("o_orderkey").alias("release_key"), (F.col("o_totalprice") * sign).alias("v"))
    return joins.merge_backfill(side("O", 1), side("F", -1), ["release_key"])


@query("j19_backfill_until", """
with m as (select user_id, event_id, ts, sum(case when event_type = 'error' then 1 else 0 end) over (partition by user_id order by ts desc, event_id desc rows unbounded preceding) as s,
  sum(case when event_type = 'error' then 1 else 0 end) over (partition by user_id) as a from events)
select user_id, event_id, a > 0 as closed from m where s = 0""")
def j19(spark, root):
    pages = load(spark, root, "events").select("user_id", "event_id", "event_type", (-F.unix_micros("ts")).alias("newest"), (-F.col("event_id")).alias("tie"))
    return joins.backfill_until(pages, "user_id", ["newest", "tie"], F.col("event_type") == "error").select("user_id", "event_id", "closed")
