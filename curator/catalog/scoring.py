"""Queries of scoring (C), validation (V), the ledger (C6, C8) and text audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from curator import constants as K
from curator.catalog import sqltext as S
from curator.catalog.aggregates import members
from curator.catalog.registry import query
from curator.functions import spans, text
from curator.operators import aggregates, ledger, scoring, validation
from curator.policy import ScoreConfig, SelectionPolicy
from curator.plans.items import page_times
from curator.runtime import dealt, load, spread

_K = "cast(json_extract(props, '$.k') as bigint)"


def k():
    return F.get_json_object("props", "$.k").cast("long")


def _terms(column, terms):
    return "(" + " or ".join(f"contains({column}, '{t}')" for t in terms) + ")"


def _stories(config):
    c, w, p = config, config.weights, config.penalties
    part = lambda n, x: round(w[n] * x)  # noqa: E731  ties to even
    return f"""
with m as (select regexp_extract(url, '//([^/]*)/', 1) as host, regexp_extract(url, '^[a-z]+://[^/]*/([a-z]*)', 1) as lang, lpad(page_id::varchar, 12, '0') as id,
  {S.TITLE} as title, {S.normalize_url('url')} as url, starts_with(url, 'https:') as allowed, lower({S.collapse(S.unescape("regexp_replace(html, '<[^>]+>', ' ', 'g')"))}) as body, ts
  from pages left join (select event_id // 40 as page_id, arg_max(ts, (value, event_id)) as ts from events group by 1) using (page_id)),
c as (select *, lang || '-' || substr(id, 11, 1) as cluster_id, split_part(host, '.', 1) as p from m),
s as (select *, case when p = 'www' then 'aggregator' when p = 'blog' then 'primary_official' when p = 'm' then 'research' else 'community' end as cls from c),
k as (select *, (coalesce(list_position(['primary_official', 'open_source', 'research'], cls), 4), {S.normalize_title('title')}, url, id) as pk, cls in ('primary_official', 'research') and allowed as prim from s),
g as (select cluster_id, arg_min(title, pk) as t, bool_or({_terms('body', c.workflow_terms)}) as bw, bool_or({_terms('body', c.weak_terms)}) as bk, max(ts) as latest, count(distinct host) as n,
  case when bool_or(prim) then 'primary' when bool_and(cls = 'aggregator') then 'discovery_only'
   when count(distinct case when allowed and cls <> 'aggregator' then host end) >= 2 then 'multi_source' else 'insufficient' end as st from k group by 1),
w as (select *, {_terms('lower(t)', c.workflow_terms)} as tw, {_terms('lower(t)', c.weak_terms)} as tk, {_terms('lower(t)', c.noise_terms)} as tn,
  greatest(0, (epoch_us(timestamp '2024-01-31') - epoch_us(latest)) / 86400000000.0) as age from g),
p as (select cluster_id, case when bw or tw then {w['audience_value']} else {part('audience_value', 0.4)} end as audience_value, case st when 'primary' then {w['evidence']} when 'multi_source' then {part('evidence', 0.7)} when 'insufficient' then {part('evidence', 0.35)} else 0 end as evidence,
  least({w['novelty']}, 4 + 4 * n) as novelty, case when age is null then 0 when age <= 1 then {w['timeliness']} when age <= 3 then {part('timeliness', 0.75)} when age <= 7 then {part('timeliness', 0.4)} else 0 end as timeliness,
  case when bw or tw then {w['audience_fit']} else {part('audience_fit', 0.3)} end as audience_fit, case when st = 'primary' then {w['explainability']} else {part('explainability', 0.5)} end as explainability, case when st = 'discovery_only' then {part('production_cost_fit', 0.6)} else {w['production_cost_fit']} end as cost,
  case when st = 'discovery_only' then {p['discovery_only']} else 0 end as p1, case when bk or tk then {p['weak_evidence_language']} else 0 end as p2, case when tn and not tw then {p['non_workflow_noise']} else 0 end as p3 from w)"""


_C01 = """
select cluster_id, audience_value::bigint as audience_value, evidence::bigint as evidence, novelty::bigint as novelty, timeliness::bigint as timeliness, audience_fit::bigint as audience_fit,
 explainability::bigint as explainability, cost::bigint as production_cost_fit, (p1 + p2 + p3)::bigint as penalty,
 greatest(0, least(100, audience_value + evidence + novelty + timeliness + audience_fit + explainability + cost + p1 + p2 + p3))::bigint as total from p"""
_OTHER_RULES = [
    ("2", "weight", "audience_value", "", "15"), ("2", "weight", "evidence", "", "30"), ("2", "penalty", "discovery_only", "", "-35"),
    ("2", "penalty", "weak_evidence_language", "", "-5"), ("2", "workflow_term", "and", "", ""), ("2", "weak_term", "the", "", ""), ("2", "noise_term", "an", "", ""),
    ("2", "profile", "practical", "value", "1"), ("2", "profile", "practical", "usability", "6"), ("2", "profile", "practical", "interest", "3"),
    ("2", "profile", "news", "evidence", "7"), ("2", "profile", "news", "novelty", "3"), ("2", "profile", "play", "interest", "9"), ("2", "profile", "play", "value", "1"),
    ("2", "cap", "unsupported_promotion", "value", "6"), ("2", "cap", "unsupported_promotion", "evidence", "5"), ("2", "cap", "unclear_usage", "usability", "1"),
    ("2", "defer", "unclear_usage", "", ""), ("2", "threshold", "select_at", "", "70"), ("2", "threshold", "reject_below", "", "30"),
    ("2", "threshold", "confidence_floor", "", "0.9"), ("2", "threshold", "threshold_margin", "", "2"),
]
_OTHER_CONFIG = ScoreConfig(
    weights={**K.SCORE_WEIGHTS, "audience_value": 15, "evidence": 30}, penalties={**K.SCORE_PENALTIES, "discovery_only": -35, "weak_evidence_language": -5},
    workflow_terms=("and",), weak_terms=("the",), noise_terms=("an",))


def other_rules(spark):
    """Another version of all rules, as the table that a user would keep."""
    return spark.createDataFrame(_OTHER_RULES, "version string, section string, name string, item string, value string")


@query("c01_score_stories", _stories(ScoreConfig()) + _C01)
def c01(spark, root):
    return _c01(spark, root, ScoreConfig())


@query("c01_other_config", _stories(_OTHER_CONFIG) + _C01)
def c01_other(spark, root):
    return _c01(spark, root, ScoreConfig.from_table(other_rules(spark), "2"))


def _c01(spark, root, config):
    pages = load(spark, root, "pages").join(page_times(load(spark, root, "events")), "page_id", "left").select(
        F.lpad(F.col("page_id").cast("string"), 12, "0").alias("id"), text.plain_text("html").alias("summary"), F.col("ts").alias("published_at"),
        F.array().cast("array<string>").alias("categories"),
    )
    marked = pages.select("id", "published_at", *scoring.term_marks(config))
    stories = aggregates.stories_from_clusters(members(spark, root).join(marked, "id"), scoring.mark_aggregates())
    scored = scoring.score_stories(stories, F.lit("2024-01-31").cast("timestamp"), config=config)
    penalty = F.aggregate(F.map_values("penalties"), F.lit(0), lambda a, x: a + x)
    return scored.select(
        "cluster_id", *[F.col(f"components.{n}").cast("long").alias(n) for n in K.SCORE_WEIGHTS],
        penalty.cast("long").alias("penalty"), F.col("total").cast("long").alias("total"),
    )


def _orders(caps=(4, 3, 3), practical=(4, 1, 1, 3, 1), news=(3, 3, 3, 1, 0), play=(1, 2, 1, 2, 4)):
    """caps: of value, evidence and usability; the profiles' weights in the order of the dimensions."""
    total = lambda w, v, e, u: " + ".join(f"{x} * {n}" for x, n in zip((v, "n", e, u, "i"), w))
    by = lambda v, e, u: f"case profile when 'practical' then {total(practical, v, e, u)} when 'news' then {total(news, v, e, u)} else {total(play, v, e, u)} end"
    return f"""
with o as (select o_orderkey, case o_orderstatus when 'F' then 'practical' when 'O' then 'news' else 'play' end as profile, o_orderkey % 11 as v, o_custkey % 11 as n, (o_orderkey * 7) % 11 as e, (o_custkey * 3) % 11 as u, (o_orderkey + o_custkey) % 11 as i,
   o_orderpriority = '1-URGENT' as f1, o_custkey % 3 = 0 as f2, o_orderpriority = '5-LOW' as nul from orders),
c as (select *, case when f1 then least(v, {caps[0]}) else v end as v2, case when f1 then least(e, {caps[1]}) else e end as e2, case when f2 then least(u, {caps[2]}) else u end as u2 from o),
t as (select *, {by('v', 'e', 'u')} as raw, {by('v2', 'e2', 'u2')} as total from c)"""


_OTHER_ORDERS = dict(caps=(6, 5, 1), practical=(1, 0, 0, 6, 3), news=(0, 3, 7, 0, 0), play=(1, 0, 0, 0, 9))


def scored_orders(spark, root):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    flags = F.array_compact(F.array(F.when(F.col("o_orderpriority") == "1-URGENT", "unsupported_promotion"), F.when(cust % 3 == 0, "unclear_usage")))
    dims = {"value": key % 11, "novelty": cust % 11, "evidence": (key * 7) % 11, "usability": (cust * 3) % 11, "interest": (key + cust) % 11}
    return load(spark, root, "orders").select(
        "o_orderkey", "o_orderstatus", "o_custkey",
        F.when(F.col("o_orderstatus") == "F", "practical").when(F.col("o_orderstatus") == "O", "news").otherwise("play").alias("profile"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.struct(*[c.cast("int").alias(d) for d, c in dims.items()])).alias("scores"), flags.alias("flags"),
    )


def _c02_sql(caps):
    v, e, u = caps
    return f"""
select o_orderkey, case when not nul then raw end as raw_score, case when not nul then total end as total_score,
  case when nul then '' else concat_ws(' ', case when f1 and v > {v} then 'value:' || v || '>{v}' end, case when f1 and e > {e} then 'evidence:' || e || '>{e}' end, case when f2 and u > {u} then 'usability:' || u || '>{u}' end) end as caps from t"""


@query("c02_weighted_score", _orders() + _c02_sql((4, 3, 3)))
def c02(spark, root):
    return _c02(spark, root, SelectionPolicy())


@query("c02_other_policy", _orders(**_OTHER_ORDERS) + _c02_sql((6, 5, 1)))
def c02_other(spark, root):
    return _c02(spark, root, SelectionPolicy.from_table(other_rules(spark), "2"))


def _c02(spark, root, policy):
    scored = scoring.weighted_score(scored_orders(spark, root), policy)
    caps = F.transform("applied_caps", lambda c: F.concat(c["dimension"], F.lit(":"), c["from"].cast("string"), F.lit(">"), c["to"].cast("string")))
    return scored.select("o_orderkey", F.col("raw_score").cast("long").alias("raw_score"), F.col("total_score").cast("long").alias("total_score"), F.array_join(caps, " ").alias("caps"))


def _c03_sql(doubt, select_at, reject_below):
    return f"""
select o_orderkey, case when o_orderkey % 13 = 0 then 'reject' when o_orderkey % 17 = 0 or nul or o_orderkey % 19 = 0 or {doubt} then 'defer' when total >= {select_at} then 'select' when total < {reject_below} then 'reject' else 'defer' end as decision from t"""


@query("c03_decide", _orders() + _c03_sql("f1 or f2", 65, 45))
def c03(spark, root):
    return _c03(spark, root, SelectionPolicy())


@query("c03_other_policy", _orders(**_OTHER_ORDERS) + _c03_sql("f2", 70, 30))
def c03_other(spark, root):
    return _c03(spark, root, SelectionPolicy.from_table(other_rules(spark), "2"))


def _c03(spark, root, policy):
    scored = scoring.weighted_score(scored_orders(spark, root), policy)
    key = F.col("o_orderkey")
    precheck = F.when(key % 13 == 0, "BLOCK").when(key % 17 == 0, "UNKNOWN").otherwise("PASS")
    state = F.when(key % 19 == 0, "needs_evidence").otherwise("available")
    return scored.select("o_orderkey", scoring.decide(precheck, state, F.col("flags"), F.col("total_score"), policy).alias("decision"))


def _c04_sql(floor, margin, select_at, reject_below):
    return f"""
with e as (select vec_id, label, list_transform(embedding, lambda x: round(1 - abs(x::double), 6)) as c, (vec_id * 7) % 101 as score from embeddings)
select vec_id, concat_ws(',', case when label = 0 then 'unknown' end, case when list_bool_or(list_transform(c, lambda x: x < {floor})) then 'low_confidence' end,
  case when abs(score - {select_at}) <= {margin} or abs(score - {reject_below}) <= {margin} then 'near_threshold' end) as reasons from e"""


@query("c04_escalation", _c04_sql(0.8, 5, 65, 45))
def c04(spark, root):
    return _c04(spark, root, SelectionPolicy())


@query("c04_other_policy", _c04_sql(0.9, 2, 70, 30))
def c04_other(spark, root):
    return _c04(spark, root, SelectionPolicy.from_table(other_rules(spark), "2"))


def _c04(spark, root, policy):
    confidences = F.transform("embedding", lambda x: F.round(1 - F.abs(x.cast("double")), 6))
    why = scoring.escalation_reasons(F.when(F.col("label") == 0, "UNKNOWN").otherwise("PASS"), confidences, (F.col("vec_id") * 7) % 101, policy)
    return load(spark, root, "embeddings").select("vec_id", F.array_join(why, ",").alias("reasons"))


@query("c05_normalize_answers", f"""
with e as (select event_id, {_K} as k, event_type as t, value > 5 as ctx from events)
select event_id, case when k = 99 then null when not ctx then 'UNKNOWN' when t = 'error' then 'UNKNOWN' else 'PASS' end as precheck,
  case when k = 99 then 'value' end as error, case when k <> 99 and ctx and t <> 'error' then (k % 11)::bigint end as value_score, case when k <> 99 then (t = 'error')::int::bigint end as unknowns from e""")
def c05(spark, root):
    n = k()
    value = F.when(n == 99, "99").otherwise((n % 11).cast("string"))
    answers = F.create_map(
        F.lit("precheck"), F.lit("PASS"), F.lit("value"), value, F.lit("novelty"), F.when(F.col("event_type") == "error", "UNKNOWN").otherwise("3"),
        F.lit("evidence"), F.lit("4"), F.lit("usability"), F.lit("5"), F.lit("interest"), F.lit("6"),
    )
    out = scoring.normalize_answers(answers, F.col("value") > 5)
    return load(spark, root, "events").select("event_id", out.alias("o")).select(
        "event_id", "o.precheck", "o.error", F.col("o.scores.value").cast("long").alias("value_score"),
        F.when(F.col("o.unknown_dimensions").isNotNull(), F.size("o.unknown_dimensions")).cast("long").alias("unknowns"),
    )


@query("c05_unwrap_answers", f"""
select event_id, case event_type when 'purchase' then null else {_K}::varchar end as value,
  case event_type when 'click' then 'answer_object' when 'view' then 'per_question_answer' when 'error' then 'answer_object' else '' end as note from events""")
def c05u(spark, root):
    n = k().cast("string")
    plain = F.to_json(F.struct(n.alias("value"), F.lit("PASS").alias("precheck")))
    reply = (
        F.when(F.col("event_type") == "click", F.concat(F.lit('{"answer":'), plain, F.lit("}")))
        .when(F.col("event_type") == "view", F.to_json(F.struct(F.struct(n.alias("answer")).alias("value"), F.struct(F.lit("PASS").alias("answer")).alias("precheck"))))
        .when(F.col("event_type") == "error", F.to_json(F.struct(plain.alias("answer"))))
        .when(F.col("event_type") == "purchase", F.to_json(F.struct(n.alias("value"))))
        .otherwise(plain)
    )
    out = scoring.unwrap_answers(reply, ("value", "precheck"))
    return load(spark, root, "events").select("event_id", out.alias("o")).select("event_id", F.try_element_at("o.answers", F.lit("value")).alias("value"), "o.note")


_DUE = """
with i as (select distinct 'daily' as t, strftime(o_orderdate, '%Y-%m-%d') as p from orders where o_orderstatus = 'F' union select distinct 'monthly', strftime(o_orderdate, '%Y-%m') from orders where o_orderstatus = 'O'),
d as (select 'monthly' as t, strftime(o_orderdate, '%Y-%m') as p, count(*) as n from orders where o_orderstatus = 'P' group by 2)"""


def issues_and_drafts(spark, root):
    orders = load(spark, root, "orders")
    daily = orders.where("o_orderstatus = 'F'").select(F.lit("daily").alias("ranking_type"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("period"))
    monthly = orders.where("o_orderstatus = 'O'").select(F.lit("monthly").alias("ranking_type"), F.date_format("o_orderdate", "yyyy-MM").alias("period"))
    drafts = orders.where("o_orderstatus = 'P'").groupBy(F.lit("monthly").alias("ranking_type"), F.date_format("o_orderdate", "yyyy-MM").alias("period")).agg(F.count(F.lit(1)).alias("item_count"))
    return daily.unionByName(monthly), drafts


@query("c06_due_periods", _DUE + """
, c as (select * from (values ('daily', '1998-05-31', '1998-05-31', '1998-05-31', epoch(timestamp '1998-06-01 01:00:00')), ('weekly', '1998-05-25', '1998-05-25', '1998-05-31', epoch(timestamp '1998-06-01 02:00:00')), ('monthly', '1998-05', '1998-05-01', '1998-05-31', epoch(timestamp '1998-06-01 03:00:00'))) v(t, p, s, e, due_us)),
f as (select c.*, (c.t, c.p) in (select (t, p) from i) as archived, (c.t, c.p) in (select (t, p) from d) as has_draft from c)
select t as ranking_type, p as period, s as start_date, e as end_date, due_us::bigint as due_s, archived, has_draft, due_us <= epoch(timestamp '1998-06-01 02:30:00') and not archived as due from f""")
def c06(spark, root):
    due = ledger.due_periods(F.lit("1998-06-01 02:30:00").cast("timestamp"), *issues_and_drafts(spark, root))
    return due.select(
        "ranking_type", "period", F.col("start_date").cast("string").alias("start_date"), F.col("end_date").cast("string").alias("end_date"),
        F.unix_seconds("due_at").alias("due_s"), "archived", "has_draft", "due",
    )


@query("c06_dispatch", _DUE + """
select 'collect' as action, null as ranking_type, '1998-06-01' as period, null::bigint as shortfall
union all select * from (select 'backfill_monthly', 'monthly', p, greatest(0, 20 - n)::bigint from d where p < '1998-06' order by p limit 1)""")
def c06d(spark, root):
    return ledger.dispatch(F.lit("1998-06-01 11:15:00").cast("timestamp"), *issues_and_drafts(spark, root))


def _verdict(c, h):
    return f"""case when {c}.reported_url in (select event_url from {h} where event_url is not null) then '{scoring.CROSS_URL}'
  when not exists (select 1 from {h} x where x.canonical_url = {c}.canonical_url) then null
  when {c}.kind not in ('update', 'news') or {c}.event_url is null then '{scoring.ALREADY}'
  else (select arg_min(r, seq) from (select seq, case when x.event_id = {c}.event_id or x.event_url = {c}.event_url then '{scoring.SAME_EVENT}'
     when coalesce(case when x.event_url is not null then x.latest else x.verified_at end >= {c}.earliest, false) then '{scoring.NOT_NEWER}'
     when x.event_url is null and list_contains(x.evidence, {c}.event_url) then '{scoring.EVIDENCE_USED}' end as r from {h} x where x.canonical_url = {c}.canonical_url) where r is not null) end"""


@query("c07_dedup_verdict", f"""
with h as (select o_custkey as canonical_url, o_orderkey as seq, 'i' || o_orderkey % 50 as event_id, case when o_orderstatus = 'F' then 'e' || o_orderkey % 400 end as event_url, o_orderdate as latest, o_orderdate as verified_at,
   ['e' || o_orderkey % 90, 'e' || o_orderkey % 91] as evidence from orders where o_orderdate < timestamp '1997-01-01'),
c as (select o_orderkey, o_custkey as canonical_url, case o_orderpriority when '1-URGENT' then 'project' when '2-HIGH' then 'news' else 'update' end as kind, 'i' || o_custkey % 60 as event_id,
  case when o_orderpriority <> '1-URGENT' then 'e' || o_custkey % 1000 end as event_url, coalesce(case when o_orderpriority <> '1-URGENT' then 'e' || o_custkey % 1000 end, case when o_orderpriority = '2-HIGH' then 'p' end) as reported_url,
  o_orderdate - interval 400 day as earliest from orders where o_orderdate >= timestamp '1997-01-01')
select o_orderkey, {_verdict('c', 'h')} as selection_block from c""")
def c07(spark, root):
    orders = load(spark, root, "orders")
    tag = lambda prefix, c, n: F.concat(F.lit(prefix), (F.col(c) % n).cast("string"))
    history = orders.where("o_orderdate < timestamp'1997-01-01'").select(
        F.col("o_custkey").alias("canonical_url"), F.col("o_orderkey").alias("h_seq"), tag("i", "o_orderkey", 50).alias("h_event_id"),
        F.when(F.col("o_orderstatus") == "F", tag("e", "o_orderkey", 400)).alias("h_event_url"), F.col("o_orderdate").alias("h_latest"),
        F.col("o_orderdate").alias("h_verified_at"), F.array(tag("e", "o_orderkey", 90), tag("e", "o_orderkey", 91)).alias("h_evidence"),
    )
    urgent = F.col("o_orderpriority") == "1-URGENT"
    event = F.when(~urgent, tag("e", "o_custkey", 1000))
    candidates = orders.where("o_orderdate >= timestamp'1997-01-01'").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("canonical_url"),
        F.when(urgent, "project").when(F.col("o_orderpriority") == "2-HIGH", "news").otherwise("update").alias("kind"), tag("i", "o_custkey", 60).alias("event_id"),
        event.alias("event_url"), F.coalesce(event, F.when(F.col("o_orderpriority") == "2-HIGH", "p")).alias("reported_url"), (F.col("o_orderdate") - F.expr("INTERVAL 400 DAYS")).alias("earliest"),
    )
    return scoring.dedup_verdict(candidates, history).select(F.col("row_id").alias("o_orderkey"), "selection_block")


_C8 = f"""
with e as (select event_id as obs_id, user_id::varchar as canonical_url, case event_type when 'purchase' then 'update' when 'error' then 'news' else 'project' end as kind, case when value > 8 then 'verified' else 'discovered' end as st,
   ts as discovered_at, case when value > 8 then ts + interval 1 hour end as verified_at, ts + interval 2 hour as collected_at, {_K} as k, value, 'p' || user_id as page_url from events),
f as (select *, kind = 'update' or (kind = 'news' and value > 4) as ev from e),
o as (select *, case when ev then case when kind = 'news' and k % 3 = 0 then page_url else 'e' || k end end as event_url, case when ev then 'i' || k end as event_id,
   case when ev and not (kind = 'news' and k % 5 = 0) then discovered_at - interval 1 day end as occ_at, case when ev and kind = 'news' and k % 5 = 0 then discovered_at::date end as occ_on from f),
p as (select *, case when k % 2 = 0 and event_url is not null then [event_url] else ['x'] end as evidence, date '2024-01-08' as s, date '2024-01-14' as e,
   coalesce(occ_at, occ_on::timestamp - interval 14 hour) as low, coalesce(occ_at, occ_on::timestamp + interval 36 hour - interval 1 microsecond) as high from o),
vn as (select canonical_url, event_url as page_url, arg_max((st, low, high, event_url, evidence), (collected_at, obs_id)) as v from p where kind = 'news' and st = 'verified' and event_url is not null group by 1, 2),
fd as (select canonical_url, min(discovered_at) as first, max(collected_at) as last from p group by 1),
j as (select p.*, first, last, v, kind = 'news' and p.event_url is null and v is not null as follows from p join fd using (canonical_url) left join vn on p.canonical_url = vn.canonical_url and p.page_url = vn.page_url),
x as (select *, case when follows then v[1] else st end as xst, case when follows then v[2] else low end as xlow, case when follows then v[3] else high end as xhigh, case when follows then v[4] else event_url end as xurl, case when follows then v[5] else evidence end as xev from j),
y as (select *, xlow >= s::timestamp - interval 8 hour and xhigh < e::timestamp + interval 16 hour as inside, (xlow + interval 8 hour)::date as begins, (first + interval 8 hour)::date <= e as in_time from x),
z as (select *, coalesce(case when kind = 'news' and xurl is null then xst = 'discovered' when kind = 'news' and not inside then false when xurl is not null and begins > e then false
    else in_time or (xurl is not null and inside and list_contains(xev, xurl)) end, false) as ok from y),
g as (select *, coalesce(event_url, case when kind = 'news' then page_url end, '') as event_key from z where ok),
eff as (select *, case when st = 'verified' then verified_at end as lastv, coalesce(event_url, case when kind = 'news' then page_url end) as reported_url, low as earliest from g
   qualify row_number() over (partition by canonical_url, kind, event_key order by (st = 'verified') desc, case when st = 'verified' then verified_at else collected_at end desc, collected_at desc, obs_id desc) = 1),
h as (select o_custkey::varchar as canonical_url, o_orderkey as seq, 'i' || o_orderkey % 100 as event_id, case when o_orderstatus = 'F' then 'e' || o_orderkey % 30 end as event_url,
   timestamp '2023-12-20' + to_days((o_orderkey % 20)::int) as latest, timestamp '2023-12-20' + to_days((o_orderkey % 20)::int) as verified_at, ['e' || o_orderkey % 90] as evidence from orders where o_orderpriority = '1-URGENT'),
d as (select eff.*, {_verdict('eff', 'h')} as block from eff),
ss as (select *, case when block is not null then 'blocked' when lastv is not null then 'available' else 'needs_evidence' end as status from d)"""


def ledger_tables(spark, root):
    """Events as observations, urgent orders as publication history."""
    n, user = k(), F.col("user_id").cast("string")
    kind = F.when(F.col("event_type") == "purchase", "update").when(F.col("event_type") == "error", "news").otherwise("project")
    base = load(spark, root, "events").select(
        F.col("event_id").alias("obs_id"), user.alias("canonical_url"), kind.alias("kind"), F.when(F.col("value") > 8, "verified").otherwise("discovered").alias("evidence_status"),
        F.col("ts").alias("discovered_at"), F.when(F.col("value") > 8, F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("verified_at"), (F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("collected_at"),
        n.alias("k"), F.concat(F.lit("p"), user).alias("page_url"), ((kind == "update") | ((kind == "news") & (F.col("value") > 4))).alias("ev"),
    )
    news = F.col("kind") == "news"
    url = F.when(F.col("ev"), F.when(news & (F.col("k") % 3 == 0), F.col("page_url")).otherwise(F.concat(F.lit("e"), F.col("k").cast("string"))))
    dated = news & (F.col("k") % 5 == 0)
    obs = base.withColumn("event_url", url).withColumns({
        "event_id": F.when(F.col("ev"), F.concat(F.lit("i"), F.col("k").cast("string"))),
        "occurred_at": F.when(F.col("ev") & ~dated, F.col("discovered_at") - F.expr("INTERVAL 1 DAY")),
        "occurred_on": F.when(F.col("ev") & dated, F.to_date("discovered_at")),
        "evidence": F.when((F.col("k") % 2 == 0) & F.col("event_url").isNotNull(), F.array("event_url")).otherwise(F.array(F.lit("x"))),
    }).drop("k", "ev")
    tag = lambda p, m: F.concat(F.lit(p), (F.col("o_orderkey") % m).cast("string"))
    at = F.timestamp_seconds(F.unix_seconds(F.lit("2023-12-20").cast("timestamp")) + (F.col("o_orderkey") % 20) * 86400)
    history = load(spark, root, "orders").where("o_orderpriority = '1-URGENT'").select(
        F.col("o_custkey").cast("string").alias("canonical_url"), F.col("o_orderkey").alias("h_seq"), tag("i", 100).alias("h_event_id"),
        F.when(F.col("o_orderstatus") == "F", tag("e", 30)).alias("h_event_url"), at.alias("h_latest"), at.alias("h_verified_at"), F.array(tag("e", 90)).alias("h_evidence"),
    )
    return obs, history


_BEST = """qualify row_number() over (partition by canonical_url order by case status when 'available' then 2 when 'needs_evidence' then 1 else 0 end desc, coalesce(low, discovered_at) desc, coalesce(lastv, collected_at) desc, kind desc, event_key desc) = 1"""


def _best_candidates(spark, root):
    return ledger.candidate_query(*ledger_tables(spark, root), "weekly", "2024-01-08")[0]


@query("c08_page", _C8 + f""", b as (select * from ss {_BEST}), l as (select *, row_number() over (order by canonical_url) as position, count(*) over () as total from b where status <> 'blocked')
select canonical_url, kind, event_key, position::bigint as position, total::bigint as total, case when total > 30 then 30::bigint end as next_offset, total > 30 as truncated from l where position > 10 and position <= 30""")
def c08p(spark, root):
    shown = ledger.candidate_page(_best_candidates(spark, root), 20, 10)
    return shown.select("canonical_url", "kind", "event_key", "position", "total", "next_offset", "truncated")


@query("c08_blocked", _C8 + f""", b as (select * from ss {_BEST})
select canonical_url, kind, event_key, status as selection_status, block as selection_block from b where status = 'blocked'""")
def c08b(spark, root):
    return ledger.blocked_candidates(_best_candidates(spark, root))


@query("c08_counts", _C8 + f""", b as (select * from ss {_BEST})
select count(*)::bigint as total, count(*) filter (where status <> 'blocked')::bigint as eligible, count(*) filter (where status = 'available')::bigint as available,
  count(*) filter (where status = 'needs_evidence')::bigint as needs_evidence, count(*) filter (where status = 'blocked')::bigint as blocked from b""")
def c08n(spark, root):
    return ledger.candidate_counts(_best_candidates(spark, root))


@query("c08_source_urls", _C8 + f""", b as (select * from ss {_BEST})
select distinct canonical_url, u as source_url from (select canonical_url, unnest(['s' || k % 7, page_url]) as u from p) where canonical_url in (select canonical_url from b)""")
def c08u(spark, root):
    obs, history = ledger_tables(spark, root)
    numbers = load(spark, root, "events").select(F.col("event_id").alias("obs_id"), (k() % 7).cast("string").alias("n"))
    sourced = obs.join(numbers, "obs_id").withColumn("source_urls", F.array(F.concat(F.lit("s"), "n"), "page_url"))
    best, _ = ledger.candidate_query(obs, history, "weekly", "2024-01-08")
    return ledger.candidate_sources(best, sourced)


@query("c08_window", _C8.split("vn as")[0] + """cd as (select *, (collected_at + interval 8 hour)::date as day from p),
act as (select distinct canonical_url from cd where day between date '2024-01-10' and date '2024-01-12'),
g as (select *, coalesce(event_url, case when kind = 'news' then page_url end, '') as event_key from cd where canonical_url in (select canonical_url from act) and day <= date '2024-01-12'),
eff as (select *, case when st = 'verified' then verified_at end as lastv, low as earliest from g
   qualify row_number() over (partition by canonical_url, kind, event_key order by (st = 'verified') desc, case when st = 'verified' then verified_at else collected_at end desc, collected_at desc, obs_id desc) = 1)
select canonical_url, kind, event_key, obs_id, case when lastv is not null then 'available' else 'needs_evidence' end as selection_status from eff""")
def c08w(spark, root):
    obs, _ = ledger_tables(spark, root)
    _, events = ledger.window_candidates(obs, F.lit("2024-01-10").cast("date"), F.lit("2024-01-12").cast("date"))
    return events.select("canonical_url", "kind", "event_key", "obs_id", "selection_status")


@query("c08_candidate_events", _C8 + """
select canonical_url, kind, event_key, obs_id, status as selection_status, block as selection_block from ss""")
def c08e(spark, root):
    _, events = ledger.candidate_query(*ledger_tables(spark, root), "weekly", "2024-01-08")
    return events.select("canonical_url", "kind", "event_key", "obs_id", "selection_status", "selection_block")


@query("c08_candidates", _C8 + """
select canonical_url, kind, event_key, status as selection_status, epoch_us(first)::bigint as first_us, epoch_us(last)::bigint as last_us,
  case when (first + interval 8 hour)::date < date '2024-01-08' then '往期候选' when (first + interval 8 hour)::date > date '2024-01-14' then '原期事件补采' else '新发现' end as period_label
from ss qualify row_number() over (partition by canonical_url order by case status when 'available' then 2 when 'needs_evidence' then 1 else 0 end desc, coalesce(low, discovered_at) desc, coalesce(lastv, collected_at) desc, kind desc, event_key desc) = 1""")
def c08(spark, root):
    best, _ = ledger.candidate_query(*ledger_tables(spark, root), "weekly", "2024-01-08")
    return best.select(
        "canonical_url", "kind", "event_key", "selection_status", F.unix_micros("first_discovered_at").alias("first_us"),
        F.unix_micros("last_collected_at").alias("last_us"), "period_label",
    )


@query("v01_row_rules", """
with r as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity as q, l_extendedprice, l_discount as d, l_returnflag as f, l_linestatus as s, l_shipdate, o_orderdate from lineitem join orders on l_orderkey = o_orderkey)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, 'l_quantity' as path, 'range' as code from r where q not between 2 and 48
union all select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, 'l_returnflag', 'enum' from r where f not in ('A', 'N')
union all select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, 'l_linestatus', 'pattern' from r where not regexp_matches(s, '^[A-M]$')
union all select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, 'l_shipdate', 'order' from r where l_shipdate < o_orderdate + interval 5 day""")
def v01(spark, root):
    lines, orders = load(spark, root, "lineitem"), load(spark, root, "orders")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    rules = [
        validation.in_range("l_quantity", 2, 48), validation.one_of("l_returnflag", ("A", "N")), validation.matches("l_linestatus", "^[A-M]$"),
        validation.cross("l_shipdate", "order", F.col("l_shipdate") < F.col("o_orderdate") + F.expr("INTERVAL 5 DAYS"), "shipped before it was ready"),
        validation.required("l_orderkey"),
    ]
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return validation.validate(joined, key, rules).drop("message")


@query("v01_candidate_contract", f"""
with c as (select event_id, event_type, value, user_id, {_K} as k from events)
select event_id, 'source_urls' as path, 'url' as code from c where k % 7 = 0
union all select event_id, 'category', 'enum' from c where k % 11 = 0
union all select event_id, 'evidence_urls', 'required' from c where value > 8 and event_type <> 'purchase' and k % 5 = 0
union all select event_id, 'verified_at', 'unverified' from c where value <= 8 and k % 13 = 0
union all select event_id, 'event', 'required' from c where value > 8 and event_type = 'error'
union all select event_id, 'discovered_at', 'order' from c where k = 50
union all select event_id, 'verified_at', 'order' from c where k = 50 and value > 8""")
def v01c(spark, root):
    n, verified = k(), F.col("value") > 8
    page = F.concat(F.lit("https://example.org/"), F.col("user_id").cast("string"))
    purchase = F.col("event_type") == "purchase"
    later = F.when(n == 50, F.expr("INTERVAL 3 HOURS")).otherwise(F.expr("INTERVAL 0 HOURS"))
    # The files are few for what the rules cost per row.
    cards = spread(load(spark, root, "events").select("event_id", "event_type", "user_id", "value", "ts", "props")).select(
        "event_id", page.alias("url"), F.lit("t").alias("title"), F.lit("s").alias("summary"), F.lit("r").alias("reason"),
        F.when(n % 11 == 0, "other").otherwise("Skills").alias("category"),
        F.when(purchase, "update").when(F.col("event_type") == "error", "news").otherwise("project").alias("kind"),
        F.when(verified, "verified").otherwise("discovered").alias("evidence_status"), F.array(F.when(n % 7 == 0, "ftp://x").otherwise(page)).alias("source_urls"),
        F.when(purchase | (n % 5 != 0), F.array(page)).otherwise(F.array().cast("array<string>")).alias("evidence_urls"),
        (F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("collected_at"), (F.col("ts") + later).alias("discovered_at"),
        F.when(verified | (n % 13 == 0), F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("verified_at"), F.lit("documented").alias("verification_level"),
        F.when(purchase, page).alias("event_url"),
    )
    return validation.validate_candidates(cards, ["event_id"]).drop("message")


_ISSUES = """
with i as (select o_orderkey as issue_id, case when o_orderpriority = '1-URGENT' then 'weekly' else 'daily' end as t, o_orderstatus = 'F' as explained from orders),
l as (select l_orderkey as issue_id, l_linenumber <= 2 as featured, l_returnflag = 'R' as reading, l_partkey, l_suppkey from lineitem),
c as (select issue_id, count(*) as n, count(*) filter (where featured) as f, count(*) filter (where not reading) as nr, count(*) filter (where featured and reading) as fr from l group by 1),
w as (select i.*, coalesce(n, 0) as n, coalesce(f, 0) as f, coalesce(nr, 0) as nr, coalesce(fr, 0) as fr, least(3, coalesce(nr, 0)) as q from i left join c using (issue_id))"""


@query("v02_group_rules", _ISSUES + """
select issue_id, 'too_many' as code from w where n > case t when 'weekly' then 25 else 8 end
union all select issue_id, 'shortfall_unexplained' from w where n < case t when 'weekly' then 20 else 5 end and not explained
union all select issue_id, 'featured_reading' from w where fr > 0
union all select issue_id, 'featured_quota' from w where case when t = 'weekly' then f <> q else f not between least(1, nr) and q end
union all select issue_id, 'identity_repeated' from (select distinct issue_id from (select issue_id, l_partkey from l group by 1, 2 having count(*) > 1))
union all select issue_id, 'event_repeated' from (select distinct issue_id from (select issue_id, l_suppkey from l group by 1, 2 having count(*) > 1))""")
def v02(spark, root):
    issues = load(spark, root, "orders").select(
        F.col("o_orderkey").alias("issue_id"), F.when(F.col("o_orderpriority") == "1-URGENT", "weekly").otherwise("daily").alias("ranking_type"),
        F.when(F.col("o_orderstatus") == "F", "few").otherwise("").alias("shortfall_reason"),
    )
    items = load(spark, root, "lineitem").select(
        F.col("l_orderkey").alias("issue_id"), (F.col("l_linenumber") <= 2).alias("featured"), F.when(F.col("l_returnflag") == "R", "reading").otherwise("project").alias("kind"),
        F.col("l_partkey").alias("canonical_url"), F.col("l_suppkey").alias("event_url"),
    )
    items, issues = dealt("issue_id", items, issues)
    return validation.validate_issues(items, issues).select("issue_id", "code")


@query("v03_decisions", """
with q as (select o_orderkey, o_orderstatus as s, o_orderpriority as p, o_custkey from orders),
d as (select * from q where p <> '5-LOW')
select o_orderkey as release_key, 'key_missing' as code from q where p = '5-LOW'
union all select o_orderkey, 'enum' from d where s = 'P'
union all select o_orderkey, 'accept_shape' from d where s = 'F' and p = '2-HIGH'
union all select o_orderkey, 'reject_shape' from d where s = 'O' and p <> '2-HIGH'
union all select o_orderkey, 'evidence_not_in_notes' from d where p <> '2-HIGH' and o_custkey % 2 = 1""")
def v03(spark, root):
    orders, = dealt("o_orderkey", load(spark, root, "orders"))
    name = F.concat(F.lit("change "), F.col("o_custkey").cast("string"))
    queue = orders.select(F.col("o_orderkey").alias("release_key"), F.concat(F.lit("Notes:  "), name, F.lit("  done &amp; shipped")).alias("notes"))
    evidence = F.when(F.col("o_custkey") % 2 == 1, F.concat(name, F.lit(" undone"))).otherwise(F.concat(name, F.lit(" done & shipped")))
    empty = F.array().cast("array<struct<summary:string,evidence:string>>")
    with_changes = F.col("o_orderpriority") != "2-HIGH"
    decisions = orders.where("o_orderpriority <> '5-LOW'").select(
        F.col("o_orderkey").alias("release_key"), F.when(F.col("o_orderstatus") == "F", "accept").when(F.col("o_orderstatus") == "O", "reject").otherwise("maybe").alias("decision"),
        F.when(with_changes, F.array(F.lit("feature"))).otherwise(F.array().cast("array<string>")).alias("change_types"),
        F.when(with_changes, F.array(F.struct(F.lit("s").alias("summary"), evidence.alias("evidence")))).otherwise(empty).alias("changes"), F.lit("because").alias("decision_reason"),
    )
    return validation.validate_decisions(decisions, queue).select("release_key", "code")


@query("v04_assessments", """
with o as (select o_orderkey, o_orderstatus = 'P' as a, o_custkey % 5 = 0 as b, o_custkey % 7 = 0 as c, o_orderpriority = '1-URGENT' as d, o_orderpriority = '2-HIGH' as e, o_custkey % 3 = 0 as f from orders)
select o_orderkey as candidate_id, 'pass_without_scores' as code from o where a
union all select o_orderkey, 'range' from o where b and not a
union all select o_orderkey, 'foreign_ref' from o where c and not a
union all select o_orderkey, 'kind' from o where d
union all select o_orderkey, 'basis_quote' from o where e and f""")
def v04(spark, root):
    a, b, c = F.col("o_orderstatus") == "P", F.col("o_custkey") % 5 == 0, F.col("o_custkey") % 7 == 0
    d, e, f = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority") == "2-HIGH", F.col("o_custkey") % 3 == 0
    url = F.lit("https://example.org/a")
    score = lambda name: F.struct(
        F.lit(name).alias("dimension"), F.when(b & F.lit(name == "value"), 11).otherwise(5).alias("score"), F.lit("why").alias("reason"),
        F.when(c & F.lit(name == "novelty"), F.array(F.lit("https://example.org/other"))).otherwise(F.array(url)).alias("refs"),
    )
    flag = lambda code, basis, quote: F.struct(
        F.lit(code).alias("code"), F.lit("why").alias("reason"), F.array(url).alias("refs"), F.lit(basis).alias("basis_kind"), quote.alias("basis_quote"), url.alias("basis_url"), F.lit(None).cast("string").alias("gap")
    )
    cards = load(spark, root, "orders").select(
        F.col("o_orderkey").alias("candidate_id"), F.lit("project").alias("kind"), F.lit("daily").alias("ranking_type"), F.array(url).alias("allowed_urls"), F.lit("PASS").alias("precheck"),
        F.array(url).alias("precheck_refs"), F.when(~a, F.array(*[score(n) for n in K.DIMENSIONS])).alias("scores"),
        F.array_compact(F.array(
            F.when(d, flag("routine_update", "limited_increment", F.lit("text"))), F.when(e, flag("unclear_usage", "usage_path_gap", F.when(f, "absent").otherwise("whole text")))
        )).alias("flags"), F.create_map(url, F.lit("the whole text here")).alias("texts"), F.lit("overall").alias("reason"),
    )
    return validation.validate_assessments(cards).select("candidate_id", "code")


@query("v05_statement_checks", """
with u as (select conv_id, count(*) as n, bool_or(role = 'system' and not (conv_id % 6 = 0 and turn = 0)) as sys, conv_id % 4 = 0 as odd, conv_id % 6 = 0 as six from conversations group by 1)
select conv_id as unit_id, 'contradiction' as code from u where odd <> sys
union all select conv_id, 'statement_unchecked' from u where six
union all select conv_id, 'required' from conversations where role = 'assistant' and turn % 3 = 0 and not (conv_id % 6 = 0 and turn = 0)""")
def v05(spark, root):
    talk = load(spark, root, "conversations")
    units = talk.select(F.col("conv_id").alias("unit_id")).distinct().select(
        "unit_id", F.when(F.col("unit_id") % 4 == 0, "defer").otherwise("accept").alias("verdict"), F.array(F.lit("p1")).alias("passage_ids")
    )
    statements = talk.select(F.col("conv_id").alias("unit_id"), F.concat(F.lit("s"), F.col("turn").cast("string")).alias("statement_id"))
    # The first statement of every sixth unit goes unchecked.
    checks = talk.where("not (conv_id % 6 = 0 and turn = 0)").select(
        F.col("conv_id").alias("unit_id"), F.concat(F.lit("s"), F.col("turn").cast("string")).alias("statement_id"),
        F.when(F.col("role") == "system", "not_supported").when(F.col("role") == "assistant", "supported").otherwise("editorial_judgment").alias("status"),
        F.when(F.col("turn") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("p1"))).alias("passage_ids"),
    )
    return validation.validate_checks(units, statements, checks).select("unit_id", "code")


@query("v06_source_scopes", """
with d as (select doc_id, length(text) as n, text from documents)
select doc_id, case doc_id % 5 when 0 then '' when 1 then 'ranges_disordered' when 2 then 'complete_has_gap' when 3 then 'complete_hash_differs' else 'excerpt_without_ranges' end as codes from d""")
def v06(spark, root):
    n, m = F.length("text"), F.col("doc_id") % 5
    span = lambda a, b: F.struct(F.lit(a).cast("int").alias("start"), b.cast("int").alias("end"))
    ranges = (
        F.when(m == 1, F.array(span(0, n - 1), F.struct((n - 2).cast("int").alias("start"), (n - 1).cast("int").alias("end"))))
        .when(m == 2, F.array(span(0, n - 1))).when(m == 4, F.array().cast("array<struct<start:int,end:int>>")).otherwise(F.array(span(0, n)))
    )
    broken = spans.scope_violations(
        F.when(m.isin(1, 4), "excerpt").otherwise("complete_text"), n, n, ranges,
        F.when(m == 3, F.sha2(F.concat("text", F.lit(" ")), 256)).otherwise(F.sha2("text", 256)), F.col("text"),
    )
    return load(spark, root, "documents").select("doc_id", F.array_join(broken, ",").alias("codes"))


@query("v07_bindings", """
select doc_id, 'unbound' as code from documents where doc_id not in (select doc_id from labels)
union all select doc_id, 'changed' from documents join labels using (doc_id) where quality = 0""")
def v07(spark, root):
    docs = load(spark, root, "documents")
    now = docs.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.lit("c1").alias("commit_sha"))
    frozen = docs.join(load(spark, root, "labels"), "doc_id").select(
        "doc_id", F.sha2(F.when(F.col("quality") == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("text_sha256"), F.lit("c1").alias("commit_sha")
    )
    return validation.validate_bindings(now, frozen, ["doc_id"], ["text_sha256", "commit_sha"]).select("doc_id", "code")


@query("v08_lifecycle", f"""
with l as (select user_id * 100 + {_K} as run_id, case event_type when 'click' then 'approved' when 'view' then 'result' when 'purchase' then 'confirmed' end as event, ts, event_id % 2 as b, event_id % 3 as c, 'h' || event_id % 4 as rh from events where event_type in ('click', 'view', 'purchase')),
r as (select run_id, count(*) filter (where event = 'approved') as na, count(*) filter (where event = 'result') as nr, count(*) filter (where event = 'confirmed') as nc,
  max(b) filter (where event = 'approved') as ab, min(b) filter (where event = 'result') as rb1, max(b) filter (where event = 'result') as rb2, max(c) filter (where event = 'approved') as ac, min(c) filter (where event = 'result') as rc1, max(c) filter (where event = 'result') as rc2,
  max(ts) filter (where event = 'approved') as apt, min(ts) filter (where event = 'result') as rt, min(rh) filter (where event = 'result') as rh1, max(rh) filter (where event = 'result') as rh2, min(rh) filter (where event = 'confirmed') as ch1, max(rh) filter (where event = 'confirmed') as ch2 from l group by 1)
select run_id, 'approval_count' as code from r where nr > 0 and na <> 1
union all select run_id, 'binding' from r where nr > 0 and na = 1 and (rb1 <> ab or rb2 <> ab)
union all select run_id, 'order' from r where nr > 0 and na = 1 and rt < apt
union all select run_id, 'criteria' from r where nr > 0 and na = 1 and (rc1 <> ac or rc2 <> ac)
union all select run_id, 'conflict' from r where nr > 0 and rh1 <> rh2
union all select run_id, 'result_count' from r where nc > 0 and (nr = 0 or rh1 <> rh2)
union all select run_id, 'conflict' from r where nc > 0 and nr > 0 and (ch1 <> rh1 or ch2 <> rh1)""")
def v08(spark, root):
    log = load(spark, root, "events").where("event_type in ('click', 'view', 'purchase')").select(
        (F.col("user_id") * 100 + k()).alias("run_id"), F.when(F.col("event_type") == "click", "approved").when(F.col("event_type") == "view", "result").otherwise("confirmed").alias("event"),
        F.col("ts").alias("at"), (F.col("event_id") % 2).alias("binding"), (F.col("event_id") % 3).alias("criteria"), F.concat(F.lit("h"), (F.col("event_id") % 4).cast("string")).alias("result_hash"),
    )
    return validation.validate_lifecycle(log).select("run_id", "code")


@query("f30_scope_overclaims", """
select conv_id * 1000 + turn as claim_id, doc_id as evidence_url, 'excerpt' as coverage from conversations join documents on doc_id = conv_id where role = 'user' and turn % 2 = 0 and n_chars > 500""")
def f30(spark, root):
    said = F.when(F.col("role") == "user", F.lit(" We reviewed the full document.")).when(F.col("role") == "system", F.lit(" Please read the full document.")).otherwise("")
    # Only the appended sentence decides: talk in the table claims nothing in English or Chinese.
    claims = load(spark, root, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("claim_id"), F.concat(F.translate("text", "abcdefghijklmnopqrstuvwxyz", ""), said).alias("text"),
        F.when(F.col("turn") % 2 == 0, F.array("conv_id")).otherwise(F.array(F.col("conv_id"), F.lit(-1))).alias("refs"),
    )
    docs = load(spark, root, "documents").select(F.col("doc_id").alias("evidence_url"), F.when(F.col("n_chars") > 500, "excerpt").otherwise("complete_text").alias("coverage"))
    return validation.scope_overclaims(claims, docs)


@query("v01_issue_items", """
with o as (select o_orderkey, case o_orderstatus when 'F' then 'daily' when 'O' then 'weekly' else 'monthly' end as level, o_orderdate + interval 36 hour as prepared,
  case o_orderstatus when 'F' then o_orderdate::date when 'O' then date_trunc('week', o_orderdate)::date else date_trunc('month', o_orderdate)::date end as start from orders),
i as (select l_orderkey, l_linenumber as n, l_partkey % 13 as p, case l_partkey % 4 when 0 then 'project' when 1 then 'update' when 2 then 'reading' else 'news' end as kind, level, start,
  prepared - to_hours((l_suppkey % 40)::int) + interval 1 hour as verified, prepared from lineitem join o on l_orderkey = o_orderkey)
select l_orderkey as issue_id, n as item_id, path, code from (
  select *, unnest(list_filter([
    case when p = 1 then {path: 'category', code: 'enum'} end, case when p = 2 then {path: 'audience', code: 'required'} end,
    case when kind = 'reading' and p = 3 then {path: 'featured', code: 'featured_reading'} end,
    case when p = 4 then {path: 'evidence_urls', code: 'required'} end,
    case when verified > prepared then {path: 'verified_at', code: 'order'} end,
    case when verified < prepared - interval 24 hour then {path: 'verified_at', code: 'stale'} end,
    case when (verified + interval 8 hour)::date < start then {path: 'verified_at', code: 'before_period'} end,
    case when kind = 'update' and p = 5 then {path: 'change_note', code: 'update_unexplained'} end,
    case when kind in ('update', 'news') and p = 6 then {path: 'event', code: 'required'} end,
    case when p <> 6 and p in (4, 7) then {path: 'evidence_urls', code: 'event_missing'} end,
    case when p = 8 and kind in ('project', 'update') then {path: 'event', code: 'home_page'} end,
    case when kind = 'reading' and p = 9 then {path: 'author', code: 'required'} end, case when kind = 'reading' and p = 10 then {path: 'original_date', code: 'required'} end,
    case when level = 'weekly' and p = 11 then {path: 'detail', code: 'required'} end, case when level = 'monthly' and p = 12 then {path: 'retention_reason', code: 'required'} end
  ], lambda x: x is not null)) as v from i), lateral (select v.path as path, v.code as code)""")
def v01i(spark, root):
    p, n = F.col("l_partkey") % 13, F.col("l_partkey") % 4
    text = lambda broken: F.when(~broken, "x").otherwise(" ")
    lines, issues = _issue_lines(spark, root)
    lines = lines.join(issues.select("issue_id", "prepared_at"), "issue_id")
    home = F.lit("https://h.example/p")
    event = F.when(p != 6, F.when(p == 8, home).otherwise(F.lit("https://h.example/e")))
    items = lines.select(
        "issue_id", F.col("l_linenumber").alias("item_id"), F.when(n == 0, "project").when(n == 1, "update").when(n == 2, "reading").otherwise("news").alias("kind"),
        F.when(p == 1, "other").otherwise(K.CATEGORIES[0]).alias("category"), ((p == 3) & (n == 2)).alias("featured"),
        *[F.lit("x").alias(c) for c in ("title", "summary", "reason", "usage_conditions")], text(p == 2).alias("audience"), F.lit("tested").alias("verification_level"),
        (F.col("prepared_at") - F.make_dt_interval(hours=F.col("l_suppkey") % 40) + F.expr("INTERVAL 1 HOUR")).alias("verified_at"),
        F.when(p == 4, F.array().cast("array<string>")).when(p == 7, F.array(F.lit("https://h.example/other"))).otherwise(F.array(F.lit("https://h.example/e"), home)).alias("evidence_urls"),
        text((p == 5) & (n == 1)).alias("change_note"), event.alias("event_url"), home.alias("canonical_url"), text(p == 9).alias("author"),
        F.when(p != 10, F.lit("2024-01-01").cast("date")).alias("original_date"), text(p == 11).alias("detail"), text(p == 12).alias("retention_reason"),
    )
    return validation.validate_issue_items(items, issues).select("issue_id", "item_id", "path", "code")


def _issue_lines(spark, root):
    """Order lines under the issue of their order, and the issues, both dealt by issue."""
    return dealt("issue_id", load(spark, root, "lineitem").withColumnRenamed("l_orderkey", "issue_id"), _order_issues(spark, root))


def _order_issues(spark, root):
    """Every order as an issue, prepared 36 hours after the start of its day."""
    level = F.when(F.col("o_orderstatus") == "F", "daily").when(F.col("o_orderstatus") == "O", "weekly").otherwise("monthly")
    day = F.to_date("o_orderdate")
    period = F.when(level == "daily", day.cast("string")).when(level == "weekly", F.to_date(F.date_trunc("week", day)).cast("string")).otherwise(F.date_format(day, "yyyy-MM"))
    return load(spark, root, "orders").select(
        F.col("o_orderkey").alias("issue_id"), level.alias("ranking_type"), period.alias("period"), (F.col("o_orderdate") + F.expr("INTERVAL 36 HOURS")).alias("prepared_at"),
        F.lit(None).cast("int").alias("screened_count"), (F.col("o_orderkey") % 5).cast("int").alias("verified_count"))


@query("v02_final_issues", """
with c as (select o_orderkey, o_orderstatus as s, o_orderdate as d, (select count(*) from lineitem where l_orderkey = o_orderkey) as n from orders),
e as (select *, case s when 'F' then d::date when 'O' then date_trunc('week', d)::date + 6 else (date_trunc('month', d) + interval 1 month)::date - 1 end as ends from c)
select o_orderkey as issue_id, 'no_items' as code from e where n = 0 union all select o_orderkey, 'monthly_short' from e where s = 'P' and n between 1 and 19
union all select o_orderkey, 'open' from e where (d + interval 44 hour)::date <= ends union all select o_orderkey, 'below_selection' from e where o_orderkey % 5 < n""")
def v02f(spark, root):
    items, issues = _issue_lines(spark, root)
    return validation.validate_final_issues(items.select("issue_id"), issues).select("issue_id", "code")


@query("v02_opportunities", """
with l as (select l_orderkey, l_linenumber, l_partkey, o_orderdate from lineitem join orders on l_orderkey = o_orderkey)
select l_orderkey as issue_id, 'required' as code from l where l_partkey % 5 = 0 union all select l_orderkey, 'required' from l where l_partkey % 7 = 0
union all select l_orderkey, 'url' from l where l_partkey % 7 = 1 union all select l_orderkey, 'future' from l where l_partkey % 3 = 0
union all select l_orderkey, 'too_many' from l group by 1 having count(*) > 2""")
def v02o(spark, root):
    p = F.col("l_partkey")
    lines, issues = _issue_lines(spark, root)
    rows = lines.join(issues.select("issue_id", "prepared_at"), "issue_id").select(
        "issue_id", F.when(p % 5 != 0, "x").alias("problem"), *[F.lit("x").alias(c) for c in ("audience", "existing_solutions", "validation")],
        F.when(p % 7 == 0, F.array().cast("array<string>")).when(p % 7 == 1, F.array(F.lit("ftp://h"))).otherwise(F.array(F.lit("https://h.example/"))).alias("evidence_urls"),
        F.date_add(F.to_date("prepared_at"), F.when(p % 3 == 0, 9).otherwise(-9)).alias("evidence_date"))
    return validation.validate_opportunities(rows, issues).select("issue_id", "code")


@query("v01_batch_sources", """
select s_suppkey, case when s_nationkey = 1 then 'name' when s_nationkey = 2 then 'url' when s_nationkey = 3 then 'status' else 'detail' end as path from supplier where s_nationkey between 1 and 4""")
def v01b(spark, root):
    n = F.col("s_nationkey")
    rows = load(spark, root, "supplier").select(
        "s_suppkey", F.when(n != 1, F.col("s_name")).alias("name"), F.when(n == 2, "https://u:p@h.example/").otherwise("https://h.example/").alias("url"),
        F.when(n == 3, "late").otherwise("ok").alias("status"), F.when(n != 4, "").alias("detail"))
    return validation.validate_batch_sources(rows, ["s_suppkey"]).select("s_suppkey", "path")


@query("v05_uncovered_units", """
with u as (select doc_id, text, substr(text, 1, length(text) // 2) as a, substr(text, length(text) // 2 + 1) as b from documents)
select doc_id as unit_id, 'text_uncovered' as code from u where doc_id % 2 = 1 and a <> '' and regexp_matches(b, '[^\\p{P}\\p{C}\\p{Z}\\s]')
  and regexp_matches(replace(text, a, ''), '[^\\p{P}\\p{C}\\p{Z}\\s]')
union all select doc_id, 'text_uncovered' from documents where doc_id % 2 = 1 and length(text) < 2 and regexp_matches(text, '[^\\p{P}\\p{C}\\p{Z}\\s]')
union all select doc_id, 'excerpt_not_in_text' from documents where doc_id % 5 = 0""")
def v05u(spark, root):
    # Every text is checked by its first half; even ones by their second half too, every fifth by words it lacks.
    docs = load(spark, root, "documents").select(F.col("doc_id").alias("unit_id"), "text")
    half = F.floor(F.length("text") / 2).cast("int")
    first, second = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))
    pieces = docs.select("unit_id", first.alias("text")).unionByName(docs.where("unit_id % 2 = 0").select("unit_id", second.alias("text"))).where("text <> ''")
    return validation.uncovered_units(docs, pieces.unionByName(docs.where("unit_id % 5 = 0").select("unit_id", F.lit("never written here").alias("text"))))


@query("f32_fit_budget", """
with s as (select c, sum(20 + least(length(text), case when length(text) > c then c + 1 else length(text) end)) as total from documents, (values (1000000), (250), (125), (62), (31), (15)) v(c) group by 1),
p as (select max(c) as c from s where total <= (select count(*) * 120 from documents))
select doc_id, case when length(text) > c then substr(text, 1, c) || '…' else text end as text from documents, p""")
def f32(spark, root):
    docs = load(spark, root, "documents").select("doc_id", "text")
    return validation.fit_budget(docs, ["text"], docs.agg(F.count(F.lit(1)) * 120).scalar(), F.lit(20))


@query("k05_history_index", """
select strftime(o_orderdate, '%Y-%m') as period, count(*)::bigint as item_count, row_number() over (order by strftime(o_orderdate, '%Y-%m') desc)::bigint as place from orders group by 1""")
def k05(spark, root):
    from curator.sinks.render import history_index

    issues = load(spark, root, "orders").groupBy(F.lit("monthly").alias("ranking_type"), F.date_format("o_orderdate", "yyyy-MM").alias("period")).agg(F.count(F.lit(1)).alias("item_count"))
    return history_index(issues).select("period", "item_count", "place")


@query("s11_due_sources", "select event_id from events where dayofweek(ts) in (1, 3) or event_type = 'error'")
def s11(spark, root):
    from curator.sources.registry import due_sources

    registry = load(spark, root, "events").select(F.col("event_id").alias("source_id"), "event_type", "ts", F.array(F.lit(0), F.lit(2)).alias("weekdays"))
    due = due_sources(registry, F.col("ts"))
    explicit = due_sources(registry, F.col("ts"), chosen=F.col("event_type") == "error")
    return due.select("source_id").union(explicit.select("source_id")).distinct().withColumnRenamed("source_id", "event_id")
