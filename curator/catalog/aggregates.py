"""Queries of the aggregations (A) and the linked-story gate (P7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from curator.catalog import sqltext as S

from curator.catalog.registry import query
from curator.functions import text, urls
from curator.operators import aggregates, filters
from curator.runtime import load

_K = "cast(json_extract(props, '$.k') as bigint)"


def k():
    return F.get_json_object("props", "$.k").cast("long")


_MEMBERS = f"""
with m as (select regexp_extract(url, '//([^/]*)/', 1) as host, regexp_extract(url, '^[a-z]+://[^/]*/([a-z]*)', 1) as lang, lpad(page_id::varchar, 12, '0') as id,
  {S.TITLE} as title, {S.normalize_url('url')} as url, starts_with(url, 'https:') as allowed from pages),
c as (select *, lang || '-' || substr(id, 11, 1) as cluster_id, split_part(host, '.', 1) as p from m),
s as (select *, case when p = 'www' then 'aggregator' when p = 'blog' then 'primary_official' when p = 'm' then 'research' else 'community' end as cls from c),
k as (select *, (coalesce(list_position(['primary_official', 'open_source', 'research'], cls), 4), {S.normalize_title('title')}, url, id) as pk,
  cls in ('primary_official', 'open_source', 'research') and allowed as prim from s)"""


def members(spark, root):
    """Pages grouped by language and a digit of their number."""
    host = F.regexp_extract("url", "//([^/]*)/", 1)
    prefix = F.substring_index(host, ".", 1)
    page = F.lpad(F.col("page_id").cast("string"), 12, "0")
    return load(spark, root, "pages").select(
        F.concat(F.regexp_extract("url", "^[a-z]+://[^/]*/([a-z]*)", 1), F.lit("-"), F.substring(page, 11, 1)).alias("cluster_id"),
        page.alias("id"), text.unescape(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"),
        urls.normalize_url("url").alias("url"), host.alias("source_id"),
        F.when(prefix == "www", "aggregator").when(prefix == "blog", "primary_official").when(prefix == "m", "research").otherwise("community").alias("source_class"),
        F.col("url").startswith("https:").alias("evidence_allowed"),
    )


@query("a01_stories_from_clusters", _MEMBERS + f"""
, g as (select cluster_id, arg_min(title, pk) as t, arg_min(url, pk) as u, arg_min(url, pk) filter (where prim) as pu, count(distinct host)::bigint as source_count,
  string_agg(distinct cls, ' ' order by cls) as source_classes, count(*)::bigint as item_count from k group by 1)
select cluster_id, sha256('event:' || coalesce(pu, u)) as event_id, t as canonical_title, pu as primary_source_url, source_count, source_classes, item_count from g""")
def a01(spark, root):
    return aggregates.stories_from_clusters(members(spark, root)).select(
        "cluster_id", "event_id", "canonical_title", "primary_source_url", "source_count",
        F.array_join("source_classes", " ").alias("source_classes"), "item_count",
    )


@query("a01_story_sources", _MEMBERS + """
select cluster_id, host as source_id, count(*)::bigint as item_count from k group by 1, 2""")
def a01s(spark, root):
    return aggregates.story_sources(members(spark, root))


@query("a02_evidence_status", _MEMBERS + """
select cluster_id, case when bool_or(prim) then 'primary' when bool_and(cls = 'aggregator') then 'discovery_only'
  when count(distinct case when allowed and cls <> 'aggregator' then host end) >= 2 then 'multi_source' else 'insufficient' end as evidence_status from k group by 1""")
def a02(spark, root):
    return aggregates.stories_from_clusters(members(spark, root)).select("cluster_id", "evidence_status")


@query("p07_ranking_gate", _MEMBERS + """
select count(distinct host)::bigint as good_sources, count(distinct cluster_id)::bigint as linked_events, '' as failure_reason, true as passed from k""")
def p07(spark, root):
    pages = members(spark, root).withColumn("source_links", F.array().cast("array<string>"))
    stories = pages.select("cluster_id").distinct()
    return filters.ranking_gate(pages.select("source_id").distinct(), filters.linked_stories(pages, stories))


@query("p07_failed_gates", _MEMBERS + """
, mobile as (select distinct host from k where host like 'm.%'), n as (select (select count(*) from mobile) as sources, (select count(distinct cluster_id) from k) as stories)
select 'sources' as gate, least(sources, 2) as good_sources, stories as linked_events, 'only ' || least(sources, 2) || ' sources succeeded' as failure_reason, false as passed from n
union all select 'links', (select count(distinct host) from k), 0, 'no candidate events with source links', false
union all select 'both', 0, 0, 'only 0 sources succeeded; no candidate events with source links', false""")
def p07f(spark, root):
    pages = members(spark, root).withColumn("source_links", F.array().cast("array<string>"))
    stories, hosts = pages.select("cluster_id").distinct(), pages.select("source_id").distinct()
    two = hosts.where("source_id like 'm.%'").orderBy("source_id").limit(2)  # one source too few is the case
    linked, bare = filters.linked_stories(pages, stories), filters.linked_stories(pages.withColumn("url", F.lit("")), stories)
    gates = {"sources": (two, linked), "links": (hosts, bare), "both": (hosts.where("source_id is null"), bare)}
    found = None
    for name, (sources, events) in gates.items():
        row = filters.ranking_gate(sources, events).select(F.lit(name).alias("gate"), "*")
        found = row if found is None else found.unionByName(row)
    return found


_BACKTEST = """
with f as (select l_returnflag || l_linestatus as source_id, l_orderkey, l_partkey, l_linenumber, l_suppkey, l_quantity, l_discount > 0.08 as pre, l_tax < 0.01 as inc from lineitem)"""


@query("a03_backtest", _BACKTEST + """
select source_id, count(*)::bigint as observed_count, count(*) filter (where not pre and not inc)::bigint as eligible_count,
  count(*) filter (where not pre and not inc and o_orderstatus = 'F')::bigint as accepted_count, count(*) filter (where not pre and not inc and o_orderstatus = 'O')::bigint as rejected_count,
  count(*) > 10000 as coverage_complete from f join orders on l_orderkey = o_orderkey group by 1""")
def a03(spark, root):
    counts, _ = backtest(spark, root)
    return counts


@query("a03_backtest_reasons", _BACKTEST + """
select source_id, 'prerelease_tag' as reason, count(*)::bigint as rejections from f where pre group by 1
union all select source_id, 'incomplete_release', count(*)::bigint from f where inc group by 1""")
def a03r(spark, root):
    return backtest(spark, root)[1]


def backtest(spark, root):
    lines = load(spark, root, "lineitem").withColumn("source_id", F.concat("l_returnflag", "l_linestatus"))
    why = F.array_compact(F.array(F.when(F.col("l_discount") > 0.08, "prerelease_tag"), F.when(F.col("l_tax") < 0.01, "incomplete_release")))
    filtered = lines.select("source_id", F.col("l_orderkey").alias("release_key"), why.alias("reasons")).withColumn("eligible", F.size("reasons") == 0)
    decisions = load(spark, root, "orders").select(
        F.col("o_orderkey").alias("release_key"), F.when(F.col("o_orderstatus") == "F", "accept").when(F.col("o_orderstatus") == "O", "reject").alias("decision")
    )
    closed = lines.groupBy("source_id").agg((F.count(F.lit(1)) > 10000).alias("closed"))
    return aggregates.backtest(filtered, decisions, closed)


_TRIAL = """
with m as (select l_suppkey as source_id, count(distinct l_shipdate::date) as fetch_days from lineitem where l_shipdate >= timestamp '1998-03-01' and l_shipdate < timestamp '1998-03-15' and l_returnflag <> 'N' group by 1),
g as (select l_suppkey as source_id, l_shipdate, o_orderdate, case l_returnflag when 'A' then 'accepted' when 'R' then 'rejected' else 'filtered' end as st, case when l_linenumber = 7 then '1.0-rc' else '1.0' end as tag,
   l_linenumber > 1 as ev, l_linestatus from lineitem join orders on l_orderkey = o_orderkey),
c as (select source_id, count(*) as eligible_count, count(*) filter (where st = 'accepted') as accepted_count, count(*) filter (where tag = '1.0-rc') as prerelease_leaks,
   count(*) filter (where st = 'accepted' and ev) as complete_evidence_count,
   max(case when l_linestatus = 'F' and source_id % 9 = 0 then 'infinity'::double else greatest(0.0, (epoch(l_shipdate) - epoch(o_orderdate)) / 3600.0) end) as max_latency_hours
   from g where l_shipdate >= timestamp '1998-03-01' and l_shipdate < timestamp '1998-03-15' and st <> 'filtered' group by 1),
t as (select coalesce(m.source_id, c.source_id) as source_id, coalesce(fetch_days, 0)::bigint as fetch_days, coalesce(eligible_count, 0)::bigint as eligible_count, coalesce(accepted_count, 0)::bigint as accepted_count,
   coalesce(prerelease_leaks, 0)::bigint as prerelease_leaks, coalesce(complete_evidence_count, 0)::bigint as complete_evidence_count, round(coalesce(max_latency_hours, 0.0), 4) as max_latency_hours
   from m full join c on m.source_id = c.source_id)"""


def trial(spark, root):
    lines, orders = load(spark, root, "lineitem"), load(spark, root, "orders")
    manifests = lines.select(F.col("l_suppkey").alias("source_id"), F.to_date("l_shipdate").alias("day"), (F.col("l_returnflag") == "N").alias("gapped"))
    unreadable = (F.col("l_linestatus") == "F") & (F.col("l_suppkey") % 9 == 0)
    ledger = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("l_suppkey").alias("source_id"), F.col("l_shipdate").alias("discovered_at"), F.when(~unreadable, F.col("o_orderdate")).alias("published_at"),
        F.when(F.col("l_returnflag") == "A", "accepted").when(F.col("l_returnflag") == "R", "rejected").otherwise("filtered").alias("status"),
        F.when(F.col("l_linenumber") == 7, "1.0-rc").otherwise("1.0").alias("release_tag"), (F.col("l_linenumber") > 1).alias("evidence_complete"),
    )
    return aggregates.trial_metrics(manifests, ledger, F.lit("1998-03-01").cast("date"), 14).withColumn("max_latency_hours", F.round("max_latency_hours", 4))


@query("a04_trial_metrics", _TRIAL + " select * from t")
def a04(spark, root):
    return trial(spark, root)


@query("a05_trial_decision", _TRIAL + """
, r as (select *, fetch_days < 13 as a, prerelease_leaks > 0 as b, max_latency_hours > 24 as c, complete_evidence_count <> accepted_count as d from t)
select source_id, case when a or b or c or d then 'demote_watchlist' when eligible_count < 3 then 'continue_trial' when accepted_count < 1 then 'demote_watchlist' else 'promote_core' end as decision,
 case when a or b or c or d then concat_ws(',', case when a then 'fetch_success_below_13_of_14' end, case when b then 'prerelease_leak' end, case when c then 'latency_above_24_hours' end, case when d then 'accepted_evidence_incomplete' end)
  when eligible_count < 3 then 'insufficient_eligible_sample' when accepted_count < 1 then 'no_substantive_change_accepted' else '' end as reasons from r""")
def a05(spark, root):
    return aggregates.trial_decision(trial(spark, root)).select("source_id", "decision", F.array_join("reasons", ",").alias("reasons"))


@query("a06_coverage", """
with d as (select unnest(generate_series(date '2023-12-28', date '2024-02-03', interval 1 day))::date as d),
b as (select (ts + interval 8 hour)::date as d, count(*) as runs, count(*) filter (where value > 5) as ok, count(*) filter (where value <= 5 and event_type <> 'error') as em, count(*) filter (where value <= 5 and event_type = 'error') as fa from events group by 1)
select strftime(d.d, '%Y-%m-%d') as local_date, coalesce(runs, 0)::bigint as runs, coalesce(ok, 0)::bigint as ok_sources, coalesce(fa, 0)::bigint as failed_sources, coalesce(em, 0)::bigint as empty_sources, runs is null as missing
from d left join b on d.d = b.d""")
def a06(spark, root):
    from curator.functions.times import local_date

    status = F.when(F.col("value") > 5, "ok").when(F.col("event_type") == "error", "failed").otherwise("empty")
    batches = load(spark, root, "events").select(
        F.col("event_id").alias("run_id"), local_date("ts").alias("local_date"), F.array(F.struct(F.col("event_type").alias("name"), status.alias("status"))).alias("sources")
    )
    return aggregates.coverage(batches, F.lit("2023-12-28").cast("date"), F.lit("2024-02-03").cast("date")).withColumn("local_date", F.col("local_date").cast("string"))


@query("a07_ledger_status", """
select (select count(distinct user_id) from events)::bigint as candidate_count, (select count(*) from events)::bigint as observation_count, (select count(*) from orders)::bigint as batch_count,
 (select epoch(max(o_orderdate)) from orders)::bigint as last_collected, (select count(distinct o_orderdate::date) from orders)::bigint as collection_dates, (select count(*) from customer)::bigint as issue_count""")
def a07(spark, root):
    obs = load(spark, root, "events").select(F.col("user_id").alias("canonical_url"))
    batches = load(spark, root, "orders").select(F.col("o_orderdate").alias("collected_at"), F.to_date("o_orderdate").alias("local_date"))
    status = aggregates.ledger_status(obs, batches, load(spark, root, "customer"))
    return status.withColumn("last_collected", F.unix_seconds("last_collected_at")).drop("last_collected_at")


@query("a08_candidate_counts", """
select o_orderpriority, count(*)::bigint as total_candidates, count(*) filter (where o_orderstatus = 'F')::bigint as available_count,
  count(*) filter (where o_orderstatus = 'P')::bigint as needs_evidence_count, count(*) filter (where o_orderstatus = 'O')::bigint as blocked_count from orders group by 1""")
def a08(spark, root):
    status = F.when(F.col("o_orderstatus") == "F", "available").when(F.col("o_orderstatus") == "P", "needs_evidence").otherwise("blocked")
    return aggregates.candidate_counts(load(spark, root, "orders").select("o_orderpriority", status.alias("selection_status")), "o_orderpriority")


_JUDGED = """
with j as (select l.doc_id, lang, n_chars > 1500 as p, quality = 1 as a from labels l join documents using (doc_id))"""


def judged(spark, root):
    docs = load(spark, root, "documents").select("doc_id", "lang", "n_chars")
    return load(spark, root, "labels").join(docs, "doc_id")


@query("a09_confusion", _JUDGED + """
, c as (select lang, count(*) filter (where p and a) as tp, count(*) filter (where p and not a) as fp, count(*) filter (where not p and a) as fn, count(*) filter (where not p and not a) as tn from j group by 1)
select lang, tp::bigint as true_positive, fp::bigint as false_positive, fn::bigint as false_negative, tn::bigint as true_negative,
  round(case when tp + fp > 0 then tp::double / (tp + fp) end, 6) as precision, round(case when tp + fn > 0 then tp::double / (tp + fn) end, 6) as recall from c""")
def a09(spark, root):
    table = aggregates.confusion(judged(spark, root), F.col("n_chars") > 1500, F.col("quality") == 1, "lang")
    return table.withColumn("precision", F.round("precision", 6)).withColumn("recall", F.round("recall", 6))


@query("a09_confusion_cases", _JUDGED + "select doc_id, case when p then 'false_positive' else 'false_negative' end as error from j where p <> a")
def a09c(spark, root):
    return aggregates.confusion_cases(judged(spark, root), F.col("n_chars") > 1500, F.col("quality") == 1).select("doc_id", "error")


@query("a10_threshold_scan", """
with j as (select least(100, n_chars // 40) as score, quality = 1 as a, toxic = 0 as ok from labels join documents using (doc_id)),
t as (select unnest(generate_series(40, 90, 5)) as threshold),
c as (select threshold, count(*) filter (where ok and score >= threshold and a) as tp, count(*) filter (where ok and score >= threshold and not a) as fp,
   count(*) filter (where not (ok and score >= threshold) and a) as fn, count(*) filter (where not (ok and score >= threshold) and not a) as tn from t, j group by 1)
select threshold::bigint as threshold, tp::bigint as true_positive, fp::bigint as false_positive, fn::bigint as false_negative, tn::bigint as true_negative,
  round(case when tp + fp > 0 then tp::double / (tp + fp) end, 6) as precision, round(case when tp + fn > 0 then tp::double / (tp + fn) end, 6) as recall from c""")
def a10(spark, root):
    rows = judged(spark, root)
    scan = aggregates.threshold_scan(rows, F.least(F.lit(100), F.floor(F.col("n_chars") / 40)), F.col("toxic") == 0, F.col("quality") == 1)
    return scan.withColumn("precision", F.round("precision", 6)).withColumn("recall", F.round("recall", 6))


_RUNS = f"""
with r as (select event_type as provider, user_id * 1000 + {_K} as candidate_id, event_id, case when value < 2 then 'not_run' when value < 5 then 'failed' else 'succeeded' end as status,
  case {_K} % 3 when 0 then 'select' when 1 then 'defer' else 'reject' end as decision, value as sec, case when {_K} % 2 = 0 then {_K} end as pt, case when {_K} % 4 <> 3 then {_K} + 1 end as it, {_K} % 5 as unk from events)"""


def runs(spark, root):
    v, n = F.col("value"), k()
    return load(spark, root, "events").select(
        F.col("event_type").alias("provider"), (F.col("user_id") * 1000 + n).alias("candidate_id"), "event_id",
        F.when(v < 2, "not_run").when(v < 5, "failed").otherwise("succeeded").alias("status"),
        F.when(n % 3 == 0, "select").when(n % 3 == 1, "defer").otherwise("reject").alias("decision"), v.alias("elapsed_seconds"),
        F.when(n % 2 == 0, n).alias("prompt_tokens"), F.when(n % 4 != 3, n + 1).alias("input_tokens"),
        n.alias("completion_tokens"), F.lit(None).cast("long").alias("output_tokens"), (n % 5).alias("unknown_dimensions"),
    )


@query("a11_compare_runs", _RUNS + """
select provider, count(*) filter (where status = 'succeeded')::bigint as succeeded, count(*) filter (where status = 'failed')::bigint as failed,
  count(*) filter (where status = 'succeeded' and decision = 'select')::bigint as decided_select, count(*) filter (where status = 'succeeded' and decision = 'defer')::bigint as decided_defer,
  count(*) filter (where status = 'succeeded' and decision = 'reject')::bigint as decided_reject,
  sum(case when status <> 'not_run' then coalesce(pt, it, 0) else 0 end)::bigint as input_token_sum, count(*) filter (where status <> 'not_run' and pt is null and it is null)::bigint as missing_usage,
  sum(case when status = 'succeeded' then unk else 0 end)::bigint as unknown_answers, round(median(sec) filter (where status <> 'not_run'), 6) as median_seconds from r group by 1""")
def a11(spark, root):
    return aggregates.compare_runs(runs(spark, root)).drop("output_token_sum").withColumn("median_seconds", F.round("median_seconds", 6))


@query("a11_paired_agreement", _RUNS + """
, o as (select provider, candidate_id, max(decision) as decision from r where status = 'succeeded' group by 1, 2)
select count(*)::bigint as paired, count(*) filter (where a.decision = b.decision)::bigint as decision_agreement from o a join o b using (candidate_id) where a.provider = 'click' and b.provider = 'view'""")
def a11p(spark, root):
    one = runs(spark, root).where("status = 'succeeded'").groupBy("provider", "candidate_id").agg(F.max("decision").alias("decision")).withColumn("status", F.lit("succeeded"))
    return aggregates.paired_agreement(one, "click", "view")


_IMPACT = """
with g as (select distinct l_orderkey as case_id, l_suppkey as project_id from lineitem where l_linestatus = 'O'), p as (select distinct l_orderkey as case_id, l_suppkey as project_id from lineitem where l_quantity > 10),
crit as (select o_orderkey as case_id from orders where o_orderpriority = '1-URGENT'),
x as (select coalesce(g.case_id, p.case_id) as case_id, g.case_id is not null as gold, p.case_id is not null as pred from g full join p on g.case_id = p.case_id and g.project_id = p.project_id)"""


@query("a12_impact_score", _IMPACT + """
select count(*) filter (where gold and pred)::bigint as true_positive_projects, count(*) filter (where gold and not pred)::bigint as false_negative_projects, count(*) filter (where pred and not gold)::bigint as false_positive_projects,
 round(count(*) filter (where gold and pred)::double / count(*) filter (where gold), 4) as project_recall, round(count(*) filter (where gold and pred)::double / count(*) filter (where pred), 4) as precision,
 count(*) filter (where gold and not pred and case_id in (select case_id from crit))::bigint as critical_misses from x""")
def a12(spark, root):
    from curator.operators.evaluation import impact_projects

    lines = load(spark, root, "lineitem")
    gold = lines.where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("case_id"), F.col("l_suppkey").alias("project_id"))
    pred = lines.where("l_quantity > 10").select(F.col("l_orderkey").alias("case_id"), F.col("l_suppkey").alias("project_id"))
    critical = load(spark, root, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("case_id"))
    return impact_projects(gold, pred, critical).drop("repeated_critical_misses", "dependency_graph_decision")


_LEVELS = """
with g as (select distinct l_orderkey as case_id, l_suppkey as project_id from lineitem where l_linestatus = 'O'), ev as (select l_orderkey as case_id, l_suppkey as project_id, bool_or(l_quantity > 20) as hit from lineitem group by 1, 2),
c as (select g.case_id, count(*) as n, count(*) filter (where hit) as h from g join ev on g.case_id = ev.case_id and g.project_id = ev.project_id group by 1)"""


@query("a12_evidence_levels", _LEVELS + """
select case_id, case when h = 0 then 'none' when h = n then 'two_sided' else 'one_sided' end as level from c""")
def a12l(spark, root):
    from curator.operators.evaluation import evidence_levels

    lines = load(spark, root, "lineitem")
    sides = lines.where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("case_id"), F.col("l_suppkey").alias("project_id")).distinct()
    matched = lines.where("l_quantity > 20").select(F.col("l_orderkey").alias("case_id"), F.col("l_suppkey").alias("project_id"))
    return evidence_levels(sides, matched)


_LOG = f"""
with l as (select event_id, user_id, {_K} as k, case event_type when 'purchase' then 'learning_finalized' when 'click' then 'feedback_recorded' when 'error' then 'learning_review_failed' else event_type end as event,
  case when value > 1 then 'success' else 'partial' end as status, case when user_id % 2 = 0 then 'discovered' else 'nominated' end as mode from events)"""


@query("a13_admission", _LOG + """
, q as (select distinct user_id, mode from l where event = 'learning_finalized' and status = 'success' and (mode <> 'discovered' or k between 1 and 20)),
c as (select count(*) as n, count(*) filter (where mode = 'nominated') as nom, count(*) filter (where mode = 'discovered') as dis,
  count(*) filter (where user_id in (select user_id from l where event = 'feedback_recorded' and k % 3 = 0)) as pos from q),
e as (select count(distinct (user_id, k)) as err from l where event = 'learning_review_failed' and k % 7 = 0)
select n::bigint as completed_runs, nom::bigint as nominated_runs, dis::bigint as discovered_runs, pos::bigint as positive_feedback_runs, err::bigint as dual_evidence_errors,
  concat_ws(',', case when n < 10 then 'completed_runs<10' end, case when nom < 3 then 'nominated_runs<3' end, case when dis < 3 then 'discovered_runs<3' end, case when pos < 6 then 'positive_feedback_runs<6' end, case when err > 1 then 'dual_evidence_errors>1' end) as unmet_requirements,
  n >= 10 and nom >= 3 and dis >= 3 and pos >= 6 and err <= 1 as eligible_for_automation from c, e""")
def a13(spark, root):
    n = k()
    log = load(spark, root, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("run_id"),
        F.when(F.col("event_type") == "purchase", "learning_finalized").when(F.col("event_type") == "click", "feedback_recorded")
        .when(F.col("event_type") == "error", "learning_review_failed").otherwise(F.col("event_type")).alias("event"),
        F.when(F.col("value") > 1, "success").otherwise("partial").alias("status"),
        F.when(F.col("user_id") % 2 == 0, "discovered").alias("entry_mode"), F.when(n % 3 == 0, "continue").otherwise("ignore").alias("feedback"),
        F.when(n % 7 == 0, "dual_evidence").alias("error_class"), n.cast("string").alias("attempt_sha256"),
        F.struct(
            n.alias("screened_candidate_count"), F.lit(2).alias("deep_read_count"), F.lit(1).alias("search_query_count"), n.alias("direct_candidate_count"),
            F.lit(0).alias("adjacent_candidate_count"), F.lit("a/b").alias("selected_repository"),
        ).alias("discovery_metrics"),
    )
    return aggregates.admission(log).withColumn("unmet_requirements", F.array_join("unmet_requirements", ","))


@query("a14_usage", f"""
select event_type as stage, {_K} % 4 as model, count(*)::bigint as requests, sum(case when {_K} - 20 >= 0 then {_K} - 20 else 0 end)::bigint as prompt_tokens, sum(user_id)::bigint as completion_tokens from events group by 1, 2""")
def a14(spark, root):
    requests = load(spark, root, "events").select(F.col("event_type").alias("stage"), (k() % 4).alias("model"), (k() - 20).alias("prompt_tokens"), F.col("user_id").alias("completion_tokens"))
    return aggregates.usage(requests, ["stage", "model"], ["prompt_tokens", "completion_tokens"])


@query("a14_status_histogram", "select o_orderstatus as status, count(*)::bigint as jobs from orders group by 1")
def a14s(spark, root):
    return aggregates.status_histogram(load(spark, root, "orders").withColumnRenamed("o_orderstatus", "status"))


@query("a15_fact_coverage", """
with l as (select distinct l_orderkey, l_linenumber from lineitem), g as (select o_orderkey, (o_custkey % 5) + 1 as a, (o_custkey % 5) + 2 as b, o_orderpriority = '1-URGENT' as critical from orders),
c as (select o_orderkey, a, b, critical, count(l_linenumber) as n from g left join l on l_orderkey = o_orderkey and l_linenumber between a and b group by all)
select o_orderkey as fact_id, n::bigint as covered_lines, 2::bigint as required_lines, n = 2 as hit, critical and n < 2 as critical_miss from c""")
def a15(spark, root):
    lines = load(spark, root, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"))
    start = F.col("o_custkey") % 5 + 1
    gold = load(spark, root, "orders").select(
        F.col("o_orderkey").alias("file"), F.col("o_orderkey").alias("fact_id"), start.alias("line_start"), (start + 1).alias("line_end"), (F.col("o_orderpriority") == "1-URGENT").alias("critical")
    )
    return aggregates.fact_coverage(lines, gold, ["file"]).select("fact_id", "covered_lines", "required_lines", "hit", "critical_miss")


_COLLECT = """
with e as (select event_type as source, ts, case when user_id % 11 = 0 then 'unknown' when ts > timestamp '2024-01-25' then 'future' when ts < timestamp '2024-01-23' then 'outside' else 'inside' end as st, value, user_id from events),
s as (select source, count(*)::bigint as read_items, count(*) filter (where st in ('inside', 'unknown') and value > 3)::bigint as accepted_observations, count(*) filter (where st = 'future')::bigint as future_items,
  count(*) filter (where st = 'outside')::bigint as outside_window, count(*) filter (where st = 'unknown')::bigint as unknown_date_items, count(*) filter (where st in ('inside', 'unknown') and value <= 3)::bigint as budget_excluded,
  count(*) filter (where value > 100 and source = 'click')::bigint as errors, epoch_us(min(ts) filter (where user_id % 11 <> 0))::bigint as lo, epoch_us(max(ts) filter (where user_id % 11 <> 0))::bigint as hi from e group by 1),
r as (select *, case when errors > 0 then 'failed' else 'ok' end as status from s)"""


def counters(spark, root):
    at = F.when(F.col("user_id") % 11 != 0, F.col("ts"))
    state = filters.window_state(at, F.lit("2024-01-25").cast("timestamp"), 48)
    entries = load(spark, root, "events").select(
        F.col("event_type").alias("source"), state.alias("state"), (state.isin("inside", "unknown") & (F.col("value") > 3)).alias("accepted"),
        (state.isin("inside", "unknown") & (F.col("value") <= 3)).alias("budget_excluded"), ((F.col("value") > 100) & (F.col("event_type") == "click")).alias("error"), at.alias("observed_at"),
    )
    return aggregates.collect_counters(entries)


@query("a16_collect_counters", _COLLECT + " select * from r")
def a16(spark, root):
    return counters(spark, root).withColumn("lo", F.unix_micros("observed_date_min")).withColumn("hi", F.unix_micros("observed_date_max")).drop("observed_date_min", "observed_date_max")


@query("a16_run_status", _COLLECT + """
select case when count(*) filter (where status = 'failed') = count(*) then 'failed' when bool_or(status = 'failed') then 'partial' when sum(accepted_observations) > 0 then 'ok' else 'empty' end as status,
  count(*)::bigint as sources, count(*) filter (where status = 'failed')::bigint as failed_sources from r""")
def a16r(spark, root):
    return aggregates.run_status(counters(spark, root))


@query("a17_candidate_rollup", f"""
select user_id, epoch_us(min(ts))::bigint as first_us, epoch_us(max(ts + interval 1 hour))::bigint as last_us, count(distinct {_K})::bigint as source_urls, count(*)::bigint as observations from events group by 1""")
def a17(spark, root):
    return aggregates.candidate_rollup(obs(spark, root), ["user_id"]).select(
        "user_id", F.unix_micros("first_discovered_at").alias("first_us"), F.unix_micros("last_collected_at").alias("last_us"), "source_urls", "observations"
    )


@query("a17_candidate_sources", f"select distinct user_id, {_K} as source_url from events")
def a17s(spark, root):
    return aggregates.candidate_sources(obs(spark, root), ["user_id"])


def obs(spark, root):
    return load(spark, root, "events").select("user_id", F.col("ts").alias("discovered_at"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("collected_at"), k().alias("source_url"))
