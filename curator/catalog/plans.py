"""Queries of the composed plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from curator import constants as K
from curator.catalog import sqltext as S
from curator.catalog.registry import query
from curator.catalog.scoring import _C8, _terms, ledger_tables
from curator.catalog.sources import cat, repositories
from curator.plans import digest
from curator.plans.ranking import page_ranking
from curator.plans.releases import release_day
from curator.runtime import load
from curator.sources.releases import read_release_atom

_BODY = S.collapse(S.unescape("regexp_replace(html, '<[^>]+>', ' ', 'g')"))
_SIMILAR = "len(list_intersect(a.f, b.f))::double / len(list_distinct(list_concat(a.f, b.f)))"


@query("ranking_of_pages", f"""
with recursive m as (select lower({S.part('url', 2)}) as host, {S.normalize_url('url')} as url, {S.collapse(S.TITLE)} as title, {S.features(S.TITLE)} as f, starts_with(url, 'https:') as allowed,
  lower({_BODY} || ' ' || split_part({S.part('url', 3)}, '/', 2)) as body, epoch_us(ts)::bigint as us from pages left join (select event_id // 40 as page_id, arg_max(ts, (value, event_id)) as ts from events group by 1) using (page_id)),
items as (select *, sha256(host || chr(10) || url) as id, case split_part(host, '.', 1) when 'www' then 'aggregator' when 'blog' then 'primary_official' when 'm' then 'research' else 'open_source' end as cls from m),
edges as (select b.id as i, a.id as j from items a join items b on a.id < b.id where a.url = b.url or (len(a.f) > 0 and len(b.f) > 0 and abs(a.us - b.us) <= {K.WINDOW_HOURS * 3_600_000_000} and {_SIMILAR} >= {K.TITLE_THRESHOLD})),
reach as (select i, j from edges union select r.i, e.j from reach r join edges e on r.j = e.i),
k as (select items.*, coalesce(c, id) as cluster_id, (coalesce(list_position(['primary_official', 'open_source', 'research'], cls), 4), {S.normalize_title('title')}, url, id) as pk, cls <> 'aggregator' and allowed as prim
   from items left join (select i, min(j) as c from reach group by i) on i = id),
g as (select cluster_id, arg_min(title, pk) as t, arg_min(url, pk) as u, arg_min(url, pk) filter (where prim) as pu, bool_or({_terms('body', K.WORKFLOW_TERMS)}) as bw, bool_or({_terms('body', K.WEAK_EVIDENCE_TERMS)}) as bk, max(us) as latest,
   count(distinct host) as n, count(*) as items, case when bool_or(prim) then 'primary' when bool_and(cls = 'aggregator') then 'discovery_only'
   when count(distinct case when allowed and cls <> 'aggregator' then host end) >= 2 then 'multi_source' else 'insufficient' end as st from k group by 1),
w as (select *, bw or {_terms('lower(t)', K.WORKFLOW_TERMS)} as work, bk or {_terms('lower(t)', K.WEAK_EVIDENCE_TERMS)} as weak, {_terms('lower(t)', K.NOISE_TERMS)} and not {_terms('lower(t)', K.WORKFLOW_TERMS)} as noise,
  greatest(0, (epoch_us(timestamp '2024-01-31') - latest) / 86400000000.0) as age from g),
s as (select sha256('event:' || coalesce(pu, u)) as event_id, t as canonical_title, st as evidence_status, pu as primary_source_url, items::bigint as items, n::bigint as sources, greatest(0, least(100,
  case when work then 35 else 13 end + case st when 'primary' then 35 when 'multi_source' then 24 when 'insufficient' then 17 else 8 end + least(15, 4 + 4 * n)
  + case when age is null then 0 when age <= 1 then 15 when age <= 3 then 11 when age <= 7 then 6 else 0 end - case when st = 'discovery_only' then 20 else 0 end - case when weak then 15 else 0 end - case when noise then 15 else 0 end))::bigint as total from w)
select row_number() over (order by total desc, event_id)::bigint as rank, * from s order by total desc, event_id limit 50""")
def ranking(spark, root):
    return page_ranking(spark, root, top=50)


def _release_tables(spark, root):
    parts = repositories(spark, root)
    sources = parts.groupBy("repository").agg(F.min("source_id").alias("source_id")).select(
        "source_id", "repository", F.lit("2").alias("policy_version"), F.array(F.lit(r"v\d+")).alias("accepted_tag_patterns"), F.array(F.lit(r"^v1\d$")).alias("excluded_tag_patterns")
    )
    body = cat(
        '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>tag:x/v1</id><title>R</title><link rel="alternate" href="https://github.com/', F.col("repository"), "/releases/tag/v", F.col("p_size").cast("string"),
        '"/><updated>2024-01-01T00:00:00Z</updated><content type="html">Adds a thing.</content></entry></feed>',
    )
    raw = parts.groupBy("repository").agg(F.max("p_size").alias("p_size")).join(sources.select("source_id", "repository"), "repository").select("source_id", body.alias("body"))
    feed = read_release_atom(raw, sources)
    log = parts.groupBy("repository").agg(F.max("p_size").alias("p_size"), F.max("p_retailprice").alias("price")).select(
        F.concat("repository", F.lit("@v"), F.col("p_size").cast("string")).alias("release_key"), F.lit(1).alias("seq"), F.when(F.col("price") > 1095, "accepted").otherwise("pending_review").alias("status"),
        F.when(F.col("p_size") % 2 == 0, "2").otherwise("1").alias("policy_version"), F.lit("h").alias("content_hash"),
    )
    return feed, sources, log


@query("release_ledger_day", """
with r as (select replace(p_brand, '#', '-') || '/' || replace(p_name, ' ', '-') as repository, max(p_size) as s, max(p_retailprice) as price from part group by 1),
o as (select repository || '@v' || s as release_key, s from r where not (price > 1095 and s % 2 = 0)),
j as (select *, s between 10 and 19 as excluded from o)
select release_key, case when excluded then 'filtered' else 'pending_review' end as status, case when excluded then 'tag_excluded' else '' end as reasons from j
union all select release_key, 'accepted', '' from j where not excluded""")
def release_ledger_day(spark, root):
    feed, sources, log = _release_tables(spark, root)
    change = F.struct(F.lit("s").alias("summary"), F.lit("a thing").alias("evidence"))
    decisions = feed.select(
        "release_key", F.lit("accept").alias("decision"), F.array(F.lit("feature")).alias("change_types"), F.array(change).alias("changes"), F.lit("useful").alias("decision_reason")
    )
    day = release_day(feed, sources, log, decisions, load(spark, root, "nation").select(F.col("n_name").alias("release_key")))
    return day.entries.select("release_key", "status", F.array_join("reasons", ",").alias("reasons"))


@query("weekly_issue", _C8 + """
, best as (select * from ss qualify row_number() over (partition by canonical_url order by case status when 'available' then 2 when 'needs_evidence' then 1 else 0 end desc, coalesce(low, discovered_at) desc, coalesce(lastv, collected_at) desc, kind desc, event_key desc) = 1),
opened as (select *, row_number() over (order by canonical_url) - 1 as pos, count(*) over () as total from best where status <> 'blocked'),
pages_seen as (select * from opened where (pos - case when total > 80 then ('0x' || substr(sha256('["weekly","2024-01-08"]'), 1, 8))::bigint % total else 0 end + total) % total < 80),
sc as (select *, obs_id % 11 as d_value, canonical_url::bigint % 11 as d_new, 5 as d_ev, 6 as d_use, obs_id % 7 as d_int from pages_seen),
t as (select *, case when kind = 'news' then d_value * 3 + d_new * 3 + d_ev * 3 + d_use else d_value * 4 + d_new + d_ev + d_use * 3 + d_int end as score from sc where status = 'available' and st = 'verified'),
high_score as (select * from t where score >= 65), one as (select * from high_score where event_url is not null qualify row_number() over (partition by event_url order by score desc, canonical_url) = 1),
sel as (select canonical_url, kind, score from one union all select canonical_url, kind, score from high_score where event_url is null),
r as (select *, row_number() over (order by score desc, canonical_url) as rank from sel)
select canonical_url, kind, score::bigint as total, rank::bigint as rank, kind <> 'reading' and sum(case when kind <> 'reading' then 1 else 0 end) over (order by rank rows unbounded preceding) <= 3 as featured from r where rank <= 25""")
def weekly_issue(spark, root):
    obs, history = ledger_tables(spark, root)
    obs = obs.withColumn("candidate_id", F.col("canonical_url")).withColumn("category", F.lit("Skills"))
    # Scores follow the chosen observation, one assessment per candidate and observation.
    scores = F.struct(*[c.cast("int").alias(n) for n, c in (
        ("value", F.col("obs_id") % 11), ("novelty", F.col("canonical_url").cast("long") % 11), ("evidence", F.lit(5)), ("usability", F.lit(6)), ("interest", F.col("obs_id") % 7),
    )])
    candidates, _ = digest.candidate_query(obs, history, "weekly", "2024-01-08")
    page = digest.screening_page(candidates, "weekly", "2024-01-08")
    assessments = page.select("candidate_id", F.lit("PASS").alias("precheck"), scores.alias("scores"), F.array().cast("array<string>").alias("flags"), F.lit(True).alias("has_context"))
    selected = digest.judged(page, assessments).where("decision = 'select'").withColumn("total", F.col("total_score"))
    chosen = digest.select_issue(selected, digest.PUBLISHED["weekly"])
    return chosen.select("canonical_url", "kind", F.col("total").cast("long").alias("total"), F.col("rank").cast("long").alias("rank"), "featured")
