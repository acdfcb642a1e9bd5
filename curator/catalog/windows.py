"""Queries of the window (W), top-k (L) and set (U) operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from curator.catalog.registry import query
from curator.operators import sets, topk, windows
from curator.runtime import load

_K = "cast(json_extract(props, '$.k') as bigint)"


def k():
    return F.get_json_object("props", "$.k").cast("long")


@query("w01_latest", f"""
select user_id, event_id, event_type, {_K} as k from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1""")
def w01(spark, root):
    log = load(spark, root, "events").select("user_id", "ts", "event_id", "event_type", k().alias("k"))
    return windows.latest(log, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "k")


@query("w02_current_state", """
select user_id, event_id, event_type as status, epoch_us(first_value(ts) over (partition by user_id order by ts, event_id))::bigint as first_us
from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1""")
def w02(spark, root):
    log = load(spark, root, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("status"), F.col("ts").alias("seen_at"))
    state = windows.current_state(log, ["user_id"], ["ts", "event_id"], "seen_at")
    return state.select("user_id", "event_id", "status", F.unix_micros("first_discovered_at").alias("first_us"))


@query("w03_history", """
select user_id, event_id, event_type, row_number() over (partition by user_id order by ts, event_id)::bigint as place,
       count(*) over (partition by user_id)::bigint as entries from events""")
def w03(spark, root):
    log = load(spark, root, "events").select("user_id", "ts", "event_id", "event_type")
    return windows.history(log, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "place", "entries")


@query("w03_conversation_history", """
select conv_id, turn, role, row_number() over (partition by conv_id order by turn)::bigint as place,
       count(*) over (partition by conv_id)::bigint as entries from conversations""")
def w03c(spark, root):
    log = load(spark, root, "conversations").select("conv_id", "turn", "role")
    return windows.history(log, ["conv_id"], ["turn"])


@query("w04_event_candidates", f"""
with r as (select event_type as kind, {_K} as event_key, event_id, case when value > 20 then 'verified' else 'discovered' end as st, ts from events),
b as (select *, count(*) over (partition by kind, event_key)::bigint as n, max(ts) over (partition by kind, event_key) as m,
      row_number() over (partition by kind, event_key order by (st = 'verified') desc, ts desc, event_id desc) as rn from r)
select kind, event_key, event_id as obs_id, st as evidence_status, n as observation_count, epoch_us(m)::bigint as last_us,
       case when st = 'verified' then epoch_us(ts)::bigint end as verified_us from b where rn = 1""")
def w04(spark, root):
    records = load(spark, root, "events").select(
        F.col("event_type").alias("kind"), k().alias("event_key"), F.col("event_id").alias("obs_id"),
        F.when(F.col("value") > 20, "verified").otherwise("discovered").alias("evidence_status"),
        F.when(F.col("value") > 20, F.col("ts")).alias("verified_at"), F.col("ts").alias("collected_at"),
    )
    return windows.event_candidates(records, ["kind", "event_key"]).select(
        "kind", "event_key", "obs_id", "evidence_status", "observation_count",
        F.unix_micros("event_last_collected_at").alias("last_us"), F.unix_micros("last_verified_at").alias("verified_us"),
    )


@query("w05_representative", """
select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey
  order by case o_orderstatus when 'F' then 2 when 'P' then 1 else 0 end desc, o_orderdate desc, o_orderkey desc) = 1""")
def w05(spark, root):
    day = F.col("o_orderdate")
    events = load(spark, root, "orders").select(
        "o_custkey", "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", "available").when(F.col("o_orderstatus") == "P", "needs_evidence").otherwise("blocked").alias("selection_status"),
        day.alias("occurred_at"), F.lit(None).cast("date").alias("occurred_on"), day.alias("discovered_at"),
        F.lit(None).cast("timestamp").alias("last_verified_at"), day.alias("collected_at"),
    )
    return windows.representative(events, ["o_custkey"]).select("o_custkey", "o_orderkey")


@query("w06_rank", """
select o_orderkey, row_number() over (order by o_totalprice desc, o_orderkey)::bigint as rank from orders""")
def w06(spark, root):
    return windows.rank(load(spark, root, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey").select("o_orderkey", "rank")


@query("w07_feed_edges", """
select user_id, arg_min(event_id, (ts, event_id)) as newest_key, arg_max(event_id, (ts, event_id)) as oldest_key, count(*)::bigint as entry_count
from events group by user_id""")
def w07(spark, root):
    return windows.feed_edges(load(spark, root, "events"), "user_id", "event_id", ["ts", "event_id"])


@query("w08_take_budget", """
select lang, doc_id, used from (select lang, doc_id, sum(n_chars) over (partition by lang order by doc_id rows unbounded preceding)::bigint as used from documents) where used <= 60000""")
def w08(spark, root):
    docs = load(spark, root, "documents").select("lang", "doc_id", "n_chars")
    return windows.take_budget(docs, "n_chars", 60000, ["doc_id"], ["lang"]).select("lang", "doc_id", "used")


@query("w09_fair_share", """
with c as (select source, doc_id, length(text)::bigint as need, 100000 // count(*) over (partition by source) as share from documents),
b as (select *, least(need, share) as base from c),
p as (select *, 100000 - sum(base) over (partition by source) as room,
      coalesce(sum(need - base) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0) as asked from b)
select source, doc_id, (base + greatest(0, least(need - base, room - asked)))::bigint as granted from p""")
def w09(spark, root):
    docs = load(spark, root, "documents").select("source", "doc_id", F.length("text").alias("need"))
    return windows.fair_share(docs, "need", 100000, ["doc_id"], ["source"]).select("source", "doc_id", "granted")


@query("w10_watches", f"""
select {_K} as repository, event_id, user_id from events where event_type = 'purchase'
qualify row_number() over (partition by {_K} order by ts desc, event_id desc) = 1""")
def w10(spark, root):
    log = load(spark, root, "events").select(k().alias("repository"), "ts", "event_id", "user_id", "event_type")
    return windows.watches(log, "repository", ["ts", "event_id"], F.col("event_type") == "purchase").select("repository", "event_id", "user_id")


@query("w11_select_chunks", """
with d as (select source, doc_id, length(text)::bigint as n, len(list_intersect(['nicht', 'und', 'les', 'des', 'que'],
        list_distinct(regexp_extract_all(lower(text), '[a-z]+'))))::bigint as score from documents),
t as (select *, sum(n) over (partition by source, score > 0 order by score desc, doc_id rows unbounded preceding) as used,
      count(*) filter (where score > 0) over (partition by source) as hits from d)
select source, doc_id, hits = 0 as fallback from t
where case when hits = 0 then used <= 30000 when score > 0 then used <= 20000 else used <= 10000 end""")
def w11(spark, root):
    words = F.array(*[F.lit(w) for w in ("nicht", "und", "les", "des", "que")])
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)))
    lines = load(spark, root, "documents").select(
        "source", "doc_id", F.length("text").alias("n"), F.size(F.array_intersect(words, found)).alias("score")
    )
    return windows.select_chunks(lines, ["source"], "score", ["doc_id"], "n", 30000, 10000).select("source", "doc_id", "fallback")


@query("l01_top_n", """
select row_number() over (order by o_totalprice desc, o_orderkey)::bigint as rank, o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 100""")
def l01(spark, root):
    best = topk.top_n(load(spark, root, "orders").select("o_orderkey", "o_totalprice"), 100, [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()])
    return best.select(F.col("rank").cast("long").alias("rank"), "o_orderkey", "o_totalprice")


@query("l02_page", """
select c_custkey, row_number() over (order by c_name, c_custkey)::bigint as position, count(*) over ()::bigint as total,
  case when count(*) over () > 180 then 180::bigint end as next_offset, count(*) over () > 180 as truncated
from customer qualify position > 100 and position <= 180""")
def l02(spark, root):
    return topk.page(load(spark, root, "customer").select("c_custkey", "c_name"), ["c_name", "c_custkey"], 100, 80).drop("c_name")


@query("l03_rotating_page", """
with d as (select source, doc_id, lang, row_number() over (partition by source, lang order by doc_id) - 1 as p, count(*) over (partition by source, lang) as total from documents),
o as (select *, case when total > 8 then ('0x' || substr(sha256('["' || source || '","' || lang || '"]'), 1, 8))::bigint % total else 0 end as off from d),
r as (select *, (p - off + total) % total + 1 as position from o)
select source, lang, doc_id, total::bigint as total, off::bigint as "offset", position::bigint as position from r where position <= 8""")
def l03(spark, root):
    docs = load(spark, root, "documents").select("source", "lang", "doc_id")
    return topk.rotating_page(docs, ["source", "lang"], ["doc_id"], 8)


@query("l04_round_robin", f"""
with e as (select event_type as source, event_id, {_K} * 1000 + user_id as identity, value > 30 as is_known,
      row_number() over (partition by event_type order by event_id) as turn from events),
f as (select identity, arg_min((turn, source, is_known), (turn, source, is_known)) as m, string_agg(distinct source, ' ' order by source) as sources from e group by identity),
s as (select identity, m[1] as turn, m[2] as source, m[3] as is_known, sources from f),
c as (select *, sum(case when is_known then 0 else 1 end) over (order by turn, source, identity rows unbounded preceding) as n from s)
select identity, turn::bigint as turn, source, is_known, sources, n::bigint as new_so_far from c where is_known or n <= 2000""")
def l04(spark, root):
    items = load(spark, root, "events").select(
        F.col("event_type").alias("source"), F.col("event_id").alias("place"),
        (k() * 1000 + F.col("user_id")).alias("identity"), (F.col("value") > 30).alias("is_known"),
    )
    return topk.round_robin(items, 2000).withColumn("sources", F.array_join("sources", " "))


@query("l05_select_issue", """
with b as (select o_orderkey, o_custkey, o_totalprice, case when o_orderpriority = '5-LOW' then 'reading' else 'project' end as kind from orders where o_orderstatus = 'F'
  qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) = 1),
t as (select *, row_number() over (order by o_totalprice desc, o_orderkey) as rank from b)
select o_orderkey as candidate_id, o_custkey as event_url, rank::bigint as rank,
  kind <> 'reading' and sum(case when kind <> 'reading' then 1 else 0 end) over (order by rank rows unbounded preceding) <= 3 as featured
from t where rank <= 25""")
def l05(spark, root):
    accepted = load(spark, root, "orders").where("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("candidate_id"), F.col("o_totalprice").alias("total"), F.col("o_custkey").alias("event_url"),
        F.when(F.col("o_orderpriority") == "5-LOW", "reading").otherwise("project").alias("kind"),
    )
    return topk.select_issue(accepted, 25).select("candidate_id", "event_url", F.col("rank").cast("long").alias("rank"), "featured")


_L6 = """
with f as (select p_brand as repository, case p_type when 'SMALL' then 'license' when 'MEDIUM' then 'installation' else 'usage' end as question,
      case p_type when 'SMALL' then 'LICENSE' when 'MEDIUM' then 'setup' else 'usage' end as base, p_size, p_partkey from part),
g as (select repository, question, 'docs/' || p_size || '/' || p_partkey || '/' || base || '.md' as file_path from f),
"""


@query("l06_choose_documents", _L6 + """
k as (select *, [0, len(string_split(file_path, '/')), case when ends_with(file_path, 'LICENSE.md') then 0 else 1 end] as pk from g),
r as (select *, row_number() over (partition by repository, question order by pk, lower(file_path), file_path) as rq from k),
t as (select *, case when rq = 1 then case question when 'license' then 1 when 'installation' then 2 else 3 end else 4 end as turn from r)
select repository, question, file_path, row_number() over (partition by repository order by turn, pk, lower(file_path), file_path)::bigint as place from t qualify place <= 6""")
def l06(spark, root):
    kind = F.col("p_type")
    question = F.when(kind == "SMALL", "license").when(kind == "MEDIUM", "installation").otherwise("usage")
    base = F.when(kind == "SMALL", "LICENSE").when(kind == "MEDIUM", "setup").otherwise("usage")
    files = load(spark, root, "part").select(
        F.col("p_brand").alias("repository"), question.alias("question"),
        F.concat(F.lit("docs/"), F.col("p_size").cast("string"), F.lit("/"), F.col("p_partkey").cast("string"), F.lit("/"), base, F.lit(".md")).alias("file_path"),
    )
    return topk.choose_documents(files, 6)


@query("l07_choose_files", """
with f as (select p_brand as repository, case when p_size > 25 then 'src/' else 'pkg/' end || p_partkey || '/' ||
      case p_type when 'SMALL' then 'main.py' when 'MEDIUM' then 'tests/a.py' when 'LARGE' then 'b.test.ts' when 'PROMO' then 'c.md' else 'd.go' end as path from part),
u as (select * from f where path like '%main.py' or path like '%d.go')
select repository, path, row_number() over (partition by repository order by case when path like '%main.py' then 0 else 1 end,
   case when starts_with(path, 'src/') then 0 else 1 end, path)::bigint as place from u qualify place <= 6""")
def l07(spark, root):
    kind = F.col("p_type")
    name = (
        F.when(kind == "SMALL", "main.py").when(kind == "MEDIUM", "tests/a.py").when(kind == "LARGE", "b.test.ts")
        .when(kind == "PROMO", "c.md").otherwise("d.go")
    )
    paths = load(spark, root, "part").select(
        F.col("p_brand").alias("repository"),
        F.concat(F.when(F.col("p_size") > 25, "src/").otherwise("pkg/"), F.col("p_partkey").cast("string"), F.lit("/"), name).alias("path"),
    )
    return topk.choose_files(paths)


@query("l07_focus_files", """
with f as (select p_brand as repository, case p_type when 'SMALL' then 'README.md' when 'MEDIUM' then 'go.mod' else 'src/x.go' end as n, p_partkey, p_size * 50000 as size from part),
g as (select repository, p_partkey || '/' || n as path, n in ('README.md', 'go.mod') as pref, size from f where size <= 2097152)
select repository, path, size, row_number() over (partition by repository order by case when pref then 0 else 1 end, lower(path), path)::bigint as place from g qualify place <= 100""")
def l07f(spark, root):
    name = F.when(F.col("p_type") == "SMALL", "README.md").when(F.col("p_type") == "MEDIUM", "go.mod").otherwise("src/x.go")
    files = load(spark, root, "part").select(
        F.col("p_brand").alias("repository"), F.concat(F.col("p_partkey").cast("string"), F.lit("/"), name).alias("path"),
        (F.col("p_size") * 50000).alias("size"),
    )
    return topk.focus_files(files)


@query("l08_ranked_groups", """
with o as (select o_orderkey, case o_orderstatus when 'O' then 'blocked' when 'P' then 'needs_evidence' else 'available' end as eligibility,
   case o_orderpriority when '1-URGENT' then 'select' when '2-HIGH' then 'reject' when '3-MEDIUM' then 'defer' when '4-NOT SPECIFIED' then 'select' end as decision,
   o_totalprice::bigint as total, 'https://h/' || o_custkey as canonical_url from orders),
g as (select *, case when eligibility = 'blocked' then 'blocked' when decision is null then 'unreviewed' when eligibility = 'needs_evidence' then 'needs_evidence'
   when decision = 'defer' then 'deferred' when decision = 'reject' then 'rejected' else 'available' end as "group" from o)
select o_orderkey as candidate_id, "group", row_number() over (partition by "group" order by total desc, canonical_url, o_orderkey)::bigint as place from g""")
def l08(spark, root):
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    reviewed = load(spark, root, "orders").select(
        F.col("o_orderkey").alias("candidate_id"),
        F.when(status == "O", "blocked").when(status == "P", "needs_evidence").otherwise("available").alias("eligibility"),
        F.when(priority.isin("1-URGENT", "4-NOT SPECIFIED"), "select").when(priority == "2-HIGH", "reject").when(priority == "3-MEDIUM", "defer").alias("decision"),
        F.round("o_totalprice").cast("long").alias("total"), F.concat(F.lit("https://h/"), F.col("o_custkey").cast("string")).alias("canonical_url"),
    )
    return topk.ranked_groups(reviewed).select("candidate_id", "group", "place")


@query("l09_oldest_pending", """
with d as (select strftime(o_orderdate, '%Y-%m') as period, count(*)::bigint as item_count from orders where o_orderstatus = 'P' group by 1)
select period, item_count, greatest(0, 2000 - item_count)::bigint as shortfall from d order by period limit 1""")
def l09(spark, root):
    drafts = load(spark, root, "orders").where("o_orderstatus = 'P'").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("period")).agg(F.count(F.lit(1)).alias("item_count"))
    return topk.oldest_pending(drafts, "period", 2000)


@query("u01_union_sources", """
select c_custkey as key, c_name as name, c_acctbal as balance, c_mktsegment as segment from customer
union all select s_suppkey, s_name, s_acctbal, null from supplier""")
def u01(spark, root):
    customers = load(spark, root, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    suppliers = load(spark, root, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return sets.union_sources(customers, suppliers)


@query("u02_merge_accepted", """
with prior as (select o_orderkey from orders where o_orderdate < timestamp '1998-01-01'),
d as (select o_orderkey, case when o_orderstatus = 'F' then 'accept' else 'reject' end as decision from orders where o_orderdate >= timestamp '1997-01-01')
select o_orderkey from prior where o_orderkey not in (select o_orderkey from d where decision = 'reject')
union select o_orderkey from d where decision = 'accept'""")
def u02(spark, root):
    orders = load(spark, root, "orders")
    prior = orders.where("o_orderdate < timestamp'1998-01-01'").select("o_orderkey")
    decided = orders.where("o_orderdate >= timestamp'1997-01-01'").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", "accept").otherwise("reject").alias("decision")
    )
    return sets.merge_accepted(prior, decided, "o_orderkey")


@query("u03_pending_feedback", f"""
with s as (select {_K} * 100 + user_id % 100 as run_id, max(event_id) as event_id from events where event_type = 'purchase' group by 1)
select run_id, event_id from s where run_id not in (select {_K} * 100 + user_id % 100 from events where event_type = 'click')""")
def u03(spark, root):
    runs = load(spark, root, "events").withColumn("run_id", k() * 100 + F.col("user_id") % 100)
    done = runs.where("event_type = 'purchase'").groupBy("run_id").agg(F.max("event_id").alias("event_id"))
    return sets.pending(done, runs.where("event_type = 'click'"), "run_id")


@query("u04_subset_and_same_set", """
with a as (select distinct doc_id from documents), b as (select distinct doc_id from labels)
select (select count(*) from a where doc_id not in (select doc_id from b))::bigint as only_left,
       (select count(*) from b where doc_id not in (select doc_id from a))::bigint as only_right,
       not exists (select 1 from a where doc_id not in (select doc_id from b)) and not exists (select 1 from b where doc_id not in (select doc_id from a)) as same""")
def u04(spark, root):
    return sets.same_set(load(spark, root, "documents"), load(spark, root, "labels"), ["doc_id"])


@query("u05_split_leaks", """
with l as (select d.source as identity, case when l.toxic = 1 then 'holdout' else 'dev' end as split from labels l join documents d using (doc_id))
select identity, min(split) as first_split, max(split) as last_split from l group by 1 having min(split) <> max(split)""")
def u05(spark, root):
    labelled = load(spark, root, "labels").join(load(spark, root, "documents").select("doc_id", "source"), "doc_id").select(
        F.col("source").alias("identity"), F.when(F.col("toxic") == 1, "holdout").otherwise("dev").alias("split")
    )
    return sets.split_leaks(labelled, "identity")
