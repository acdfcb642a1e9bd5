"""Query of the discovery contract: groups of orders stand in for runs, their lines for candidates and deep reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from curator.catalog.registry import query
from curator.operators.provenance import validate_provenance
from curator.runtime import dealt, load

_TABLES = """
with lines as (select l_orderkey // 16 as run_id, 'o/r' || l_suppkey as repository, l_partkey as p, l_quantity as q, l_linestatus as s from lineitem),
runs as (select o_orderkey // 16 as run_id, min(o_custkey) as c from orders group by 1),
queries as (select o_orderkey // 16 as run_id, case when o_custkey % 11 = 0 then ' ' when o_custkey % 13 = 0 then repeat('q', 501) else o_orderpriority end as query,
  case when o_custkey % 17 = 0 then null when o_custkey % 5 = 0 then 'adjacent' else 'direct' end as lane from orders where o_orderstatus <> 'P'),
candidates as (select run_id, repository, p, case when p % 17 = 0 then 'other/x' when p % 19 = 0 then repository || '/releases/tag/v1' else repository end as page,
  case when q = 1 then 'odd' when q > 44 then 'adjacent' else 'direct' end as lane, case when q = 2 then null when q = 3 then 1001 else 10 end as n from lines where s = 'O'),
reads as (select run_id, repository from lines where q > 42),
picked as (select r.run_id, case when c % 8 = 0 then 'o/none' when c % 7 <> 0 then d.one end as selected, case when c % 9 = 0 then 'gitlab.com' else 'github.com' end as host, case when c % 6 = 0 then 'o/r1' else d.one end as target
  from runs r left join (select run_id, min(repository) as one from reads group by 1) d using (run_id)),
sizes as (select p.*, coalesce(q.n, 0) as nq, coalesce(c.n, 0) as nc, coalesce(c.direct, 0) as direct, coalesce(c.adjacent, 0) as adjacent, coalesce(d.n, 0) as nd
  from picked p left join (select run_id, count(*) as n from queries group by 1) q using (run_id)
  left join (select run_id, count(*) as n, count(*) filter (lane = 'direct') as direct, count(*) filter (lane = 'adjacent') as adjacent from candidates group by 1) c using (run_id)
  left join (select run_id, count(*) as n from reads group by 1) d using (run_id))"""


@query("v01_provenance", _TABLES + """
select run_id, 'search_queries' as path, 'count' as code from sizes where nq not between 1 and 5
union all select run_id, 'screened_candidates', 'count' from sizes where nc not between 1 and 20
union all select run_id, 'deep_read_repositories', 'count' from sizes where nd not between 1 and 5
union all select run_id, 'screened_candidates', 'adjacent_share' from sizes where adjacent > 0 and direct < 4 * adjacent
union all select run_id, 'selected_repository', 'required' from sizes where selected is null
union all select run_id, 'url', 'unsupported' from sizes where host <> 'github.com' or target is null
union all select run_id, 'selected_repository', 'other_target' from sizes where host = 'github.com' and selected <> target
union all select run_id, 'selected_repository', 'not_read' from sizes z where selected is not null and not exists (select 1 from reads d where d.run_id = z.run_id and d.repository = z.selected)
union all select run_id, 'screened_candidates', 'identity' from candidates where page <> repository
union all select run_id, 'screened_candidates', 'lane' from candidates where lane = 'odd'
union all select run_id, 'screened_candidates', 'description' from candidates where n is null or n > 1000
union all select run_id, 'search_queries', 'query' from queries where trim(query) = '' or length(query) > 500
union all select run_id, 'search_queries', 'lane' from queries where lane is null
union all select run_id, 'deep_read_repositories', 'not_screened' from reads d where not exists (select 1 from candidates c where c.run_id = d.run_id and c.repository = d.repository)
union all select run_id, 'screened_candidates', 'repeated' from candidates group by run_id, repository having count(*) > 1
union all select run_id, 'deep_read_repositories', 'repeated' from reads group by run_id, repository having count(*) > 1""")
def v01p(spark, root):
    run = lambda c: F.floor(F.col(c) / 16)
    lines, orders = dealt("run_id", *(load(spark, root, t).withColumn("run_id", run(c)) for t, c in (("lineitem", "l_orderkey"), ("orders", "o_orderkey"))))
    customer = F.col("o_custkey")
    lines = lines.select(
        "run_id", F.concat(F.lit("o/r"), F.col("l_suppkey").cast("string")).alias("repository"), F.col("l_partkey").alias("p"), F.col("l_quantity").alias("q"), "l_linestatus")
    queries = orders.where("o_orderstatus <> 'P'").select(
        "run_id", F.when(customer % 11 == 0, " ").when(customer % 13 == 0, F.repeat(F.lit("q"), 501)).otherwise(F.col("o_orderpriority")).alias("query"),
        F.when(customer % 17 == 0, None).when(customer % 5 == 0, "adjacent").otherwise("direct").alias("lane"))
    page = F.when(F.col("p") % 17 == 0, "other/x").when(F.col("p") % 19 == 0, F.concat("repository", F.lit("/releases/tag/v1"))).otherwise(F.col("repository"))
    candidates = lines.where("l_linestatus = 'O'").select(
        "run_id", "repository", F.concat(F.lit("https://github.com/"), page).alias("url"), F.when(F.col("q") == 1, "odd").when(F.col("q") > 44, "adjacent").otherwise("direct").alias("lane"),
        F.when(F.col("q") == 2, None).when(F.col("q") == 3, F.repeat(F.lit("d"), 1001)).otherwise("d").alias("description"))
    reads = lines.where("q > 42").select("run_id", "repository")
    first = F.min("o_custkey").alias("c")
    runs = orders.groupBy("run_id").agg(first).join(reads.groupBy("run_id").agg(F.min("repository").alias("one")), "run_id", "left").select(
        "run_id", F.concat(F.when(F.col("c") % 9 == 0, "https://gitlab.com/").otherwise("https://github.com/"), F.when(F.col("c") % 6 == 0, "o/r1").otherwise(F.col("one"))).alias("url"),
        F.when(F.col("c") % 8 == 0, "o/none").when(F.col("c") % 7 != 0, F.col("one")).alias("selected_repository"))
    return validate_provenance(runs, queries, candidates, reads).drop("message")
