"""Streaming jobs run over the given tables with `availableNow`; the result is the final table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from curator.catalog.registry import query
from curator.runtime import configure, load, scratch_path
from curator.streaming import core, jobs

_K = "cast(json_extract(props, '$.k') as bigint)"


def k():
    return F.get_json_object("props", "$.k").cast("long")


def stream(spark, root, name):
    configure(spark)
    # A pattern, because the file source takes a folder or a pattern, not one file.
    return core.read_stream(spark, f"{root}/{name}.parque[t]")


def places(spark, label):
    base = scratch_path(spark, label)
    return f"{base}/table", f"{base}/checkpoint"


@query("t01_stream_ingest", f"""
select user_id * 1000 + {_K} as run_id, min(event_type) as content from events group by 1""")
def t01(spark, root):
    path, checkpoint = places(spark, "ingest")
    rows = stream(spark, root, "events").select((F.col("user_id") * 1000 + k()).alias("run_id"), F.col("event_type").alias("content"))
    jobs.stream_ingest(rows, path, checkpoint, "run_id", "content")
    return spark.read.parquet(f"{path}/log").select("run_id", "content")


@query("t01_ingest_conflicts", f"""
with e as (select distinct user_id * 1000 + {_K} as run_id, event_type as content from events)
select run_id, content, min(content) over (partition by run_id) as recorded_hash from e qualify content <> recorded_hash""")
def t01c(spark, root):
    path, checkpoint = places(spark, "ingest")
    rows = stream(spark, root, "events").select((F.col("user_id") * 1000 + k()).alias("run_id"), F.col("event_type").alias("content"))
    jobs.stream_ingest(rows, path, checkpoint, "run_id", "content")
    return spark.read.parquet(f"{path}/conflicts").select("run_id", "content", "recorded_hash")


@query("t02_first_seen", "select user_id, epoch_us(min(ts))::bigint as first_us, arg_min(event_id, (ts, event_id)) as event_id from events group by 1")
def t02(spark, root):
    path, checkpoint = places(spark, "first-seen")
    jobs.stream_first_seen(stream(spark, root, "events"), path, checkpoint, ["user_id"], "ts", ["event_id"])
    return core.latest_rows(spark, path, ["user_id"]).select("user_id", F.unix_micros("ts").alias("first_us"), "event_id")


@query("t03_gaps", f"""
with p as (select event_type as source, ts::date as day from events group by 1, 2), l as (select *, row_number() over (partition by source order by day) as n from p)
select source as source_id, strftime(day, '%Y-%m-%d') as day, n > 1 and (n % 3 = 0 or n % 5 = 0) as has_gap,
  case when n = 1 then '' when n % 3 = 0 then 'no_ledger_overlap' when n % 5 = 0 then 'feed_window_after_last_success' else '' end as reason from l""")
def t03(spark, root):
    # One poll per event type and day lists that day's first and last event, and the last ones of the three days before: every third
    # poll lists none of those, every fifth knows no time of theirs.
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    days = load(spark, root, "events").groupBy(F.col("event_type").alias("source_id"), F.to_date("ts").cast("string").alias("day")).agg(
        F.max_by(F.col("event_id").cast("string"), "ts").alias("newest_key"), F.min_by(F.col("event_id").cast("string"), "ts").alias("oldest_key"),
        stamp(F.max("ts")).alias("newest_at"), stamp(F.min("ts")).alias("oldest_at"))
    order = Window.partitionBy("source_id").orderBy("day")
    n = F.row_number().over(order)
    entry = lambda key, at: F.struct(key.alias("key"), at.alias("published_at"))
    before = F.collect_list(entry(F.col("newest_key"), F.col("newest_at"))).over(order.rowsBetween(-3, -1))
    known = F.when(n % 3 == 0, F.slice(before, 1, 0)).when(n % 5 == 0, F.transform(before, lambda e: entry(e["key"], F.lit(None).cast("string")))).otherwise(before)
    own = F.array(entry(F.col("newest_key"), F.col("newest_at")), entry(F.col("oldest_key"), F.col("oldest_at")))
    polls = days.select("source_id", F.concat("day", F.lit("T23:59:59")).alias("polled_at"), F.concat(own, known).alias("entries"), F.lit(False).alias("backfilled"))
    base = scratch_path(spark, "gaps")
    polls.write.parquet(f"{base}/polls")
    jobs.stream_gaps(core.read_stream(spark, f"{base}/polls"), f"{base}/table", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/table").select("source_id", F.substring("polled_at", 1, 10).alias("day"), "has_gap", "reason")


@query("t03_backfilled_gaps", """
with p as (select event_type as source, ts::date as day from events group by 1, 2), l as (select *, row_number() over (partition by source order by day) as n from p)
select source as source_id, strftime(day, '%Y-%m-%d') as day, n > 1 and n % 3 <> 0 as has_gap,
  case when n = 1 or n % 3 = 0 then '' when n % 3 = 1 then 'rest_backfill_unclosed' else 'rest_backfill_failed: timeout' end as reason from l
union all select source, strftime(day, '%Y-%m-%d'), true, 'baseline_not_established' from l where n = 1""")
def t03b(spark, root):
    # One poll per event type and day, none of which overlaps; every third backfill closes, the others don't or fail.
    days = load(spark, root, "events").groupBy(F.col("event_type").alias("source_id"), F.to_date("ts").cast("string").alias("day")).agg(F.min("event_id").alias("first"))
    n = F.row_number().over(Window.partitionBy("source_id").orderBy("day"))
    polls = days.select(
        "source_id", F.concat("day", F.lit("T23:59:59")).alias("polled_at"),
        F.array(F.struct(F.col("first").cast("string").alias("key"), F.concat("day", F.lit("T00:00:00")).alias("published_at"))).alias("entries"),
        F.when(n % 3 == 0, "closed").when(n % 3 == 1, "unclosed").otherwise("timeout").alias("backfill"), (n > 1).alias("baseline"))
    base = scratch_path(spark, "gaps")
    polls.write.parquet(f"{base}/polls")
    jobs.stream_gaps(core.read_stream(spark, f"{base}/polls"), f"{base}/table", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/table").select("source_id", F.substring("polled_at", 1, 10).alias("day"), "has_gap", "reason")


def _periods(name, ranking_type, sql):
    @query(name, f"select {sql} as period, event_type, count(*)::bigint as n from events group by 1, 2")
    def run(spark, root):
        path, checkpoint = places(spark, "periods")
        jobs.stream_periods(stream(spark, root, "events"), path, checkpoint, "ts", ranking_type, ["event_type"])
        return core.latest_rows(spark, path, ["period", "event_type"])

    return run


_periods("t04_daily_periods", "daily", "strftime((ts + interval 8 hour)::date, '%Y-%m-%d')")
_periods("t04_weekly_periods", "weekly", "strftime(date_trunc('week', ts + interval 8 hour)::date, '%Y-%m-%d')")
_periods("t04_monthly_periods", "monthly", "strftime(ts + interval 8 hour, '%Y-%m')")


@query("t05_lifecycle", """
with f as (select *, row_number() over (partition by o_custkey order by o_orderkey) as n from orders)
select o_custkey::varchar as release_key, o_orderkey as seq,
  case when n = 1 then 'pending_review' when n = 2 and o_custkey % 2 = 0 then 'accepted' when n = 2 then 'rejected' when n = 3 then 'filtered' else 'withdrawn' end as status,
  case when n < 3 then '1' else '2' end as policy_version from f where n <= 3 or (n = 5 and o_custkey % 3 = 0)""")
def t05(spark, root):
    # Per customer: a record waits for review, is decided, re-opens under another policy, is past deciding, and (where
    # it is a security item) re-opens with other content; nothing later changes anything.
    base = scratch_path(spark, "lifecycle")
    numbered = load(spark, root, "orders").select(
        "o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("n"))
    numbered.write.parquet(f"{base}/records")
    n = F.col("n")
    rows = core.read_stream(spark, f"{base}/records").select(
        F.col("o_custkey").cast("string").alias("release_key"), F.col("o_orderkey").alias("seq"),
        F.when(n.isin(2, 4), "decision").otherwise("record").alias("event"),
        F.when(n == 1, "pending_review").when(n == 2, F.when(F.col("o_custkey") % 2 == 0, "accept").otherwise("reject")).when(n == 3, "filtered")
        .when(n == 4, "accept").otherwise("withdrawn").alias("verdict"),
        F.when(n < 3, "1").otherwise("2").alias("policy_version"), F.when(n < 5, "h").otherwise("i").alias("content_hash"),
        F.when(F.col("o_custkey") % 3 == 0, "security").otherwise("release").alias("item_type"),
    )
    jobs.stream_ledger(rows, f"{base}/table", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/table")


@query("t06_lookback", """
with s as (select event_type, case when event_type in ('click', 'view') then 168 else 48 end as h from (select distinct event_type from events))
select event_id, h::bigint as lookback_hours from events join s using (event_type) where ts <= timestamp '2024-01-20' and ts >= timestamp '2024-01-20' - to_hours(h)""")
def t06(spark, root):
    path, checkpoint = places(spark, "lookback")
    # Clicks and views failed shortly before; errors failed too long ago.
    state = load(spark, root, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).select(
        "event_type", F.when(F.col("event_type").isin("click", "view", "error"), "failed").otherwise("ok").alias("status"),
        F.when(F.col("event_type") == "error", F.lit("2024-01-02").cast("timestamp")).otherwise(F.lit("2024-01-18").cast("timestamp")).alias("completed_at"),
    )
    jobs.stream_lookback(stream(spark, root, "events"), state, path, checkpoint, "event_type", "ts", F.lit("2024-01-20").cast("timestamp"))
    return spark.read.parquet(path).select("event_id", F.col("lookback_hours").cast("long").alias("lookback_hours"))


@query("t07_late_labels", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, strftime(o_orderdate + interval 8 hour, '%Y-%m') as event_period,
  case when (l_shipdate + interval 8 hour)::date < date '1998-03-01' then '往期候选' when (l_shipdate + interval 8 hour)::date > date '1998-03-31' then '原期事件补采' else '新发现' end as period_label
from lineitem join orders on l_orderkey = o_orderkey""")
def t07(spark, root):
    path, checkpoint = places(spark, "late")
    orders = load(spark, root, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    joined = stream(spark, root, "lineitem").join(orders, "l_orderkey")
    jobs.stream_late_label(joined, path, checkpoint, "o_orderdate", "l_shipdate", F.lit("1998-03-01").cast("date"), F.lit("1998-03-31").cast("date"))
    return spark.read.parquet(path).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "event_period", "period_label")


@query("t08_suppress", """
select event_id from events a where event_type = 'view' and not exists (select 1 from events b where b.event_type = 'purchase' and b.user_id = a.user_id and b.ts < a.ts and b.ts >= a.ts - interval 14 day)""")
def t08(spark, root):
    path, checkpoint = places(spark, "suppress")
    log = load(spark, root, "events").where("event_type = 'purchase'").select("user_id", "ts")
    asked = stream(spark, root, "events").where("event_type = 'view'").select("event_id", "user_id", "ts")
    jobs.stream_suppress(asked, log, path, checkpoint, "user_id", "ts", 14)
    return spark.read.parquet(path).select("event_id")


@query("t08_suppress_growing", """
select event_id from events a where event_type <> 'error' and not exists (select 1 from events b where b.event_type = 'error' and b.user_id = a.user_id and b.ts < a.ts and b.ts >= a.ts - interval 5 day)""")
def t08g(spark, root):
    # The log of errors grows beside the events that they suppress; rows far ahead on both sides let the watermarks pass the last ones.
    base, events = scratch_path(spark, "growing"), load(spark, root, "events")
    sides = {"asked": events.where("event_type <> 'error'").select("event_id", "user_id", "ts"), "log": events.where("event_type = 'error'").select("user_id", "ts")}
    for step, year in enumerate((None, 2032, 2036)):
        for name, rows in sides.items():
            ahead = spark.range(1).select(*[F.lit(-1).cast("long").alias(c) for c in rows.columns if c != "ts"], F.lit(f"{year}-01-01").cast("timestamp").alias("ts"))
            (rows if year is None else ahead).select(rows.columns).write.parquet(f"{base}/{name}/part={step}")
        streams = [spark.readStream.schema(rows.schema).parquet(f"{base}/{name}/part=*") for name, rows in sides.items()]
        jobs.stream_suppress_growing(*streams, f"{base}/table", f"{base}/checkpoint", "user_id", "ts", 5, late="400 days")
    return spark.read.parquet(f"{base}/table").where("event_id >= 0").select("event_id")


@query("t09_notices", f"""
select event_type as issue_key, count(distinct (least({_K}, user_id), greatest({_K}, user_id)))::bigint as notices from events group by 1""")
def t09(spark, root):
    path, checkpoint = places(spark, "notices")
    text = lambda c: c.cast("string")
    rows = stream(spark, root, "events").select(
        F.col("event_type").alias("issue_key"), F.array(text(k()), text(F.col("user_id")), text(k())).alias("items"), F.array().cast("array<string>").alias("failures"), "ts"
    )
    # Remembered for longer than the table lasts: each notice is sent once.
    jobs.stream_notices(rows, path, checkpoint, "ts", "400 days")
    return spark.read.parquet(path).groupBy("issue_key").agg(F.count(F.lit(1)).alias("notices"))
