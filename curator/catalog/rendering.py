"""Queries of whole articles and reports: orders stand in for issues, their lines for items, sources and collection days."""

from __future__ import annotations

from pyspark.sql import functions as F

from curator import constants as K
from curator.catalog.registry import query
from curator.runtime import dealt, load
from curator.sinks.article import article_lines, information_lines

_CATEGORIES = "[" + ", ".join(f"'{c}'" for c in K.CATEGORIES) + "]"
_KINDS = "[" + ", ".join(f"'{c}'" for c in K.KINDS) + "]"


def _blocks(*texts: str) -> str:
    """A list of lines: each text (an SQL expression) and a blank line."""
    return "list_concat(" * (len(texts) - 1) + ", ".join([f"[{texts[0]}, '']", *[f"[{t}, ''])" for t in texts[1:]]])


def _optional(condition: str, text: str) -> str:
    return f"(case when {condition} then [{text}, ''] else [] end)"


def _join(*lists: str) -> str:
    return "flatten([" + ", ".join(lists) + "])"


def _unnest(section: str, place: str, body: str, source: str) -> str:
    return (f"select issue_id, {section} as section, ({place})::bigint as place, unnest(range(len(b)))::int as line_no, unnest(b) as line "
            f"from (select *, {body} as b from {source})")


_LOCAL = "strftime({} + interval 8 hour, '%Y-%m-%d')"

_ITEM = _join(
    "['### ' || case when featured then '★ ' else '' end || title, '']", "['s' || place, '']", "[reason, '']",
    "[case when kind = 'news' then '影响人群' else '适合' end || '：devs。' || case when kind = 'news' then '适用范围与行动' else '使用条件' end || '：free', '']",
    _optional("level = 'weekly'", "'detail ' || place"), _optional("level = 'monthly'", "'值得保留：keep'"), _optional("kind = 'update'", "'重要更新：changed'"),
    _optional("kind = 'reading'", "'作者／受访者：A；原文日期：2024-01-01。'"),
    _optional("kind = 'news'", f"'新闻事件日期：' || case when p % 3 = 0 then '2024-01-02（原文仅日期，时区未知；未确认具体时刻）' else {_LOCAL.format('ship')} end || '。'"),
    f"['[' || title || ' 官方入口](' || url || ') · 新发现；首次发现 ' || {_LOCAL.format('ship')} || '；真实发布时间 ' || case p % 3 when 0 then '未确认' when 1 then '2024-01-03' else '2024-01-02' end || '。', '']",
    f"['核验：' || case when kind = 'news' and p % 2 = 0 then '已核对原始新闻资料' when p % 2 = 0 then '已读原始文档，未作本机实测结论' else '已本机实测' end || '；核验日期 ' || {_LOCAL.format('ship')} || '；实际采集 ' || {_LOCAL.format('ship')} || '。', '']",
    "['资料：[原始资料 1](https://a/' || p || ') / [原始资料 2](https://b)', '']")

_ARTICLE = f"""
with issues as (select o_orderkey as issue_id, o_orderstatus = 'P' as draft, ['daily', 'weekly', 'monthly'][(o_orderkey % 3 + 1)::int] as level, strftime(o_orderdate, '%Y-%m-%d') as period, o_orderdate as prepared, o_custkey as c from orders),
items as (select l_orderkey as issue_id, l_linenumber as place, l_partkey as p, (l_partkey % 8 + 1)::int as section, {_CATEGORIES}[(l_partkey % 8 + 1)::int] as category, {_KINDS}[(l_suppkey % 4 + 1)::int] as kind,
  l_quantity > 40 as featured, 'T' || l_partkey as title, 'https://h/' || l_partkey as url, 'r' || l_suppkey || '。' as reason, l_shipdate as ship, level from lineitem join issues on l_orderkey = issue_id),
sources as (select l_orderkey as issue_id, l_linenumber as place, 'S' || l_suppkey as name, case when l_returnflag = 'R' then 'failed' else 'ok' end as status, 'd' || l_partkey as detail from lineitem),
days as (select l_orderkey as issue_id, strftime(l_shipdate, '%Y-%m-%d') as day, l_discount > 0.08 as later, l_quantity < 5 as gone from lineitem),
starred as (select issue_id, string_agg(t, '；' order by section, place, t) as starred from (select issue_id, '[' || title || '](' || url || ')：' || rtrim(reason, '。；; ') as t, min((section, place)) as o, o[1] as section, o[2] as place from items where featured group by 1, 2) group by 1),
themes as (select issue_id, string_agg(category, ' / ' order by section) as themes from (select distinct issue_id, section, category from items) group by 1),
failed as (select issue_id, string_agg(name || '：' || detail, '；' order by place, name, detail) as failures from sources where status = 'failed' group by 1),
dates as (select issue_id, string_agg(distinct day, '、' order by day) filter (not later) as dates, string_agg(distinct day, '、' order by day) filter (later) as later, string_agg(distinct day, '、' order by day) filter (gone) as gaps from days group by 1),
facts as (select i.*, coalesce(n, 0) as n, starred, themes, failures, dates, later, gaps from issues i left join (select issue_id, count(*) as n from items group by 1) using (issue_id)
  left join starred using (issue_id) left join themes using (issue_id) left join failed using (issue_id) left join dates using (issue_id)),
chances as (select l_orderkey as issue_id, l_linenumber as place, l_partkey as p from lineitem where l_quantity = 50)
{_unnest("0", "0", _join(
    _blocks("'# Issue ' || issue_id",
            "case when draft then '草稿 · ' else '' end || case level when 'daily' then '日榜' when 'weekly' then '周榜' else '月榜' end || ' ' || period || ' · 北京时间 ' || period || ' 至 ' || period",
            "'实际整理：' || " + _LOCAL.format("prepared") + " || '；精选 ' || n || ' 条。'"),
    _optional("c % 2 = 0", "'数量说明：few'"), _optional("starred is not null", "'重点推荐：' || starred || '。'"), _optional("themes is not null", "'本期栏目：' || themes")), "facts")}
union all {_unnest("section", "-1", "['## ' || category, '']", "(select distinct issue_id, section, category from items)")}
union all {_unnest("section", "place", _ITEM, "items")}
union all {_unnest("9", "-1", "['## 开发机会观察（不计入精选条数）', '']", "(select distinct issue_id from chances)")}
union all {_unnest("9", "place", _blocks("'problem ' || p", "'人群：devs；已有方案：none。'", "'验证切口：try'", "'用户问题资料（2024-01-01）：[原文 1](https://q/' || p || ')'"), "chances")}
union all {_unnest("10", "-2", _join(
    _blocks("'## 来源与核验说明'", "'note ' || c", "'实际初筛：' || case when c % 3 = 0 then c::varchar else '未单独记录' end || '；深入核验：5；入选：' || n || '。'",
            "'本期实际采集日期：' || coalesce(dates, '无') || '。'", "'缺少采集的日期：' || coalesce(gaps, '无') || '（检查截至 ' || period || '）。'"),
    _optional("later is not null", "'期后核验／补采实际日期：' || later || '。不改写原期采集覆盖。'")), "facts")}
union all {_unnest("10", "-1", "['实际来源状态：', '']", "(select distinct issue_id from sources)")}
union all {_unnest("10", "place", "['- [' || name || '](https://s/' || name || ')：' || status || '；' || detail]", "sources")}
union all {_unnest("10", str(1 << 62), _join("case when issue_id in (select issue_id from sources) then [''] else [] end", _blocks("'来源失败：' || coalesce(failures, '本次记录中无失败；不代表未访问来源可用') || '。'")), "facts")}"""


def _text(name: str, *parts) -> F.Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]).alias(name)


@query("k02_issue_article", _ARTICLE)
def k02a(spark, root):
    orders, lines = load(spark, root, "orders"), load(spark, root, "lineitem")
    n, part = F.col("o_custkey"), F.col("l_partkey")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    pick = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))
    issue, place = F.col("l_orderkey").alias("issue_id"), F.col("l_linenumber").alias("place")
    issues = orders.select(
        F.col("o_orderkey").alias("issue_id"), (F.col("o_orderstatus") == "P").alias("draft"), _text("title", "Issue ", F.col("o_orderkey")),
        pick(K.RANKINGS, F.col("o_orderkey") % 3).alias("ranking_type"), day("o_orderdate").alias("period"), day("o_orderdate").alias("window_start"),
        day("o_orderdate").alias("window_end"), F.col("o_orderdate").cast("timestamp").alias("prepared_at"), F.when(n % 2 == 0, "few").alias("shortfall_reason"),
        _text("verification_note", "note ", n), F.when(n % 3 == 0, n).alias("screened_count"), F.lit(5).alias("verified_count"), day("o_orderdate").alias("checked_through"))
    shipped = F.col("l_shipdate").cast("timestamp")
    # Items go to their issues as rows of numbers; their texts are made there.
    items = dealt("l_orderkey", lines)[0].select(
        issue, place, pick(K.CATEGORIES, part % 8).alias("category"), pick(K.KINDS, F.col("l_suppkey") % 4).alias("kind"), (F.col("l_quantity") > 40).alias("featured"),
        _text("title", "T", part), _text("url", "https://h/", part), _text("summary", "s", F.col("l_linenumber")), _text("reason", "r", F.col("l_suppkey"), "。"),
        F.lit("devs；").alias("audience"), F.lit("free").alias("usage_conditions"), _text("detail", "detail ", F.col("l_linenumber")), F.lit("keep").alias("retention_reason"),
        F.lit("changed").alias("change_note"), F.lit(None).cast("string").alias("supported_systems"), F.lit("A").alias("author"), F.lit("2024-01-01").alias("original_date"),
        F.lit(None).cast("string").alias("event_url"), F.when(part % 3 == 0, "2024-01-02").alias("event_on"), shipped.alias("event_at"), F.lit("新发现").alias("period_label"),
        shipped.alias("first_discovered_at"), F.when(part % 3 == 1, "2024-01-02T20:00:00Z").when(part % 3 == 2, "2024-01-02").alias("published_at"),
        F.when(part % 2 == 0, "documented").otherwise("tested").alias("verification_level"), shipped.alias("verified_at"), shipped.alias("collected_at"),
        F.array(_text("u", "https://a/", part), F.lit("https://b")).alias("evidence_urls"))
    chances = lines.where("l_quantity = 50").select(
        issue, place, _text("problem", "problem ", part), F.lit("devs").alias("audience"), F.lit("none").alias("existing_solutions"), F.lit("try").alias("validation"),
        F.lit("2024-01-01").alias("evidence_date"), F.array(_text("u", "https://q/", part)).alias("evidence_urls"))
    sources = lines.select(
        issue, place, _text("name", "S", F.col("l_suppkey")), _text("url", "https://s/S", F.col("l_suppkey")),
        F.when(F.col("l_returnflag") == "R", "failed").otherwise("ok").alias("status"), _text("detail", "d", part))
    days = lines.select(issue, day("l_shipdate").alias("collection_date"), (F.col("l_discount") > 0.08).alias("supplemental"), "l_quantity")
    return article_lines(issues, items, chances, sources, days, days.where("l_quantity < 5"))


@query("k02_information_report", """
with runs as (select distinct o_orderdate as d from orders), info as (select o_orderdate as d, o_orderkey as place, o_custkey as c from orders where o_orderstatus = 'F'),
lines as (select d, -1 as place, flatten([['# Desk — ' || strftime(d, '%Y-%m-%d'), '', '运行状态：`' || case when day(d) % 2 = 0 then 'success' else 'partial' end || '`', ''],
    case when d in (select d from info) then [] else ['当天没有通过完整质量门槛的 AI 信息。'] end]) as b from runs
  union all select d, place, flatten([['## o/r' || c || ' v' || place, '', '官方链接：https://h/' || place, ''], case when c % 2 = 0 then ['- one', '  - 原文：first', '- two', '  - 原文：second'] else ['- one', '  - 原文：first'] end,
    ['', '判断理由：because ' || c, '']]) from info)
select strftime(d, '%Y-%m-%d') as run_date, place::bigint as place, unnest(range(len(b)))::int as line_no, unnest(b) as line from lines""")
def k02i(spark, root):
    orders = load(spark, root, "orders").withColumn("run_date", F.date_format("o_orderdate", "yyyy-MM-dd"))
    runs = orders.select("run_date", F.when(F.dayofmonth("o_orderdate") % 2 == 0, "success").otherwise("partial").alias("status")).distinct()
    change = lambda a, b: F.struct(F.lit(a).alias("summary"), F.lit(b).alias("evidence"))
    info = orders.where("o_orderstatus = 'F'").select(
        "run_date", F.col("o_orderkey").alias("place"), _text("repository", "o/r", F.col("o_custkey")), _text("release_tag", "v", F.col("o_orderkey")),
        _text("official_url", "https://h/", F.col("o_orderkey")), _text("decision_reason", "because ", F.col("o_custkey")),
        F.when(F.col("o_custkey") % 2 == 0, F.array(change("one", "first"), change("two", "second"))).otherwise(F.array(change("one", "first"))).alias("substantive_changes"))
    return information_lines(runs, info, "Desk")
