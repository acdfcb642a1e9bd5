"""Whole issues and the daily report of accepted information as ordered Markdown lines.

As in `render`, a document is a table of lines (section, place, line_no, line) per document; only lists that end in one
line (sources, dates) are gathered, and their length is that of a source registry or a calendar period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curator import constants as K
from curator.functions.times import local_date
from curator.runtime import dealt

# Headings and labels of an issue.
_LEVEL_NAMES = {"daily": "日榜", "weekly": "周榜", "monthly": "月榜"}
_READ = {"documented": "已读原始文档，未作本机实测结论", "demo": "已查看演示", "tested": "已本机实测"}
_NEWS_READ = "已核对原始新闻资料"
_DAY_ONLY = "（原文仅日期，时区未知；未确认具体时刻）"
_NEW = K.PERIOD_LABELS["new"]
_HEAD, _ITEMS, _CHANCES, _TAIL = 0, 1, len(K.CATEGORIES) + 1, len(K.CATEGORIES) + 2
_BEYOND = 1 << 62
# What a row of `_facts` tells of its issue.
_ITEM, _STARRED, _SOURCE, _FAILED, _LINK, _DATE, _LATER, _GAP, _CHANCE = range(9)


def _cat(*parts: Column | str) -> Column:
    """Parts joined; a plain text is itself, a null part is empty."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def _block(*parts: Column | str) -> Column:
    """A paragraph: one line and a blank one."""
    return F.array(_cat(*parts), F.lit(""))


def _if(condition: Column, block: Column) -> Column:
    return F.when(condition, block).otherwise(F.array().cast("array<string>"))


def _filled(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def _day(c: str) -> Column:
    return F.date_format(local_date(F.col(c)), "yyyy-MM-dd")


def _closed(c: str) -> Column:
    """Text without the marks that end it."""
    return F.rtrim(F.col(c), F.lit("。；; "))


def _named(values: dict[str, str], c: str) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col(c)]


def _links(urls: str, label: str) -> Column:
    return F.array_join(F.transform(urls, lambda u, i: F.concat(F.lit(f"[{label} "), (i + 1).cast("string"), F.lit("]("), u, F.lit(")"))), " / ")


def _section(c: str = "category") -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in K.CATEGORIES]), F.col(c)).cast("int")


def _lines(df: DataFrame, section: Column, place: Column, body: Column) -> DataFrame:
    return df.select("issue_id", section.cast("int").alias("section"), place.cast("long").alias("place"), F.posexplode(body).alias("line_no", "line"))


def _at(section: Column | int, place: int, body: Column) -> Column:
    """The lines of a paragraph with their places, inside a row."""
    section = F.lit(section) if isinstance(section, int) else section
    return F.transform(body, lambda line, i: F.struct(
        section.cast("int").alias("section"), F.lit(place).cast("long").alias("place"), i.alias("line_no"), line.alias("line")))


def _fact(df: DataFrame, kind: Column | int, name: Column | None = None, text: Column | None = None, place: Column | None = None, at: Column | None = None) -> DataFrame:
    none, empty = F.lit(None).cast("string"), F.lit(None).cast("long")
    return df.select(
        "issue_id", (F.lit(kind) if isinstance(kind, int) else kind).cast("byte").alias("kind"), (none if name is None else name).alias("name"),
        (none if text is None else text).alias("text"), *[(empty if c is None else c.cast("long")).alias(n) for c, n in ((at, "at"), (place, "place"))])


def _facts(items: DataFrame, opportunities: DataFrame, sources: DataFrame, runs: DataFrame, missing: DataFrame, discovery: bool) -> DataFrame:
    """issue_id, kind, name, text, at, place: a slim row for all that an issue's own lines say of its parts.

    Rows of one kind, name, text and `at` are told once, at the first of their places.
    """
    shown = F.concat(F.lit("["), "title", F.lit("]("), "url", F.lit(")"), *([] if discovery else [F.lit("："), _closed("reason")]))
    starred, later, place = F.coalesce("featured", F.lit(False)), F.col("supplemental"), F.col("place")
    day, name, detail = F.col("collection_date").cast("string"), F.col("name").cast("string"), F.col("detail").cast("string")
    failed = F.coalesce(F.col("status") == "failed", F.lit(False))
    facts = _fact(items, F.when(starred, _STARRED).otherwise(_ITEM), F.col("category"), F.when(starred, shown), F.when(starred, place))
    facts = facts.unionByName(_fact(opportunities, _CHANCE)).unionByName(_fact(missing, _GAP, text=day))
    facts = facts.unionByName(_fact(runs.where(later.isNotNull()), F.when(later, _LATER).otherwise(_DATE), text=day))
    if discovery:
        link = F.concat(F.lit("["), "name", F.lit("]("), "url", F.lit(")（"), "status", F.lit("）"))
        return facts.unionByName(_fact(sources, _LINK, text=link, place=place)).unionByName(
            _fact(sources.where(failed), _FAILED, text=F.concat(name, F.lit("："), detail), place=place))
    # Every failure stands there, equal ones too.
    return facts.unionByName(_fact(sources, F.when(failed, _FAILED).otherwise(_SOURCE), F.when(failed, name), F.when(failed, detail), at=F.when(failed, place)))


def _told(facts: DataFrame, discovery: bool) -> DataFrame:
    """One row per issue_id of `_facts`: n, themes[], starred, failures, links, dates, later, gaps, sourced, chanced.

    `facts` are dealt by issue_id, so both groupings find their rows in place.
    """
    # As a part of an order, no place comes before the others.
    first = F.when(F.count("place") == F.count(F.lit(1)), F.min("place"))
    once = facts.groupBy("issue_id", "kind", "name", "text", "at").agg(first.alias("place"), F.count(F.lit(1)).alias("n"))
    is_ = lambda *kinds: F.col("kind").isin(*kinds)
    listed = lambda kind, *order: F.array_sort(F.collect_list(F.when(is_(kind), F.struct(*order))))
    section = _section("name").alias("section")
    rows = once.groupBy("issue_id").agg(
        F.coalesce(F.sum(F.when(is_(_ITEM, _STARRED), F.col("n"))), F.lit(0)).alias("n"),
        F.array_sort(F.collect_set(F.when(is_(_ITEM, _STARRED), F.struct(section, "name")))).alias("themes"),
        listed(_STARRED, section, "place", "text").alias("starred"), listed(_FAILED, "at", "name", "place", "text", "n").alias("failures"),
        listed(_LINK, "place", "text").alias("links"), listed(_DATE, "text").alias("dates"), listed(_LATER, "text").alias("later"), listed(_GAP, "text").alias("gaps"),
        F.max(is_(_SOURCE, _FAILED, _LINK)).alias("sourced"), F.max(is_(_CHANCE)).alias("chanced"))
    some = lambda c, texts: F.when(F.size(c) > 0, texts).alias(c)
    joined = lambda c, between: some(c, F.array_join(F.array_distinct(F.transform(c, lambda x: x["text"])), between))
    failures = joined("failures", "；") if discovery else some("failures", F.array_join(F.flatten(F.transform(
        "failures", lambda x: F.array_repeat(F.concat(x["name"], F.lit("："), x["text"]), x["n"].cast("int")))), "；"))
    return rows.select(
        "issue_id", "n", "themes", "sourced", "chanced", joined("starred", "；"), failures, joined("links", " / "),
        *[joined(c, "、") for c in ("dates", "later", "gaps")])


def _item_body(discovery: bool) -> Column:
    kind, level = F.col("kind"), F.col("ranking_type")
    news, event = kind == "news", F.col("event_url").isNotNull()
    happened = F.when(F.col("event_on").isNotNull(), F.concat("event_on", F.lit(_DAY_ONLY))).otherwise(_day("event_at"))
    kept = _if(level == "monthly", _block("值得保留：", F.col("retention_reason")))
    update = _if(kind == "update", _block("重要更新：", F.col("change_note")))
    reading = _if(kind == "reading", _block("作者／受访者：", F.col("author"), "；原文日期：", F.col("original_date"), "。"))
    dated = _if(news, _block("新闻事件日期：", happened, "。"))
    head = _block(F.concat(F.lit("### "), F.when(F.col("featured"), "★ ").otherwise("")), F.col("title"))
    if discovery:
        label = F.when(kind.isin("reading", "news"), "原文").otherwise("官方入口")
        more = F.when(event & (F.col("event_url") != F.col("url")), _cat(" · [事件原文](", F.col("event_url"), ")"))
        return F.concat(
            head, _block(F.col("summary")), _if((level == "weekly") & F.col("featured"), _block(F.col("detail"))), kept, update,
            _if(kind.isin("project", "update") & F.col("supported_systems").isNotNull(), _block("支持系统：", F.col("supported_systems"))), reading, dated,
            _block("[", F.col("title"), " ", label, "](", F.col("url"), ")", more),
            _if(F.col("period_label") != _NEW, _block(F.col("period_label"), "；首次发现 ", _day("first_discovered_at"), "。")))
    published = F.when(~_filled("published_at"), "未确认").when(
        F.contains("published_at", F.lit("T")), F.date_format(local_date(F.to_timestamp("published_at")), "yyyy-MM-dd")).otherwise(F.col("published_at"))
    read = F.when(news & (F.col("verification_level") == "documented"), _NEWS_READ).otherwise(_named(_READ, "verification_level"))
    return F.concat(
        head, _block(F.col("summary")), _block(F.col("reason")),
        _block(F.when(news, "影响人群").otherwise("适合"), "：", _closed("audience"), "。", F.when(news, "适用范围与行动").otherwise("使用条件"), "：", F.col("usage_conditions")),
        _if(level == "weekly", _block(F.col("detail"))), kept, update, reading, dated,
        _block("[", F.col("title"), " 官方入口](", F.col("url"), ") · ", F.col("period_label"), "；首次发现 ", _day("first_discovered_at"), "；真实发布时间 ", published, "。"),
        _block("核验：", read, "；核验日期 ", _day("verified_at"), "；实际采集 ", _day("collected_at"), "。"),
        _block("资料：", _links("evidence_urls", "原始资料")))


def article_lines(
    issues: DataFrame, items: DataFrame, opportunities: DataFrame, sources: DataFrame, runs: DataFrame, missing: DataFrame, discovery: bool = False,
) -> DataFrame:
    """issue_id, section, place, line_no, line: the whole article of every issue.

    issues: issue_id, draft, title, ranking_type, period, window_start, window_end (text), prepared_at, shortfall_reason,
    verification_note, screened_count, verified_count, checked_through. items: issue_id, place, category, kind, featured, title,
    url, summary, reason, audience, usage_conditions, detail, retention_reason, change_note, supported_systems, author,
    original_date, event_url, event_on (text) or event_at, period_label, first_discovered_at, published_at (text),
    verification_level, verified_at, collected_at, evidence_urls[]. opportunities: issue_id, place, problem, audience,
    existing_solutions, validation, evidence_date, evidence_urls[]. sources: issue_id, place, name, url, status, detail,
    those of later runs after the others. runs: issue_id, collection_date (text), supplemental. missing: issue_id, collection_date.

    Items stand by category in the categories' order. With `discovery` an item is shown for its readers, without its
    verification, and the sources are one line. Items meet their issue's level in one shuffle, in none if they are dealt by
    issue_id; all that an issue's own lines say of its parts meets the issue in another, as slim rows.
    """
    own = items.where(_section() > 0).join(issues.select("issue_id", "ranking_type"), "issue_id")
    body = _lines(own, _section(), F.col("place"), _item_body(discovery))
    chance = _lines(opportunities, F.lit(_CHANCES), F.col("place"), F.concat(
        _block(F.col("problem")), _block("人群：", F.col("audience"), "；已有方案：", F.col("existing_solutions"), "。"), _block("验证切口：", F.col("validation")),
        _block("用户问题资料（", F.col("evidence_date"), "）：", _links("evidence_urls", "原文"))))

    facts, issues = dealt("issue_id", _facts(items, opportunities, sources, runs, missing, discovery), issues)
    # What is said of an issue_id once stands beside one row of it, or by itself.
    number = F.row_number().over(Window.partitionBy("issue_id").orderBy("issue_id"))
    whole = issues.withColumn("_issue", F.lit(True)).withColumn("_once", number == 1).join(_told(facts, discovery), "issue_id", "full").fillna(0, ["n"])
    issue, once = F.col("_issue").isNotNull(), F.coalesce("_once", F.lit(True))
    themes = F.array_join(F.transform("themes", lambda x: x["name"]), " / ")
    window = _cat(F.when(F.col("draft"), "草稿 · "), _named(_LEVEL_NAMES, "ranking_type"), " ", F.col("period"), " · 北京时间 ", F.col("window_start"), " 至 ", F.col("window_end"))
    head = F.concat(
        _block("# ", F.col("title")), F.array(window, F.lit("")), _block("实际整理：", _day("prepared_at"), "；精选 ", F.col("n"), " 条。"),
        _if(_filled("shortfall_reason"), _block("数量说明：", F.col("shortfall_reason"))), _if(F.col("starred").isNotNull(), _block("重点推荐：", F.col("starred"), "。")),
        _if(F.size("themes") > 0, _block("本期栏目：", themes)))
    headings = F.flatten(F.transform(
        F.filter("themes", lambda x: x["section"] > 0), lambda x: _at(x["section"], -1, F.array(F.concat(F.lit("## "), x["name"]), F.lit("")))))
    # The notes on sources.
    days = F.concat(
        _block("本期实际采集日期：", F.coalesce("dates", F.lit("无")), "。"),
        _block("缺少采集的日期：", F.coalesce("gaps", F.lit("无")), "（检查截至 ", F.col("checked_through"), "）。"))
    after = _if(F.col("later").isNotNull(), _block("期后核验／补采实际日期：", F.col("later"), "。不改写原期采集覆盖。"))
    last = _block("来源失败：", F.coalesce("failures", F.lit("本次记录中无失败；不代表未访问来源可用")), "。")
    told = [(issue, _at(_HEAD, 0, head)), (once & (F.size("themes") > 0), headings), (once & F.col("chanced"), _at(_CHANCES, -1, _block("## 开发机会观察（不计入精选条数）")))]
    if discovery:
        told.append((issue, _at(_TAIL, 0, F.concat(
            _block("## 来源说明"), _block("实际来源：", F.coalesce("links", F.lit("未记录可用来源")), "。"), days, after, last))))
    else:
        stated = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("未单独记录"))
        notes = F.concat(
            _block("## 来源与核验说明"), _block(F.col("verification_note")),
            _block("实际初筛：", stated("screened_count"), "；深入核验：", stated("verified_count"), "；入选：", F.col("n"), "。"), days, after)
        told += [
            (issue, _at(_TAIL, -2, notes)), (once & F.col("sourced"), _at(_TAIL, -1, _block("实际来源状态："))),
            (issue, _at(_TAIL, _BEYOND, F.concat(_if(F.coalesce("sourced", F.lit(False)), F.array(F.lit(""))), last)))]
    none = F.array().cast("array<struct<section:int,place:bigint,line_no:int,line:string>>")
    out = whole.select("issue_id", F.inline(F.concat(*[F.when(condition, lines).otherwise(none) for condition, lines in told]))).unionByName(body).unionByName(chance)
    if discovery:
        return out
    return out.unionByName(_lines(sources, F.lit(_TAIL), F.col("place"), F.array(_cat("- [", F.col("name"), "](", F.col("url"), ")：", F.col("status"), "；", F.col("detail")))))


def information_lines(runs: DataFrame, information: DataFrame, name: str) -> DataFrame:
    """run_date, place, line_no, line: the report of what was accepted each day, of the publication `name`.

    runs: run_date, status; information: run_date, place, repository, release_tag, official_url, decision_reason,
    substantive_changes ARRAY<STRUCT<summary, evidence>>. A day without information says so. Rows of other days are left out.
    """
    # Headings and labels of the report.
    some = information.select("run_date").distinct().withColumn("_some", F.lit(True))
    head = runs.join(some, "run_date", "left").select("run_date", F.lit(-1).cast("long").alias("place"), F.posexplode(F.concat(
        F.array(_cat(f"# {name} — ", F.col("run_date")), F.lit(""), _cat("运行状态：`", F.col("status"), "`"), F.lit("")),
        _if(F.col("_some").isNull(), F.array(F.lit("当天没有通过完整质量门槛的 AI 信息。"))))).alias("line_no", "line"))
    changes = F.flatten(F.transform("substantive_changes", lambda c: F.array(
        F.concat(F.lit("- "), c["summary"]), F.concat(F.lit("  - 原文："), c["evidence"]))))
    known = information.join(runs.select("run_date"), "run_date", "left_semi")
    body = known.select("run_date", F.col("place").cast("long").alias("place"), F.posexplode(F.concat(
        _block("## ", F.col("repository"), " ", F.col("release_tag")), _block("官方链接：", F.col("official_url")), changes,
        F.array(F.lit("")), _block("判断理由：", F.col("decision_reason")))).alias("line_no", "line"))
    return head.unionByName(body)
