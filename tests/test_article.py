"""Articles, reports and the discovery contract on small hand-written cases."""

import datetime

import pytest

from curator.operators.provenance import validate_provenance
from curator.sinks.article import article_lines, information_lines

AT = datetime.datetime(2024, 1, 2, 20)  # already the next day in the calendar's zone


def tables(spark, **item):
    issue = spark.createDataFrame(
        [(1, True, "Week", "weekly", "2024-W01", "2024-01-01", "2024-01-07", AT, None, "note", None, 5, "2024-01-07")],
        "issue_id int, draft boolean, title string, ranking_type string, period string, window_start string, window_end string, prepared_at timestamp, "
        "shortfall_reason string, verification_note string, screened_count int, verified_count int, checked_through string")
    row = {
        "issue_id": 1, "place": 1, "category": "Skills", "kind": "project", "featured": True, "title": "T", "url": "https://h/t", "summary": "S", "reason": "R。", "audience": "devs；",
        "usage_conditions": "free", "detail": "D", "retention_reason": "", "change_note": "", "supported_systems": "linux", "author": None, "original_date": None,
        "event_url": "https://h/e", "event_on": None, "event_at": AT, "period_label": "往期候选", "first_discovered_at": AT, "published_at": None,
        "verification_level": "demo", "verified_at": AT, "collected_at": AT, "evidence_urls": ["https://e/1", "https://e/2"]} | item
    kinds = ("issue_id int, place int, category string, kind string, featured boolean, title string, url string, summary string, reason string, audience string, "
             "usage_conditions string, detail string, retention_reason string, change_note string, supported_systems string, author string, original_date string, event_url string, "
             "event_on string, event_at timestamp, period_label string, first_discovered_at timestamp, published_at string, verification_level string, verified_at timestamp, "
             "collected_at timestamp, evidence_urls array<string>")
    items = spark.createDataFrame([tuple(row[c.split(" ")[0]] for c in kinds.split(", "))], kinds)
    chances = spark.createDataFrame([], "issue_id int, place int, problem string, audience string, existing_solutions string, validation string, evidence_date string, evidence_urls array<string>")
    sources = spark.createDataFrame(
        [(1, 1, "A", "https://a", "ok", "x"), (1, 2, "B", "https://b", "failed", "down"), (1, 3, "B", "https://b", "failed", "down")],
        "issue_id int, place int, name string, url string, status string, detail string")
    runs = spark.createDataFrame([(1, "2024-01-02", False), (1, "2024-01-01", False), (1, "2024-01-09", True)], "issue_id int, collection_date string, supplemental boolean")
    missing = spark.createDataFrame([], "issue_id int, collection_date string")
    return issue, items, chances, sources, runs, missing


def text(lines):
    return [r.line for r in lines.orderBy("section", "place", "line_no").collect()]


def test_an_article_with_its_verification(spark):
    assert text(article_lines(*tables(spark))) == [
        "# Week", "", "草稿 · 周榜 2024-W01 · 北京时间 2024-01-01 至 2024-01-07", "", "实际整理：2024-01-03；精选 1 条。", "", "重点推荐：[T](https://h/t)：R。", "", "本期栏目：Skills", "",
        "## Skills", "", "### ★ T", "", "S", "", "R。", "", "适合：devs。使用条件：free", "", "D", "",
        "[T 官方入口](https://h/t) · 往期候选；首次发现 2024-01-03；真实发布时间 未确认。", "", "核验：已查看演示；核验日期 2024-01-03；实际采集 2024-01-03。", "",
        "资料：[原始资料 1](https://e/1) / [原始资料 2](https://e/2)", "",
        "## 来源与核验说明", "", "note", "", "实际初筛：未单独记录；深入核验：5；入选：1。", "", "本期实际采集日期：2024-01-01、2024-01-02。", "", "缺少采集的日期：无（检查截至 2024-01-07）。", "",
        "期后核验／补采实际日期：2024-01-09。不改写原期采集覆盖。", "", "实际来源状态：", "", "- [A](https://a)：ok；x", "- [B](https://b)：failed；down", "- [B](https://b)：failed；down", "",
        "来源失败：B：down；B：down。", ""]


def test_an_article_for_its_readers(spark):
    assert text(article_lines(*tables(spark), discovery=True)) == [
        "# Week", "", "草稿 · 周榜 2024-W01 · 北京时间 2024-01-01 至 2024-01-07", "", "实际整理：2024-01-03；精选 1 条。", "", "重点推荐：[T](https://h/t)。", "", "本期栏目：Skills", "",
        "## Skills", "", "### ★ T", "", "S", "", "D", "", "支持系统：linux", "", "[T 官方入口](https://h/t) · [事件原文](https://h/e)", "", "往期候选；首次发现 2024-01-03。", "",
        "## 来源说明", "", "实际来源：[A](https://a)（ok） / [B](https://b)（failed）。", "", "本期实际采集日期：2024-01-01、2024-01-02。", "", "缺少采集的日期：无（检查截至 2024-01-07）。", "",
        "期后核验／补采实际日期：2024-01-09。不改写原期采集覆盖。", "", "来源失败：B：down。", ""]
    news = text(article_lines(*tables(spark, kind="news", featured=False, event_on="2024-01-02", period_label="新发现"), discovery=True))
    assert "新闻事件日期：2024-01-02（原文仅日期，时区未知；未确认具体时刻）。" in news and "[T 原文](https://h/t) · [事件原文](https://h/e)" in news
    assert "D" not in news and not any(x.startswith("重点推荐") for x in news)


def test_a_day_with_and_without_information(spark):
    runs = spark.createDataFrame([("2024-01-01", "success"), ("2024-01-02", "partial")], "run_date string, status string")
    info = spark.createDataFrame(
        [("2024-01-01", 1, "o/r", "v1", "https://h", "why", [("c", "e")]), ("2024-01-05", 1, "o/r", "v1", "https://h", "why", [])],
        "run_date string, place int, repository string, release_tag string, official_url string, decision_reason string, substantive_changes array<struct<summary:string,evidence:string>>")
    got = [r.line for r in information_lines(runs, info, "Desk").orderBy("run_date", "place", "line_no").collect()]
    assert got == [
        "# Desk — 2024-01-01", "", "运行状态：`success`", "", "## o/r v1", "", "官方链接：https://h", "", "- c", "  - 原文：e", "", "判断理由：why", "",
        "# Desk — 2024-01-02", "", "运行状态：`partial`", "", "当天没有通过完整质量门槛的 AI 信息。"]


GOOD = {
    "run": ("r", "https://github.com/o/a", "o/a"), "queries": [("r", "q", "direct")],
    "candidates": [("r", f"o/{c}", f"https://github.com/o/{c}", "adjacent" if c == "e" else "direct", "d") for c in "abcde"], "reads": [("r", "o/a")]}


def codes(spark, run=None, queries=None, candidates=None, reads=None):
    g = GOOD
    make = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    found = validate_provenance(
        make([run or g["run"]], "run_id string, url string, selected_repository string"),
        make(g["queries"] if queries is None else queries, "run_id string, query string, lane string"),
        make(g["candidates"] if candidates is None else candidates, "run_id string, repository string, url string, lane string, description string"),
        make(g["reads"] if reads is None else reads, "run_id string, repository string"))
    return sorted({f"{r.path}.{r.code}" for r in found.collect()})


@pytest.mark.parametrize("change, want", [
    ({}, []),
    ({"queries": []}, ["search_queries.count"]), ({"queries": [("r", "q", "direct")] * 6}, ["search_queries.count"]),
    ({"queries": [("r", " ", "direct"), ("x", "", "odd")]}, ["search_queries.query"]), ({"queries": [("r", "q" * 501, None)]}, ["search_queries.lane", "search_queries.query"]),
    ({"candidates": GOOD["candidates"] + [("r", f"o/n{i}", f"https://github.com/o/n{i}", "direct", "d") for i in range(16)]}, ["screened_candidates.count"]),
    ({"candidates": GOOD["candidates"][1:] + [("r", "o/a", "https://github.com/o/z", "direct", "d")]}, ["screened_candidates.identity"]),
    ({"candidates": GOOD["candidates"] + [("r", "o/f", "https://github.com/o/f", "adjacent", None)]}, ["screened_candidates.adjacent_share", "screened_candidates.description"]),
    ({"candidates": GOOD["candidates"] + [GOOD["candidates"][0]]}, ["screened_candidates.repeated"]),
    ({"candidates": GOOD["candidates"] + [("r", "o/f", "https://github.com/o/f", "odd", "d" * 1001)]}, ["screened_candidates.description", "screened_candidates.lane"]),
    ({"reads": []}, ["deep_read_repositories.count", "selected_repository.not_read"]),
    ({"reads": [("r", "o/a"), ("r", "o/a"), ("r", "o/zz")]}, ["deep_read_repositories.not_screened", "deep_read_repositories.repeated"]),
    ({"run": ("r", "https://github.com/o/a/issues/3", "o/a")}, ["url.unsupported"]), ({"run": ("r", "https://github.com/o/b", "o/a")}, ["selected_repository.other_target"]),
    ({"run": ("r", "https://github.com/o/a", None)}, ["selected_repository.required"]),
    ({"run": ("r", "https://github.com/o/b", "o/b")}, ["selected_repository.not_read"]),
], ids=range(16))
def test_a_discovery_and_what_it_breaks(spark, change, want):
    assert codes(spark, **change) == want


def test_the_query_reaches_every_code(spark):
    from curator.catalog import QUERIES

    found = QUERIES["v01_provenance"](spark, "/root/testdata/sf0.01").select("path", "code").distinct()
    assert found.count() == 16
