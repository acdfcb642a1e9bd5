"""Markdown output as ordered lines, ready for `write.text`.

A document is a table of lines (section, place, line_no, line): no document is
put together in one task, and the sorted lines can be written in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curator import constants as K
from curator.operators.ordered import ordered_scan


def history_index(issues: DataFrame) -> DataFrame:
    """Archived issues per ranking level, newest period first.

    issues: ranking_type, period, item_count, ...; a period name is a date or a
    month, so its digits order it.
    """
    newest = -F.rpad(F.regexp_replace("period", "-", ""), 8, "0").cast("long")
    return ordered_scan(issues, [newest], ["ranking_type"], position="place")


def ranking_lines(candidates: DataFrame, run_date: str, audience: str = "本刊") -> DataFrame:
    """Lines of the daily ranking report of the publication `audience`.

    candidates: rank, canonical_title, total, components STRUCT, penalties MAP,
    penalty_reasons[], recommendation, evidence_status, primary_source_url,
    links ARRAY<STRUCT<url, source_id, source_class, provenance>>.
    """
    # Report headings.
    none = F.lit("无")
    parts = F.array(*[F.concat(F.lit(n + " "), F.col(f"components.{n}").cast("string")) for n in K.SCORE_WEIGHTS])
    minus = F.transform(F.map_entries("penalties"), lambda e: F.concat(e["key"], F.lit(" "), e["value"].cast("string")))
    joined = lambda a: F.when(F.size(a) > 0, F.array_join(a, "；")).otherwise(none)
    check = (
        F.when(F.col("evidence_status") == "discovery_only", "需要补充可直接引用的一手来源，不能只依据聚合摘要。")
        .when(F.col("evidence_status") == "primary", "核对官方页面中的适用范围、地区、版本和已知限制。")
        .otherwise("补充一手来源或独立交叉来源后再进入写作。")
    )
    body = F.concat(
        F.array(
            F.concat(F.lit("## "), F.col("rank").cast("string"), F.lit(". "), "canonical_title", F.lit(" — "), F.col("total").cast("string"), F.lit("/100")),
            F.lit(""), F.concat(F.lit("- 分项分数："), F.array_join(parts, "；")), F.concat(F.lit("- 惩罚："), joined(minus)),
            F.concat(F.lit("- 惩罚原因："), joined(F.col("penalty_reasons"))), F.concat(F.lit(f"- 为什么适合 {audience}："), "recommendation"),
            F.concat(F.lit("- 证据状态："), "evidence_status"), F.concat(F.lit("- 主证据链接："), F.coalesce("primary_source_url", F.lit("暂无"))), F.lit("- 所有来源链接："),
        ),
        F.transform("links", lambda x: F.concat(F.lit("  - ["), x["provenance"], F.lit(" / "), x["source_id"], F.lit("] "), x["url"])),
        F.array(F.concat(F.lit("- 尚待核验事项："), check), F.lit("")),
    )
    lines = candidates.select(F.lit(1).alias("section"), F.col("rank").cast("long").alias("place"), F.posexplode(body).alias("line_no", "line"))
    head = candidates.sparkSession.range(1).select(
        F.lit(0).alias("section"), F.lit(0).cast("long").alias("place"),
        F.posexplode(F.array(F.lit(f"# {audience} 每日候选榜 — {run_date}"), F.lit(""), F.lit("本文件只列出待人工核验的候选，不代表已发布内容。"), F.lit(""))).alias("line_no", "line"),
    )
    return head.unionByName(lines)


def issue_lines(items: DataFrame) -> DataFrame:
    """Item lines of an issue: categories in their fixed order, starred featured rows.

    items: issue_id, place, category, featured, title, summary, url, kind, event_url.
    """
    section = F.array_position(F.array(*[F.lit(c) for c in K.CATEGORIES]), F.col("category"))
    label = F.when(F.col("kind").isin("reading", "news"), "原文").otherwise("官方入口")
    link = F.concat(
        F.lit("["), "title", F.lit(" "), label, F.lit("]("), "url", F.lit(")"),
        F.when(F.col("event_url").isNotNull() & (F.col("event_url") != F.col("url")), F.concat(F.lit(" · [事件原文]("), "event_url", F.lit(")"))).otherwise(""),
    )
    body = F.array(
        F.concat(F.lit("### "), F.when(F.col("featured"), "★ ").otherwise(""), "title"), F.lit(""), F.col("summary"), F.lit(""), link, F.lit("")
    )
    lines = items.select("issue_id", section.alias("section"), "place", F.posexplode(body).alias("line_no", "line"))
    heads = items.select("issue_id", section.alias("section"), "category").distinct().select(
        "issue_id", "section", F.lit(0).cast("long").alias("place"), F.posexplode(F.array(F.concat(F.lit("## "), "category"), F.lit(""))).alias("line_no", "line")
    )
    return heads.unionByName(lines.withColumn("place", F.col("place").cast("long")))


def status_lines(sources: DataFrame) -> DataFrame:
    """Tail of an issue: which sources were read and which failed.

    sources: issue_id, name, url, status, detail.
    """
    row = F.concat(F.lit("- ["), "name", F.lit("]("), "url", F.lit(")："), "status", F.lit("；"), "detail")
    rows = sources.distinct().select("issue_id", F.lit(len(K.CATEGORIES) + 1).alias("section"), "name", row.alias("line"))
    return ordered_scan(rows, ["name", "line"], ["issue_id"], position="place").select(
        "issue_id", "section", "place", F.lit(0).alias("line_no"), "line"
    )


def write_lines(lines: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """Write the lines of each document in order (documents are partition folders)."""
    ordered = lines.repartitionByRange(*[F.col(c) for c in (*by, "section", "place", "line_no")]).sortWithinPartitions(*by, "section", "place", "line_no")
    writer = ordered.select(*by, "line").write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).text(path)
