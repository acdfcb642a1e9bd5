"""Contract of an active discovery: queries, screened candidates, deep reads and the chosen repository of each run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curator.functions.urls import classify_repo_url
from curator.operators.validation import cross, repeated, validate

# Sizes of a discovery, its lanes, lengths of texts, direct candidates for each adjacent one.
MOST_QUERIES, MOST_CANDIDATES, MOST_DEEP_READS = 5, 20, 5
LANES = ("direct", "adjacent")
QUERY_CHARS, DESCRIPTION_CHARS = 500, 1000
DIRECT_PER_ADJACENT = 4


def validate_provenance(runs: DataFrame, queries: DataFrame, candidates: DataFrame, deep_reads: DataFrame) -> DataFrame:
    """run_id, path, code, message of everything a discovery breaks.

    runs: run_id, url (the learning target), selected_repository; queries: run_id, query, lane; candidates: run_id,
    repository, url, lane, description; deep_reads: run_id, repository. Rows of other runs are not judged. Row rules name a
    rule once per broken row, rules of a run once.
    """
    key = ["run_id"]
    known = runs.select("run_id")
    queries, candidates, deep_reads = (t.join(known, "run_id", "left_semi") for t in (queries, candidates, deep_reads))
    counted = lambda t, name, **more: t.groupBy("run_id").agg(
        F.count("*").alias(name), *[F.count_if(c).alias(n) for n, c in more.items()])
    sizes = runs.join(counted(queries, "queries"), "run_id", "left").join(
        counted(candidates, "candidates", direct=F.col("lane") == "direct", adjacent=F.col("lane") == "adjacent"), "run_id", "left").join(
        counted(deep_reads, "reads"), "run_id", "left").fillna(0, ["queries", "candidates", "direct", "adjacent", "reads"])
    target = classify_repo_url("url")
    listed = deep_reads.select("run_id", F.col("repository").alias("selected_repository")).distinct().withColumn("_read", F.lit(True))
    whole = sizes.join(listed, ["run_id", "selected_repository"], "left").withColumn("_target", target)
    is_target = F.col("_target").isNotNull() & (F.col("_target.kind") == "repository")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    found = validate(whole, key, [
        cross("search_queries", "count", ~F.col("queries").between(1, MOST_QUERIES), "a discovery has 1 to 5 search queries"),
        cross("screened_candidates", "count", ~F.col("candidates").between(1, MOST_CANDIDATES), "a discovery has 1 to 20 screened candidates"),
        cross("deep_read_repositories", "count", ~F.col("reads").between(1, MOST_DEEP_READS), "a discovery has 1 to 5 deep reads"),
        cross("screened_candidates", "adjacent_share", (F.col("adjacent") > 0) & (F.col("direct") < DIRECT_PER_ADJACENT * F.col("adjacent")),
              "more than a fifth of the candidates are adjacent"),
        cross("selected_repository", "required", F.col("selected_repository").isNull(), "selected_repository must be text"),
        cross("url", "unsupported", ~is_target, "the learning target must be a repository"),
        cross("selected_repository", "other_target", is_target & (F.col("selected_repository") != F.col("_target.repository")), "the selected repository is not the learning target"),
        cross("selected_repository", "not_read", F.col("selected_repository").isNotNull() & F.col("_read").isNull(), "the selected repository was not read in depth"),
    ])
    page = classify_repo_url("url")
    rows = candidates.withColumn("_page", page)
    found = found.unionByName(validate(rows, key, [
        cross("screened_candidates", "identity", F.col("_page").isNull() | (F.col("_page.kind") != "repository") | ~F.col("_page.repository").eqNullSafe(F.col("repository")),
              "URL and repository of a candidate do not match"),
        cross("screened_candidates", "lane", ~F.coalesce(F.col("lane").isin(*LANES), F.lit(False)), "unsupported lane"),
        cross("screened_candidates", "description", F.coalesce(F.length("description"), F.lit(DESCRIPTION_CHARS + 1)) > DESCRIPTION_CHARS,
              "a description is text of at most 1000 characters"),
    ]))
    found = found.unionByName(validate(queries, key, [
        cross("search_queries", "query", blank(F.col("query")) | (F.length("query") > QUERY_CHARS), "a query is text of at most 500 characters"),
        cross("search_queries", "lane", ~F.coalesce(F.col("lane").isin(*LANES), F.lit(False)), "unsupported lane"),
    ]))
    screened = candidates.select("run_id", "repository").distinct().withColumn("_screened", F.lit(True))
    found = found.unionByName(validate(deep_reads.join(screened, ["run_id", "repository"], "left"), key, [
        cross("deep_read_repositories", "not_screened", F.col("_screened").isNull(), "a deep read is no screened candidate")]))
    twice = lambda t, path, message: repeated(t, key, "repository").select(
        "run_id", F.lit(path).alias("path"), F.lit("repeated").alias("code"), F.lit(message).alias("message"))
    return found.unionByName(twice(candidates, "screened_candidates", "a candidate occurs twice")).unionByName(
        twice(deep_reads, "deep_read_repositories", "a repository is read twice"))
