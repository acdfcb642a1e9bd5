"""The corpus pipeline: stages over `documents`, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curator.llm import decontaminate, language, packing, simhash, toxicity
from curator.llm.common import free_name, load, materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier chain, fitted on all labelled ones among them, calls toxic."""
    chain = toxicity.fit(docs, load(spark, sf_dir, "labels"))
    name = free_name(docs, "toxicity")
    return docs.withColumn(name, toxicity.scorer(chain)("text")).where(F.col(name)["predicted"] == 0).drop(name)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents without a letter and those too far from every centroid of the languages in `lang`.

    Where no row has a language there is nothing to be far from: all documents stay.
    """
    model = language.fit(docs)
    if not model.langs:
        return docs
    name = free_name(docs, "language")
    found = docs.withColumn(name, language.identify(docs, model))
    return found.where(~F.col(name)["rejected"]).drop(name)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of smallest id of each near-duplicate group (all rows of that id, if it is repeated).

    A row without an id is a document of its own that comes after all with one: it is kept if its group has no id and
    no earlier such row.
    """
    key = free_name(docs, "key")
    unnamed = materialize(docs.where("doc_id is null").withColumn(key, F.monotonically_increasing_id()), "unnamed")
    if unnamed.isEmpty():
        rows = docs.withColumn(key, F.col("doc_id"))
    else:
        rows = docs.where("doc_id is not null").withColumn(key, F.struct(F.lit(0).alias("kind"), F.col("doc_id").cast("bigint").alias("id")))
        rows = rows.unionByName(unnamed.withColumn(key, F.struct(F.lit(1).alias("kind"), F.col(key).alias("id"))))
    found = simhash.near_duplicates(rows, id_col=key)
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias(key)).distinct()
    return rows.join(kept, key, "left_semi").select(docs.columns)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents of whose words a twentieth or more lies in benchmark windows; the others stay whole."""
    return decontaminate.drop_contaminated(docs, load(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 1024 tokens; one row per piece."""
    return packing.pack_documents(docs, capacity=1024)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_dedup", near_dedup),
    ("decontamination", remove_benchmark),
    ("packing", pack),
]

#: Learned classifiers, fingerprints and packing can't be expressed in SQL; see tests/llm for the brute-force checks.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
