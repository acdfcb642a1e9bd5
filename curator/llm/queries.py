"""The registered queries of the training-data operators and their SQL twins, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curator.llm import binary, conversations, decontaminate, fingerprints, histogram_packing, language, licenses, merkle, packing, quality, simhash, suffix_tree, toxicity
from curator.llm.common import load, remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


@query("op3_simhash_near_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(load(spark, sf_dir, "documents"), words=4, distance=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


@query("op7_token_id_binary")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.round_trip(load(spark, sf_dir, "documents"), end_id=2)


@query("op8_benchmark_decontamination")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.array_sort("items"), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        decontaminate.is_contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"))


@query("op9_best_fit_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(load(spark, sf_dir, "documents"), capacity=1024, end_id=2)


@query("op2_language_id")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(language.training_rows(docs))
    found = docs.select("doc_id", language.identify(docs, model).alias("p"))
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "p.lang_pred", "p.score", "p.rejected")


@query("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    chain = toxicity.fit(docs, labels.where(remainder("doc_id", 5) != 0))
    found = docs.select("doc_id", toxicity.scorer(chain)("text").alias("p"))
    return found.select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), F.col("p.broad").alias("broad_score"),
        F.col("p.dense").alias("dense_score"), F.col("p.toxic").alias("score"), F.col("p.predicted").alias("predicted"),
        (F.col("p.predicted") == 1).alias("toxic"))


@query("op4_quality_classifier")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    seen = remainder("doc_id", 5) != 0
    model = quality.fit(docs.where(seen), labels.where(seen))
    found = docs.select("doc_id", quality.scorer(model)("text").alias("score"))
    return found.select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op1_document_fingerprints")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_edits(load(spark, sf_dir, "documents"))


@query("op6_license_scan", licenses.oracle())
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(load(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_sentences", F.array_join("identifiers", " ").alias("identifiers"), F.array_join("licenses", ",").alias("licenses"))


@query("op5_lm_scoring")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_tree.score_documents(load(spark, sf_dir, "documents"), remainder("doc_id", 5) != 1)
    return found.select(
        "doc_id", (remainder("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op11_histogram_packing")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_packing.pack_documents(load(spark, sf_dir, "documents"), capacity=4096, end_id=2)


@query("op12_merkle_manifest", merkle.ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    one_more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    found = merkle.manifest(
        load(spark, sf_dir, "documents"), {"n_chars": one_more}, F.crc32(F.col("doc_id").cast("string")) % 7 == 0)
    folded = merkle.fold(F.col("checked_leaf"), F.col("path"))
    return found.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


@query("op13_conversation_repair", conversations.ORACLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(load(spark, sf_dir, "conversations")))
