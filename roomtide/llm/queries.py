"""The registered queries: each operator over its whole table, in the columns of its contract.

`roomtide.llm.oracle` has SQL for those that SQL can express.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roomtide.llm import (
    bpe,
    decontaminate,
    hard_negatives,
    infill,
    katz,
    language,
    licenses,
    line_dedup,
    quality_knn,
    quality_rules,
    simhash,
    toxicity,
    url_rules,
)
from roomtide.llm.common import fold, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), rest=True
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def _held_out(folds: int, remainder: int) -> Column:
    return fold(F.col("doc_id"), folds) == remainder


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = _held_out(4, 2)
    model = language.train(docs.where(~held_out))
    return language.identify(docs, model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score"
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents").select("doc_id", "text"), _held_out(4, 2)
    labels = table(spark, sf_dir, "labels").where(~held_out)
    scored = toxicity.toxicity_scores(docs, toxicity.train(docs.where(~held_out), labels))
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int")
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted")
    )


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe_digests(bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json")))


def bpe_digests(encoded: DataFrame) -> DataFrame:
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = _held_out(quality_knn.FOLDS, 0)
    scored = quality_knn.quality_scores(
        table(spark, sf_dir, "documents").select("doc_id", "text"),
        table(spark, sf_dir, "labels").where(~held_out),
    )
    predicted = (F.col("score") >= quality_knn.THRESHOLD).cast("int")
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted")
    )


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.apply_rules(table(spark, sf_dir, "pages"), url_rules.rule_table(spark))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "anomaly",
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = hard_negatives.integer_vectors(table(spark, sf_dir, "embeddings"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = infill.fill_in_middle(table(spark, sf_dir, "documents"))
    restored = infill.restored(F.col("output"), F.col("form"))
    return cut.select(
        "doc_id",
        "n",
        "form",
        F.col("prefix_units").alias("prefix_chars"),
        F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored, 256).alias("restored_sha256"),
    )


def op13_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = _held_out(10, 0)
    return katz.score_texts(table(spark, sf_dir, "documents"), ~held_out).select(
        "doc_id",
        (~F.col("learned")).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )


ALL: dict[str, Query] = {
    query.__name__: query
    for query in (
        op1_licenses,
        op2_decontamination,
        op3_simhash,
        op4_language,
        op5_toxicity,
        op6_bpe,
        op7_quality,
        op8_url_rules,
        op9_quality_rules,
        op10_line_dedup,
        op11_hard_negatives,
        op12_infill,
        op13_katz,
    )
}
