"""Cleaning a corpus, stage by stage; counted as part of the subpackage `roomtide.llm`.

Every stage works on all rows its predecessor kept, and its result is written and read again as the
documents of the next. All stages but the last return the columns of the documents, also columns
the stages don't know. Null ids and repeated rows are kept or dropped like the rows they equal.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roomtide.llm import bpe, decontaminate, line_dedup, quality_rules, simhash
from roomtide.llm.common import identified, table
from roomtide.llm.queries import bpe_digests
from roomtide.sources.scratch import delete, scratch_path, scratch_scope, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: SQL can't express the isolation forest, the fingerprints and the tokens.
ORACLE_SQL = None


def _same_id(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def _without(docs: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """Documents whose id and text are not in `found` (`doc_id` and `text_hash`). The list is written
    first, so that Spark knows its size and moves the texts only if it is too long to send to every
    task."""
    gone = found.select(F.col("doc_id").alias("gone"), F.col("text_hash").alias("gone_hash"))
    gone = stored(gone.distinct(), name)
    same = _same_id("id", "gone") & (F.col("hash") == F.col("gone_hash"))
    return identified(docs).join(gone, same, "left_anti").select("row.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the forest keep; of rows with one doc_id, each text by itself."""
    judged = quality_rules.judge(docs, table(spark, sf_dir, "labels"))
    return _without(docs, judged.where(~F.col("kept")), "rejected")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines they share; `n_chars`, if there, follows the new text."""
    marked = line_dedup.with_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    changed = F.col("bitmap").isNotNull()
    kept = line_dedup.kept_text_column("row.text", "bitmap")
    rows = marked.select("row", changed.alias("changed"), kept.alias("kept"))
    columns = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        n_chars = F.length("kept").cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.col("changed"), n_chars).otherwise(F.col("row.n_chars"))
    return rows.select(
        *[columns.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns]
    )


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest doc_id (one without id
    only if none has one), of several texts with this id the one with the smallest hash, and of
    repeated rows one."""
    found = simhash.near_duplicates(docs)
    same_rows = found.groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("times"))
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    chosen = F.min_by(F.struct("doc_id", "text_hash", "times"), rank)
    keepers = (
        same_rows.groupBy("component")
        .agg(chosen.alias("keeper"))
        .select(
            F.col("keeper.doc_id").alias("keeper_id"),
            F.col("keeper.text_hash").alias("keeper_hash"),
            F.col("keeper.times").alias("times"),
        )
    )
    same = _same_id("id", "keeper_id") & (F.col("hash") == F.col("keeper_hash"))
    kept = identified(docs).join(stored(keepers, "keepers"), same)
    # Only repeated rows need another shuffle; the join's is used for both parts.
    once = F.min_by("row", F.xxhash64("row")).alias("row")
    repeated = kept.where("times > 1").groupBy("id", "hash").agg(once)
    return kept.where("times = 1").select("row.*").unionByName(repeated.select("row.*"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark question; of rows with one doc_id, each text by itself."""
    found = decontaminate.contaminated_texts(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.withColumnRenamed("doc_text", "text_hash"), "leaked")


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the texts that are left."""
    return bpe_digests(bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`. What a stage wrote for itself goes when it ends, and
    its input when its result is written, so that at most two copies of the corpus are kept; the
    rows returned still read the last one."""
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        target = scratch_path(spark, name.replace(" ", "-"))
        with scratch_scope(spark, "stage"):
            result = stage(spark, docs, sf_dir)
            result.write.parquet(target)
        docs = spark.read.schema(result.schema).parquet(target)
        if path:
            delete(spark, path)
        path = target
    return docs
