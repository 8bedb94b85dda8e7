"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listinglens.llm import chat, decontam, grading, hard_negatives, language_id, licenses, merkle, near_dedup, packing, pii, quality_rules, suffix_dedup, toxicity
from listinglens.llm.common import read_table


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents", "doc_id", "text")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(_texts(spark, sf_dir)))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_texts(spark, sf_dir)).withColumn("dice", F.round("dice", 6))


def op3_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_preferences(chat.paired_turns(read_table(spark, sf_dir, "conversations")))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digests(packing.pack(_texts(spark, sf_dir)))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rate(_texts(spark, sf_dir))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language_id.fit(read_table(spark, sf_dir, "documents", "doc_id", "lang", "text"))
    return language_id.identify(_texts(spark, sf_dir), model)


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(_texts(spark, sf_dir))
    return found.select("doc_id", near_dedup.hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op8_quality_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir)
    return grading.grade(docs, grading.fit(docs, grading.graded(read_table(spark, sf_dir, "labels"))))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(_texts(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", *merkle.CELLS)
    return merkle.verified(merkle.manifest(docs, merkle.tampered_text(F.col("doc_id"), F.col("text"))))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = read_table(spark, sf_dir, "embeddings", "vec_id", "label", "embedding")
    return hard_negatives.mine(vectors, "vec_id", label, "embedding", F.col("id") % 100 == 0)


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_digests(suffix_dedup.remove_repeats(_texts(spark, sf_dir)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_pii,
        op2_license_scan,
        op3_chat_preferences,
        op4_packing,
        op5_quality_rules,
        op6_language_id,
        op7_simhash_near_dedup,
        op8_quality_grades,
        op9_decontamination,
        op10_toxicity,
        op11_merkle_manifest,
        op12_hard_negatives,
        op13_suffix_dedup,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": licenses.oracle(), "op3_chat_preferences": chat.ORACLE_SQL, "op11_merkle_manifest": merkle.oracle(), "op12_hard_negatives": hard_negatives.ORACLE_SQL}
