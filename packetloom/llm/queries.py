"""Queries opN_* over the tables of a data directory, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm import ann, bpe, chat, decontam, hmm_lm, license_scan, near_dedup, pii, quality, sharding
from packetloom.session import read_table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(read_table(spark, sf_dir, "documents")).withColumn("doc_id", F.col("doc_id").cast("long"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), words=4, percent=80)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.scan(read_table(spark, sf_dir, "documents")))


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.item_id", "hit.start", "hit.end", "hit.edits")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan(read_table(spark, sf_dir, "documents")))


def op6_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.score_corpus(read_table(spark, sf_dir, "documents"), quality.remainder(F.col("doc_id"), 7) != 2)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(bpe.encode(read_table(spark, sf_dir, "documents")))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.with_probe(read_table(spark, sf_dir, "conversations"), spark)
    return chat.digest(chat.format_log(chat.log_of_turns(turns)))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit_on(docs, read_table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", (quality.remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_near_dedup": op2_near_dedup,
    "op3_pii": op3_pii,
    "op4_decontam": op4_decontam,
    "op5_license_scan": op5_license_scan,
    "op6_hmm_lm": op6_hmm_lm,
    "op7_bpe": op7_bpe,
    "op8_chat_format": op8_chat_format,
    "op9_quality": op9_quality,
    "op10_ann": op10_ann,
}
