"""The corpus pipeline: documents in, token ids of clean documents out.

Each stage is a function (spark, docs, sf_dir) over all rows that the stage before it kept; its result is written as Parquet and read
again as the next stage's documents. All stages but the last return the columns of ``documents``.

Null texts are empty in every stage: the classifier scores them as texts without words, near-dedup keeps them (they are linked with nothing), they hold
no benchmark item and no personal data, and have no tokens. Texts of any length are read whole. Rows with a null key are judged by their texts alone and
stay in near-dedup; rows repeated with key and text become one there. Of documents that near-dedup could keep, the one with the smallest key, then text hash,
stays. Other columns, whatever their names, are passed on until the last stage. An empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from packetloom.llm import bpe, decontam, near_dedup, pii, quality
from packetloom.session import Scratch, read_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is fitted on the labelled ones among them. Without labels of both kinds all score alike."""
    return quality.keep_good(docs, quality.fit_on(docs, read_table(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, similarity of 0.8 or more."""
    return near_dedup.keep_one(docs, words=5, percent=80)


def decontam_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; all of them where the benchmark is empty."""
    return decontam.clean(docs, read_table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind; null texts stay null, ``n_chars`` follows the text."""
    return pii.redact(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with digests of them and of the bytes they decode to."""
    return bpe.digest(bpe.encode(docs), "ids")


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontam_stage),
    ("PII", pii_stage),
    ("byte-level BPE encoding and decoding", bpe_stage),
]

#: No SQL expresses the classifier, the alignment or the tokenizer; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data directory."""
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
