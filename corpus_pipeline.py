"""The corpus pipeline: documents to packed sequences, in stages that are each written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.near_dup import NearDupParams, near_duplicates
from tessel.llm.packing import pack
from tessel.llm.quality import keep_good
from tessel.llm.secrets import redact
from tessel.llm.substring import drop_repeats
from tessel.runtime import cut, drop_table, ids_side, input_table, one_map


def _like(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the text as it is now."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else df.select(docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    one_map(spark)
    return keep_good(docs).select(docs.columns)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near duplicates (five words, 0.8)."""
    one_map(spark)
    gone = cut(near_duplicates(docs, NearDupParams()).where("NOT kept").select("doc_id"), "pipeline-gone")
    return docs.join(ids_side(gone), "doc_id", "left_anti").select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words that an earlier document has; one that loses all its words stays, empty."""
    one_map(spark)
    return _like(drop_repeats(docs), docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets replaced by a mark."""
    one_map(spark)
    return _like(redact(docs), docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    one_map(spark)
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", minhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the covariance steps, the tokenizer or the linear program; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage makes of documents; the table of each stage before it lies in the shared folder."""
    docs = input_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_table(before)
    return STAGES[-1][1](spark, docs, sf_dir)
