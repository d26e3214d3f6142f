"""The corpus pipeline: quality rules, exact dedup, near dedup, secret scans and packing, one stage after another."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from nightloom.llm import common, exact_dedup, near_dedup, packing, quality, secrets
from nightloom.operators.graph import discard


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.drop_poor(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_copies(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.mask_secrets(docs, words=public_tokenizers.path("byte_bpe_50k.tiktoken"), length_col="n_chars")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("secrets", secret_stage), ("packing", packing_stage)]

#: The posterior, the signatures and the tokenizer are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table, each written as Parquet to the shared folder and read again.

    A stage's table is deleted once the next one is written; the last one stays for the result to be read. Rows that repeat an
    id are documents of their own, null texts are empty (and fail the quality rules), and no documents give no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = f"{common.shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}-{name}")
        docs = spark.read.parquet(f"{top}/{k}-{name}")
        if k:
            discard(spark, f"{top}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
