"""The registered queries of the corpus operators, with SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightloom.llm import bpe, clusters, conversations, exact_dedup, html_text, mixing, near_dedup, oracle, packing, quality, secrets, shards, token_files, warc


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(documents(spark, sf_dir)).drop("first")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(pages(spark, sf_dir))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.read_archives(warc.write_archives(pages(spark, sf_dir)), with_data=False).filter("is_last")
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_tokens(files, digests=True)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_classes(documents(spark, sf_dir))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digested(secrets.scanned(documents(spark, sf_dir), words=public_tokenizers.path("byte_bpe_50k.tiktoken")))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability"]
    return quality.judged(documents(spark, sf_dir)).select(*columns)


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.sharded(documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversations.audited(conversations.damaged(rows), rows)


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.planned(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))[0]


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_html_text": op2_html_text,
    "op3_warc": op3_warc,
    "op4_token_files": op4_token_files,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_secret_scan": op6_secret_scan,
    "op7_quality_rules": op7_quality_rules,
    "op8_shards": op8_shards,
    "op9_packing": op9_packing,
    "op10_bpe": op10_bpe,
    "op11_repair": op11_repair,
    "op12_mixing": op12_mixing,
    "op13_clusters": op13_clusters,
}

ORACLE_SQL = oracle.ORACLE_SQL | {
    "op5_exact_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
             b AS (SELECT doc_id, length(t) AS n, sha256(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM d),
             r AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
                          count(*) OVER (PARTITION BY text_sha256) AS group_size FROM b)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
    """,
}
