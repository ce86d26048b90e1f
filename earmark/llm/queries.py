"""One query for each operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    alignment,
    divergence,
    langid,
    license_scan,
    lm_scoring,
    mixing,
    near_dedup,
    packing,
    quality_rules,
    repeated_passages,
    secret_scan,
    topk,
    url_filters,
)
from .common import table

TOKENIZER = os.environ.get("EARMARK_TOKENIZER") or public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = os.environ.get("EARMARK_BYTE_TOKENIZER") or public_tokenizers.path("byte_bpe_50k.json")
PIECE_TOKENIZER = os.environ.get("EARMARK_PIECE_TOKENIZER") or public_tokenizers.path("piece_bpe_32k.model")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER, keep_bytes=256_000_000).select(
        "doc_id", "start", "length", F.crc32("ids_le").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset", "tier", "step_group",
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.query(table(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.query(table(spark, sf_dir, "documents"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.query(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.query(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.query(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.query(table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), BYTE_TOKENIZER, PIECE_TOKENIZER)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages.query(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_quality_rules": op2_quality_rules,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_url_filters": op4_url_filters,
    "op5_exact_topk": op5_exact_topk,
    "op6_mixing": op6_mixing,
    "op7_license_scan": op7_license_scan,
    "op8_language_id": op8_language_id,
    "op9_near_dedup": op9_near_dedup,
    "op10_secret_scan": op10_secret_scan,
    "op11_alignment": op11_alignment,
    "op12_source_divergence": op12_source_divergence,
    "op13_repeated_passages": op13_repeated_passages,
}

ORACLE: dict[str, str] = {
    "op4_url_filters": url_filters.ORACLE,
    "op5_exact_topk": topk.ORACLE,
    "op12_source_divergence": divergence.ORACLE,
    "op13_repeated_passages": repeated_passages.ORACLE,
}
