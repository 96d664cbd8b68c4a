"""Queries of this subpackage over whole tables, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, html_extract, language, line_dedup, near_dedup, quality, secret_scan, top_k, toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(_read(spark, sf_dir, "embeddings"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.removal_spans(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_read(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_passages(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deleted_lines(_read(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(_read(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_read(spark, sf_dir, "pages"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_read(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_top_k": op1_top_k,
    "op2_decontamination": op2_decontamination,
    "op3_language_id": op3_language_id,
    "op4_toxicity": op4_toxicity,
    "op5_quality": op5_quality,
    "op6_line_dedup": op6_line_dedup,
    "op7_secret_scan": op7_secret_scan,
    "op8_html_extraction": op8_html_extraction,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_byte_bpe": op10_byte_bpe,
}

ORACLE_SQL: dict[str, str] = {
    "op1_top_k": top_k.ORACLE_SQL,
    "op2_decontamination": decontaminate.ORACLE_SQL,
    "op6_line_dedup": line_dedup.ORACLE_SQL,
    "op7_secret_scan": secret_scan.ORACLE_SQL,
}
