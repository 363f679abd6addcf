"""The operators' queries, each over its whole table with production parameters, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import decontaminate, html_extract, language_id, media, near_dedup, packing, quality, substring_dedup, token_output, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op6_media_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no audio: every vector of ``embeddings`` is sounded as a WAV value first."""
    return media.fingerprints(media.sound(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "vec_id", "wav")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_table(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are scored; the result holds those found toxic."""
    return toxicity.detect(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).filter("toxic")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


_ALL = (op1_best_fit_packing, op2_substring_dedup, op3_language_id, op4_quality_classifier, op5_html_extraction, op6_media_fingerprints, op7_simhash_near_dedup, op8_token_output, op9_toxicity, op10_benchmark_decontamination)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
ORACLES: dict[str, str] = {"op2_substring_dedup": substring_dedup.ORACLE}
