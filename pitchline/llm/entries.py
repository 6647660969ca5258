"""Queries of the corpus operators over the tables in a folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .compact_windows import repeated_passages
from .divergence import DIVERGENCE_SQL, source_divergence
from .exact_dedup import EXACT_SQL, exact_duplicates
from .licenses import license_report
from .line_dedup import LINE_SQL, line_report
from .logbilinear import language_scores
from .minmax_dedup import NEAR_SQL, near_duplicates
from .mixing import mix_report
from .nbsvm import quality_scores
from .packing import packed
from .quality_rules import QUALITY_SQL, quality_report
from .toxicity import toxicity_scores
from .word_runs import run_report


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_report(table(spark, sf_dir, "documents"))


def op12_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_exact_dedup, op3_mixing, op4_line_dedup, op5_license_scan, op6_substring_dedup, op7_toxicity, op8_minmax_near_dedup, op9_best_fit_packing, op10_quality_classifier, op11_periodic_runs, op12_log_bilinear, op13_source_divergence)}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": QUALITY_SQL, "op2_exact_dedup": EXACT_SQL, "op4_line_dedup": LINE_SQL, "op8_minmax_near_dedup": NEAR_SQL, "op13_source_divergence": DIVERGENCE_SQL}
