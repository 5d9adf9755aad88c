"""Queries of operators 2 (toxicity) and 10 (quality classifier). Trained models have no SQL; tests hold them to held-out accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import common, quality, toxicity


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return toxicity.score_rows(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return quality.score_rows(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))


QUERIES = {"op2_toxicity": op2_toxicity, "op10_quality": op10_quality}
ORACLE_SQL: dict[str, str] = {}
