"""Query of operator 13 (mixing). The tree's draws have no SQL; tests hold the query to plain sums and to the mix's own words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import common, mixing


def op13_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_rows(common.read(spark, sf_dir, "documents"))


QUERIES = {"op13_mix_sources": op13_mix_sources}
ORACLE_SQL: dict[str, str] = {}
