"""The queries of the library by name, with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assayer.plans import archived, kept, texts, weighing


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return weighing.QUERIES | texts.QUERIES | kept.QUERIES | archived.QUERIES


def oracle_sql() -> dict[str, str]:
    return weighing.SQL | texts.SQL | kept.SQL | archived.SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighing.verdicts(spark, sf_dir)
