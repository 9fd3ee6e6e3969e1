"""Names of all queries over the driver's tables, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import assembly_queries, case_queries, forecast_queries, generator_queries, model_queries, scoring_queries, segment_queries, stream_queries

_PARTS = [scoring_queries, segment_queries, assembly_queries, generator_queries, case_queries, forecast_queries, model_queries, stream_queries]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["gmean_mase"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for part in _PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for part in _PARTS for name, text in part.ORACLE.items()}
