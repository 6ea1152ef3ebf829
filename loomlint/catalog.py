"""All queries of the library but those for training data, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import driver_queries


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over the lines of documents: the matches that the project score is made of."""
    return driver_queries.QUERIES["q_rule_theta_scan"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(driver_queries.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(driver_queries.SQL)
