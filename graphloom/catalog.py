"""Names of all queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import queries as _plans


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiered entity lookup with provenance."""
    return _plans.QUERIES["q1_find_entity_contains"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_plans.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_plans.SQL)
