"""All core queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sievework.plans import analytics, cleaning, lookups, streams

Query = Callable[[SparkSession, str], DataFrame]


def flagship(spark: SparkSession, root: str) -> DataFrame:
    return analytics.score_jobs(spark, root)


def queries() -> dict[str, Query]:
    return {**cleaning.QUERIES, **analytics.QUERIES, **lookups.QUERIES, **streams.QUERIES}


def oracle_sql() -> dict[str, str]:
    return analytics.SQL | lookups.SQL | streams.SQL | cleaning.SQL
