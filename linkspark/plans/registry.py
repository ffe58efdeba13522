"""All queries of the library and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from linkspark.plans import record_queries, table_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(record_queries.QUERIES) | table_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return dict(record_queries.SQL) | table_queries.SQL
