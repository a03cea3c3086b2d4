"""All registered queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from steadyield.plans import audit_queries, data_queries, file_queries, landing_queries, screener_queries, screener_sql

MODULES = (screener_queries, data_queries, landing_queries, file_queries, audit_queries)
TEXTS = (screener_sql, data_queries, landing_queries, file_queries, audit_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for m in MODULES for name, query in m.registered().items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for m in TEXTS for name, text in m.SQL.items()}
