"""Registry of named queries and their DuckDB oracle SQL.

Each query is a callable ``(spark, sf_dir) -> DataFrame`` over the driver
tables; the oracle, when the result can be stated in SQL, is a string
DuckDB runs over the same tables (registered as views).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    """Decorator: add a query under ``key`` with an optional oracle SQL."""

    def wrap(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise KeyError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql.strip()
        return fn

    return wrap


def sql_list(values) -> str:
    """SQL literal list ``('a', 'b')`` for IN clauses."""
    return "(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + ")"
