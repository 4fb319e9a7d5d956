"""Registered queries: each a function (spark, folder) -> DataFrame with the SQL that DuckDB runs for the same rows, or None."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rate_sql(n: str, d: str) -> str:
    """SQL of the exact rate to three places, halves to even."""
    n, d = f"({n})::BIGINT", f"({d})::BIGINT"
    q, r = f"({n} * 1000 // nullif({d}, 0))", f"({n} * 1000 % nullif({d}, 0))"
    return f"CASE WHEN {d} > 0 THEN ({q} + CASE WHEN 2 * {r} > {d} OR (2 * {r} = {d} AND {q} % 2 = 1) THEN 1 ELSE 0 END) / 1000.0 ELSE 0.0 END::DOUBLE"
