"""Registered queries and the DuckDB text each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register a ``(spark, sf_dir) -> DataFrame`` function under ``key``."""

    def add(fn: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return add


def r6(value: Column | str, name: str | None = None) -> Column:
    """Rounded for comparison across engines, where sums run in another order."""
    column = F.col(value) if isinstance(value, str) else value
    rounded = F.round(column, 6)
    label = name or (value if isinstance(value, str) else None)
    return rounded.alias(label) if label else rounded


def q6(expr: str) -> str:
    """The same in SQL; adding 0 turns -0.0 into 0.0."""
    return f"(round({expr}, 6) + 0)"
