"""The registered queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers a query under the id of its operator, with its DuckDB text if there is one."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def big(c, name: str | None = None) -> Column:
    """As BIGINT under its own or a new name."""
    col = F.col(c) if isinstance(c, str) else c
    return col.cast("bigint").alias(name or c)


def r6(c, name: str | None = None) -> Column:
    """Rounded to six digits, so that the order of summation cannot show."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6).alias(name or c)
