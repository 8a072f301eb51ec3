"""Registry of named queries and their DuckDB oracle SQL.

Each query is ``(spark, sf_dir) -> DataFrame``. The oracle is the same
query written as one SQL statement over the driver tables; queries whose
semantics are not expressible in SQL register no oracle and are checked by
unit tests against brute force instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
OPERATORS: dict[str, str] = {}
#: Queries too large to state in SQL; their operators are tested against brute force.
UNSTATED: dict[str, QueryFn] = {}


def query(name: str, covers: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register ``fn`` under ``name``; ``covers`` lists the SURVEY ids it exercises."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        OPERATORS[name] = covers
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return deco


def unstated(name: str) -> Callable[[QueryFn], QueryFn]:
    """Register ``fn`` under ``name`` without SQL."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES or name in UNSTATED:
            raise ValueError(f"duplicate query {name}")
        UNSTATED[name] = fn
        return fn

    return deco


def with_ctes(*ctes: str) -> str:
    """``WITH a AS (...), b AS (...)`` from CTE bodies."""
    return "WITH " + ",\n".join(c.strip().rstrip(",") for c in ctes if c.strip())
