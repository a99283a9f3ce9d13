"""Registered queries: one Spark DataFrame builder per operator key, plus its oracle SQL.

``QUERIES[key](spark, sf_dir) -> DataFrame`` and ``ORACLE[key] -> DuckDB SQL`` over the
driver's tables. Keys without an oracle are checked by row count only (and by our tests).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from tarmac.registry import batch, metrics_q, ml, io_q, stream_q  # noqa: F401
