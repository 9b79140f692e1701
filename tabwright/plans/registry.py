"""Query registry: key -> Spark callable (spark, sf_dir) -> DataFrame, and key -> oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the equivalent DuckDB statement over the driver's tables
    (omitted for operators with no SQL equivalent, e.g. model fitting)."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query key {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    # Importing the catalog modules registers their queries.
    from tabwright.plans import q_prep, q_profile, q_sequence, q_models  # noqa: F401
