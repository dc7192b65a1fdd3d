"""Registered queries of the document engine and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vellumspark.plans import exchange, extraction, folds, lookups, records, trees

_MODULES = (extraction, records, trees, lookups, folds, exchange)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query."""
    return extraction.QUERIES["v7_hybrid_search"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every registered query by name."""
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Oracle SQL by query name."""
    found = [(k, s) for m in _MODULES for k, s in m.ORACLE.items()]
    if len(dict(found)) < len(found):
        raise ValueError("a query has two oracles")
    return dict(found)
