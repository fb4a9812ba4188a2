"""Registry of runnable queries and of the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.plans.views import view

ViewReader = Callable[[str], DataFrame]
Query = Callable[[ViewReader], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, query: Query, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle is not None:
        ORACLES[name] = oracle


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return QUERIES[name](lambda n: view(spark, folder, n))
