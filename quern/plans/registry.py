"""The core queries by name and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.operators import answer, chunking, evaluate, guard, index, library, orphans, retrieve, vector
from quern.plans import relational, scalar, surface, upkeep
from quern.streaming import sync

_MODULES = [orphans, scalar, relational, chunking, vector, retrieve, guard, answer, evaluate, library, index, sync, surface, upkeep]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}


def entry(spark: SparkSession, d: str) -> DataFrame:
    return queries()["v15_hybrid_search"](spark, d)
