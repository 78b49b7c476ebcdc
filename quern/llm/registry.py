"""The queries on training corpora by name and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import boilerplate, contamination, mixing, mojibake, neardup, spans, split, tokenizer

_MODULES = [boilerplate, contamination, mojibake, split, neardup, tokenizer, mixing, spans]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}
