"""All queries of the library with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function of (spark, sf_dir) under a name, with equivalent SQL if there is any."""

    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def oracle(name: str, sql: str) -> None:
    """SQL for a query that is registered without any."""
    if name not in _QUERIES or name in _SQL:
        raise KeyError(name)
    _SQL[name] = sql


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difficult words of each language: scan, tokens, lemmas, dictionary join, marks, levels."""
    return queries()["jn04_difficult_words"](spark, sf_dir)


def _load() -> None:
    """Modules that register queries, in the order in which they are listed."""
    import importlib

    for name in ("term_queries", "text_queries", "metric_queries", "custom_queries", "book_queries", "state_queries", "oracles"):
        importlib.import_module(f"quire.plans.{name}")
