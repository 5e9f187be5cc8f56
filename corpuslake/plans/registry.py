"""Registered queries of the library and their SQL twins."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpuslake.plans.views import oracle

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}
MODULES = ("logs", "corpus", "maintenance", "retrieval", "governance", "evaluation", "streams", "sources")


def query(sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under its name, with SQL that DuckDB runs on the same tables."""
    def add(fn: Callable) -> Callable:
        _QUERIES[fn.__name__] = fn
        if sql:
            _SQL[fn.__name__] = oracle(sql)
        return fn

    return add


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"corpuslake.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk counts and sizes by product and type of the whole corpus."""
    return queries()["e2_chunk_fixed_keep"](spark, sf_dir)
