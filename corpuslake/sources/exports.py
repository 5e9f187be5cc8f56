"""Exports of the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def select_registry(registry: DataFrame, **filters: str | None) -> DataFrame:
    """Rows that equal every given value; a filter on a column that is not there is an error."""
    for name, value in filters.items():
        if name not in registry.columns:
            raise ValueError(f"no column {name}")
        if value is not None:
            registry = registry.where(F.col(name) == value)
    return registry


def export_registry(registry: DataFrame, path: str, kind: str = "json", **filters: str | None) -> None:
    """Write the selected rows as JSON lines or as CSV with a header."""
    chosen = select_registry(registry, **filters)
    if kind == "json":
        chosen.write.json(path)
    elif kind == "csv":
        chosen.write.option("header", True).csv(path)
    else:
        raise ValueError("kind must be json or csv")
