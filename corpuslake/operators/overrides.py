"""Overrides of classified labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def apply_overrides(labels: DataFrame, by_file: DataFrame, by_folder: DataFrame, fields: list[str]) -> DataFrame:
    """``labels`` (path, folder, fields) with each field taken from the file's override
    (by path), else its folder's, else as it is; empty values override nothing."""
    files = by_file.select("path", *[F.nullif(F.col(f), F.lit("")).alias(f"{f}__file") for f in fields])
    folders = by_folder.select("folder", *[F.nullif(F.col(f), F.lit("")).alias(f"{f}__folder") for f in fields])
    out = labels.join(files, "path", "left").join(folders, "folder", "left")
    return out.select(*[c for c in labels.columns if c not in fields], *[F.coalesce(f"{f}__file", f"{f}__folder", f).alias(f) for f in fields])
