"""Remote documents as staged text: a header of ``key: value`` lines, ``---``, and the body."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe(part: Column) -> Column:
    """A path component: all but ASCII letters and digits become underscores."""
    return F.regexp_replace(part, "[^A-Za-z0-9]", "_")


def stage_documents(remote: DataFrame) -> DataFrame:
    """``remote`` (source_key, remote_id, remote_url, remote_mtime, html) with file_name and staged."""
    line = lambda k, c: F.concat(F.lit(f"{k}: "), F.col(c).cast("string"))
    staged = F.concat_ws("\n", line("source", "source_key"), line("url", "remote_url"), line("mtime", "remote_mtime"), F.lit("---"), "html")
    name = F.concat(F.concat_ws("__", "source_key", safe(F.col("remote_url")), "remote_id"), F.lit(".md"))
    return remote.withColumn("file_name", name).withColumn("staged", staged)


def parse_header(staged: Column) -> Column:
    """Map of the header: lines up to ``---``, split at the first colon."""
    head = F.substring_index(staged, "\n---\n", 1)
    lines = F.filter(F.split(head, "\n"), lambda x: x.contains(":"))
    pair = lambda x: F.struct(F.trim(F.regexp_extract(x, "^([^:]*):", 1)).alias("key"), F.trim(F.regexp_extract(x, "^[^:]*:(.*)$", 1)).alias("value"))
    return F.map_from_entries(F.transform(lines, pair))
