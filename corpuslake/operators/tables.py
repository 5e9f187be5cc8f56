"""Maintenance of chunk tables and registries, as transforms from snapshot to snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.functions.text import stripped


def upsert(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """Rows of ``new``, and rows of ``old`` whose key is not in ``new``."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def replace_documents(old: DataFrame, new: DataFrame, document: str) -> DataFrame:
    """All chunks of documents that ``new`` has chunks of are replaced by those."""
    return old.join(new.select(document).distinct(), document, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def matching(frame: DataFrame, filters: dict[str, object]) -> DataFrame:
    """Rows that equal every given value."""
    for k, v in filters.items():
        frame = frame.where(F.col(k).eqNullSafe(F.lit(v)))
    return frame


def parse_filter(text: str) -> dict[str, str]:
    """``k=v,k=v`` as a dictionary; anything else is an error."""
    out = {}
    for part in filter(None, (p.strip() for p in text.split(","))):
        k, eq, v = part.partition("=")
        if not eq or not k.strip():
            raise ValueError(f"not key=value: {part}")
        out[k.strip()] = v.strip()
    return out


def delete_by_filter(frame: DataFrame, filters: dict[str, object]) -> DataFrame:
    keep = F.lit(False)
    for k, v in filters.items():
        keep = keep | ~F.col(k).eqNullSafe(F.lit(v))
    return frame.where(keep)


def update_fields(frame: DataFrame, updates: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Each field takes the value in ``updates`` (one row for each key) where that is not null."""
    new = updates.select(*key, *[F.col(f).alias(f"{f}__new") for f in fields])
    out = frame.join(new, list(key), "left")
    return out.select(*[F.coalesce(f"{c}__new", c).alias(c) if c in fields else F.col(c) for c in frame.columns])


def valid_tags(tags: Column, longest: int = 50, most: int = 20) -> tuple[Column, Column]:
    """Trimmed, lower-cased, non-empty tags, each once in order; and an error, null if none."""
    clean = F.array_distinct(F.filter(F.transform(tags, lambda t: F.lower(stripped(t))), lambda t: t != ""))
    error = (
        F.when(F.exists(clean, lambda t: F.length(t) > longest), "tag too long").when(F.exists(clean, lambda t: t.rlike(r"\s")), "tag with white space")
        .when(F.size(clean) > most, "too many tags")
    )
    return clean, error


def edited_tags(tags: Column, add: Column, remove: Column, most: int = 20) -> tuple[Column, Column]:
    """Tags with those to add that are new, then without those to remove; and an error where they are too many."""
    out = F.array_except(F.array_distinct(F.concat(tags, add)), remove)
    return out, F.when(F.size(out) > most, "too many tags")


def tag_counts(registry: DataFrame, tags: str) -> DataFrame:
    """Documents of each tag, and its products and types, sorted."""
    each = registry.select(F.explode(F.array_distinct(tags)).alias("tag"), "product", "doc_type")
    labels = lambda c: F.substring(F.array_join(F.array_sort(F.collect_set(c)), ", "), 1, 30).alias(f"{c}s")
    return each.groupBy("tag").agg(F.count(F.lit(1)).alias("documents"), labels("product"), labels("doc_type"))


def field_changes(stored: DataFrame, fresh: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field_name, old_value, new_value, chunk_count) of each field that a fresh
    classification changes; documents without one are skipped. ``stored`` has chunk_count."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"s.{f}").alias("old_value"), F.col(f"f.{f}").alias("new_value")) for f in fields])
    both = stored.alias("s").join(fresh.alias("f"), key).select(key, "s.chunk_count", F.explode(pairs).alias("c"))
    return both.where(~F.col("c.old_value").eqNullSafe(F.col("c.new_value"))).select(key, "c.*", "chunk_count")


def sessions(history: DataFrame) -> DataFrame:
    """Documents and field changes of each session."""
    return history.groupBy("session_timestamp").agg(F.countDistinct("source_file").alias("documents"), F.count(F.lit(1)).alias("changes"))


def old_values(backups: DataFrame, key: str) -> DataFrame:
    """(key, field_name, old_value): of each field the value of the latest session; of equal sessions the largest."""
    return backups.groupBy(key, "field_name").agg(F.max(F.struct("session_timestamp", "old_value")).alias("m")).select(key, "field_name", F.col("m.old_value").alias("old_value"))


def restore(frame: DataFrame, backups: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """``frame`` with the old values of ``backups`` put back."""
    wide = old_values(backups, key).groupBy(key).pivot("field_name", list(fields)).agg(F.first("old_value"))
    return update_fields(frame, wide, [key], fields)


def glob_pattern(glob: str) -> str:
    """Anchored regular expression of a glob of ``*`` and ``?``."""
    special = set(r".^$+{}[]|()\\")
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if c in special else c for c in glob) + "$"


def plan_ingest(files: DataFrame, registry: DataFrame, force: bool = False, compat: bool = False) -> DataFrame:
    """(path, action) of each file (path, sha256) against the registry (path, sha256, status).

    Files that the registry calls deleted or pending are ingested again; with ``compat`` they
    count as unchanged if their content is.
    """
    known = registry.select("path", F.col("sha256").alias("known"), "status")
    again = F.lit(False) if compat else F.col("status").isin("deleted", "pending")
    action = (
        F.when(F.lit(force), "forced").when(F.col("known").isNull(), "new").when(F.col("status") == "error", "previous error - retrying")
        .when(F.col("known") != F.col("sha256"), "content modified").when(again, F.concat(F.lit("status "), F.col("status"))).otherwise("no changes")
    )
    return files.join(known, "path", "left").select("path", action.alias("action"))


def mark_missing(registry: DataFrame, scan: DataFrame) -> DataFrame:
    """Status ``deleted`` for ok rows whose path the scan does not have."""
    present = scan.select("path").distinct().withColumn("present", F.lit(True))
    gone = (F.col("status") == "ok") & F.col("present").isNull()
    out = registry.join(present, "path", "left").withColumn("status", F.when(gone, "deleted").otherwise(F.col("status")))
    return out.select(*registry.columns)


def mark_errors(registry: DataFrame, errors: DataFrame) -> DataFrame:
    """Status and message (cut to 500 characters) of failed files: rows that are known keep the rest."""
    new = errors.select("path", F.substring("message", 1, 500).alias("message"))
    out = registry.join(new, "path", "full_outer")
    out = out.withColumn("status", F.when(F.col("message").isNotNull(), "error").otherwise(F.col("status"))).withColumn("error_msg", F.coalesce("message", "error_msg"))
    return out.withColumn("chunks", F.coalesce("chunks", F.lit(0).cast("long"))).select(*registry.columns)


def registry_summary(registry: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    return registry.agg(
        F.count(F.lit(1)).alias("total"), n("ok").alias("ok"), n("error").alias("errors"), n("deleted").alias("deleted"),
        F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.min("indexed_at").alias("first_indexed"), F.max("indexed_at").alias("last_indexed"),
    )


def per_source(registry: DataFrame) -> DataFrame:
    """Files, ok, errors, chunks and last time by first path part, and a total row."""
    source = F.when(F.instr("path", "/") > 0, F.substring_index("path", "/", 1)).otherwise("(root)")
    out = registry.withColumn("source", source).rollup("source").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "error").alias("errors"),
        F.sum("chunks").alias("chunks"), F.max("indexed_at").alias("last_indexed"), F.grouping("source").alias("g"),
    )
    return out.withColumn("source", F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("source"))).drop("g")


def status_counts(frame: DataFrame, statuses: Sequence[str]) -> DataFrame:
    """Rows of each named status, zero where there is none."""
    spark = frame.sparkSession
    wanted = spark.createDataFrame([(s,) for s in statuses], "status string")
    found = frame.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(found, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def page(frame: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    return frame.orderBy(*order).offset(offset).limit(limit)


def duplicates(files: DataFrame) -> DataFrame:
    """(sha256, n, first_path) of contents that several files have."""
    return files.groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path")).where("n > 1")


def latest_checkpoints(state: DataFrame) -> DataFrame:
    """Latest checkpoint that is not null of each source by time, ties to the largest."""
    known = state.where("checkpoint IS NOT NULL")
    return known.groupBy("source_key").agg(F.max(F.struct("ingested_at", "checkpoint")).alias("m")).select("source_key", F.col("m.checkpoint").alias("checkpoint"))


def next_checkpoints(remote: DataFrame) -> DataFrame:
    """Latest modification of each source as ISO time in seconds, UTC."""
    iso = F.date_format(F.timestamp_seconds(F.max("remote_mtime")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return remote.where("remote_mtime IS NOT NULL").groupBy("source_key").agg(iso.alias("checkpoint"))


def newest(frame: DataFrame, by: str, key: str, limit: int | None = None) -> DataFrame:
    out = frame.orderBy(F.desc(by), key)
    return out.limit(limit) if limit else out


def first_of(frame: DataFrame, key: str, order: str) -> DataFrame:
    """One row of each key: the least by ``order``."""
    rest = [c for c in frame.columns if c != key]
    return frame.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("r"), F.count(F.lit(1)).alias("rows")).select(key, "r.*", "rows")


def runs_of(frame: DataFrame, key: str, order: Sequence[str], flag: Column) -> DataFrame:
    """Unbroken runs of rows with ``flag``: (key, first, last, n) by the columns ``order``."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = frame.withColumn("flag", F.coalesce(flag, F.lit(False))).withColumn("r", F.row_number().over(w))
    good = marked.where("flag").withColumn("island", F.col("r") - F.row_number().over(w))
    return good.groupBy(key, "island").agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count(F.lit(1)).alias("n")).drop("island")


def extractor_audit(outcomes: DataFrame, kind: str, worst: int = 5) -> DataFrame:
    """Of each kind of file: percent read by the first extractor, by the second, by none, mean
    seconds, and the largest files that none could read."""
    lost = ~F.col("first") & ~F.col("second")
    share = lambda c: F.round(100.0 * F.count_if(c) / F.count(F.lit(1)), 4)
    order = Window.partitionBy(kind).orderBy(F.desc("file_size"), "path")
    top = outcomes.where(lost).withColumn("r", F.row_number().over(order)).where(F.col("r") <= worst)
    top = top.groupBy(kind).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "path"))), lambda x: x["path"]), ",").alias("largest_failures"))
    found = outcomes.groupBy(kind).agg(
        F.count(F.lit(1)).alias("files"), share(F.col("first")).alias("primary_share"), share(~F.col("first") & F.col("second")).alias("fallback_share"),
        share(lost).alias("failed_share"), F.round(F.avg("seconds"), 4).alias("mean_seconds"),
    )
    return found.join(top, kind, "left").withColumn("largest_failures", F.coalesce("largest_failures", F.lit("")))


def cancel_reingest(registry: DataFrame, paths: DataFrame) -> DataFrame:
    """``registry`` with those of ``paths`` (path) that wait for a new ingest back at ``ok``."""
    chosen = paths.select("path").distinct().withColumn("__chosen", F.lit(True))
    back = F.when(F.col("__chosen") & (F.col("status") == "pending"), "ok").otherwise(F.col("status"))
    return registry.join(chosen, "path", "left").withColumn("status", back).select(*registry.columns)


def queue_reingest(chunks: DataFrame, registry: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks without those of ``paths`` (path), and the registry with these waiting for a new ingest."""
    chosen = paths.select("path").distinct()
    left = chunks.join(chosen.withColumnRenamed("path", "source_file"), "source_file", "left_anti").select(*chunks.columns)
    marked = registry.join(chosen.withColumn("__chosen", F.lit(True)), "path", "left")
    return left, marked.withColumn("status", F.when(F.col("__chosen"), "pending").otherwise(F.col("status"))).select(*registry.columns)


def delete_with_status(registry: DataFrame, *statuses: str) -> DataFrame:
    """``registry`` without the rows of these statuses (a null status is none of them); with none given, without any row."""
    return registry.where(~F.coalesce(F.col("status").isin(*statuses), F.lit(False))) if statuses else registry.where(F.lit(False))


def connector_get(state: DataFrame, source_key: str, remote_id: str) -> DataFrame:
    """The state of one remote document: one row or none."""
    return state.where((F.col("source_key") == source_key) & (F.col("remote_id") == remote_id))


def connector_delete(state: DataFrame, gone: DataFrame) -> DataFrame:
    """``state`` without the documents of ``gone`` (source_key, and remote_id where only one is meant: null stands for all of a source)."""
    one = gone.where("remote_id IS NOT NULL").select("source_key", "remote_id").distinct()
    whole = gone.where("remote_id IS NULL").select("source_key").distinct()
    return state.join(one, ["source_key", "remote_id"], "left_anti").join(whole, "source_key", "left_anti").select(*state.columns)


def prune_older(log: DataFrame, now: Column, days: int, ts: str = "ts") -> DataFrame:
    """Rows of the last ``days`` before ``now``."""
    return log.where(F.col(ts).cast("timestamp") >= now - F.make_interval(days=F.lit(days)))
