"""The whole ingest of a corpus as one DataFrame job: validate, classify, plan, extract, chunk,
label, embed; then two tables, chunks and registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.functions import paths
from corpuslake.functions import text as tx
from corpuslake.operators import chunks, embedding, tables, validation


def write_chunks(chunks: DataFrame, path: str, collection: str = "collection", files: int | None = None) -> None:
    """Persist chunks as Parquet, a folder for each collection. The collections that ``chunks`` has are
    replaced whole, others stay, so that writing again gives the same tables. ``files`` deals each
    collection into about so many files by chunk_id; without it tasks write what they hold."""
    rows = chunks.repartition(files, collection, F.pmod(F.xxhash64("chunk_id"), F.lit(files))) if files else chunks
    rows.write.partitionBy(collection).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def ingest_corpus(files: DataFrame, registry: DataFrame, old_chunks: DataFrame | None = None, force: bool = False, store: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """Chunks and registry after ingesting ``files`` (path, text, length).

    Files that fail validation or give no chunk become error rows and keep their old chunks;
    unchanged files are skipped. The chunks of a file are replaced only when new ones exist.
    ``registry`` has path, sha256 and status. ``store`` may put the new chunks into a table, so that they
    are made once though both results need them.
    """
    hashed = files.withColumn("sha256", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    plan = tables.plan_ingest(hashed.select("path", "sha256"), registry, force)
    todo = hashed.join(plan.where("action <> 'no changes'").select("path"), "path", "left_semi")
    path, length = F.col("path"), F.col("length")
    checked = validation.validate(todo, [validation.check_exists(path, length), validation.check_extension(path), validation.check_size(length)], skip_warnings=True)
    labelled = paths.classified(checked.where("valid").select("path", "sha256", "text"))
    cut = chunks.chunk_recursive(labelled, *chunks.DEFAULT_SETTING)
    cut = chunks.number_chunks(cut, "path", "pos").drop("pos")
    labels = [F.col(c) for c in ("product", "module", "subsystem", "doc_type", "vendor")]
    made = cut.select(
        F.sha2(F.concat_ws("::", "path", F.col("chunk_index").cast("string"), "chunk"), 256).alias("chunk_id"), F.col("path").alias("source_file"), "chunk_index",
        F.col("chunk").alias("text"), "product", "doc_type", "vendor", "subsystem", "module", "version", tx.graph_id(path, F.col("product")).alias("doc_graph_id"),
        tx.topics(*labels).alias("graph_topics"), tx.related_hints(*labels).alias("graph_related"),
    )
    made = store(embedding.embed_distinct(made, "text").where("error IS NULL").drop("error"))
    done = made.groupBy(F.col("source_file").alias("path")).agg(F.count(F.lit(1)).alias("chunks"))
    reasons = validation.failure_reasons(checked, "path").groupBy("path").agg(F.min("reason").alias("reason"))
    state = todo.select("path", "sha256").join(done, "path", "left").join(reasons, "path", "left")
    fresh = state.select(
        "path", "sha256", F.when(F.col("chunks").isNotNull(), "ok").otherwise("error").alias("status"), F.coalesce("chunks", F.lit(0)).alias("chunks"),
        F.when(F.col("chunks").isNull(), F.coalesce("reason", F.lit("no content extracted"))).alias("error_msg"),
    )
    known = registry.select("path", "sha256", "status", *[F.col(c) if c in registry.columns else F.lit(None).cast(t).alias(c) for c, t in (("chunks", "long"), ("error_msg", "string"))])
    all_chunks = made if old_chunks is None else tables.replace_documents(old_chunks, made, "source_file")
    return all_chunks, tables.upsert(known, fresh, "path")
