"""Golden datasets from files, and metadata overrides."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.functions.text import stripped

GOLDEN = "query string, expected_answer string, expected_docs array<string>, metadata map<string,string>"
OVERRIDE = "doc_type string, product string, vendor string, subsystem string, module string"
DELIMITERS = (",", ";", "\t")


def load_golden_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of examples, or several by a pattern; only ``.json`` is taken. A file that is not there gives no example."""
    if not path.endswith(".json"):
        raise ValueError("golden datasets are .json or .csv")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at):
        return spark.createDataFrame([], GOLDEN)
    return spark.read.schema(GOLDEN).option("multiLine", True).json(path)


def add_examples(golden: DataFrame, new: DataFrame) -> DataFrame:
    """``golden`` and the examples of ``new``; columns that ``new`` lacks are null."""
    return golden.unionByName(new, allowMissingColumns=True).select(*golden.columns)


def save_golden(golden: DataFrame, path: str) -> None:
    """Write examples as lines of JSON, which ``spark.read.schema(GOLDEN).json`` reads again."""
    golden.write.mode("overwrite").json(path)


def delimiter_of(head: str) -> str:
    """The delimiter that the first line that is not blank has most of, outside quotes; a comma if it has none."""
    line = next((x for x in head.splitlines() if x.strip()), "")
    bare = re.sub(r'"(?:[^"]|"")*(?:"|$)', "", line)
    return max(DELIMITERS, key=bare.count)


def load_golden_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header; quoted fields may hold line breaks. The delimiter is the one that the header has
    most of. Texts are stripped, lists of documents are split at commas; metadata that is no JSON object is
    kept under ``raw``, missing metadata is empty."""
    first = spark.read.text(path, lineSep="\n").where(F.trim("value") != "").first()
    if first is None:
        raise ValueError("empty file")
    sep = delimiter_of(first[0])
    rows = spark.read.options(header=True, sep=sep, escape='"', multiLine=True, ignoreLeadingWhiteSpace=False, enforceSchema=False).csv(path)
    for need in ("query", "expected_answer"):
        if need not in rows.columns:
            raise ValueError(f"no column {need}")
    text = lambda c: stripped(F.coalesce(F.col(c), F.lit(""))) if c in rows.columns else F.lit("")
    listed = F.filter(F.transform(F.split(text("expected_docs"), ","), stripped), lambda x: x != "")
    meta = text("metadata")
    kept = F.coalesce(F.from_json(meta, "map<string,string>"), F.create_map(F.lit("raw"), meta))
    none = F.create_map().cast("map<string,string>")
    return rows.select(text("query").alias("query"), text("expected_answer").alias("expected_answer"), listed.alias("expected_docs"), F.when(meta != "", kept).otherwise(none).alias("metadata"))


def parse_overrides(raw: DataFrame, doc_types: tuple[str, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Folder overrides, file overrides and rejects of ``_meta.json`` texts (folder, value): each an
    object with ``defaults`` and ``files``. Rows with an unknown doc_type and texts that are no JSON
    are rejects. ``landed.scan_overrides`` reads such texts from files."""
    one = raw.withColumn("m", F.from_json("value", f"defaults struct<{', '.join(c.replace(' ', ':', 1) for c in OVERRIDE.split(', '))}>, files map<string,struct<{', '.join(c.replace(' ', ':', 1) for c in OVERRIDE.split(', '))}>>"))
    folders = one.where("m.defaults IS NOT NULL").select("folder", "m.defaults.*")
    files = one.select("folder", F.explode("m.files").alias("name", "o")).select(F.concat("folder", F.lit("/"), "name").alias("path"), "o.*")
    known = F.col("doc_type").isNull() | F.col("doc_type").isin(*doc_types)
    rejects = one.where("m IS NULL OR (m.defaults IS NULL AND m.files IS NULL)").select(F.col("folder").alias("path"), F.lit("not readable").alias("reason"))
    for df, key in ((folders, "folder"), (files, "path")):
        rejects = rejects.unionByName(df.where(~known).select(F.col(key).alias("path"), F.lit("unknown doc_type").alias("reason")))
    return folders.where(known), files.where(known), rejects
