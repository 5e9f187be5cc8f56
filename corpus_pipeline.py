"""The corpus pipeline: five stages from raw documents to a mixed training corpus.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's documents. All but the last return the columns of
documents. Every stage works on the whole of what the one before it kept:

1. quality: documents that the classifier rejects (score below 0.7) go;
2. near_duplicates: of documents linked by a similarity of 0.8 or more on five-word shingles
   the one with the least id stays;
3. substrings: words covered by a repeated window of 35 words go from the texts;
4. decontaminate: documents contaminated by the benchmark go;
5. mix: every document gets the number of its words that the mix takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.llm.common import finished, released, table
from corpuslake.llm.decontaminate import clean_rows
from corpuslake.llm.mixing import mix_sources
from corpuslake.llm.quality import quality_scores
from corpuslake.llm.similar import similar_texts_removed
from corpuslake.llm.substrings import substring_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score 0.7 or more. Null and empty texts are scored too; equal rows alike. Without
    labels every row scores alike. Empty input gives empty output."""
    return quality_scores(docs, table(spark, sf_dir, "labels"), keep=COLUMNS).where("score >= 0.7").select(*COLUMNS)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, that of the least id; a null id loses to any other, and of equal
    rows one stays. Null texts and texts without a word are alike."""
    return similar_texts_removed(docs.select(*COLUMNS))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go; n_chars follows the text that is left. A null text stays null with
    n_chars null, an empty one empty; equal rows stay, without what their windows cover."""
    left = substring_dedup(docs, keep=("doc_id", "lang", "source"), with_text=True)
    return left.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Clean rows stay as they are, null and empty texts and equal rows among them. Without a
    benchmark all stay."""
    return clean_rows(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with the words that the mix takes of it; a null text has none to take, and null is a
    source of its own."""
    return mix_sources(docs, keep=COLUMNS)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicate),
    ("substrings", substrings),
    ("decontaminate", decontaminate),
    ("mix", mix),
]

#: A factorisation machine, min-hashes and graph components are beyond SQL; tests/llm holds the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage stores on the way is deleted once its rows are written,
    and those once the next stage's are."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        after = finished(f"stage-{name}", lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        if before is not None:
            released(before)
        before = docs = after
    return docs
