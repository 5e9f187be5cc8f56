"""Chunking of texts and what is attached to chunks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from corpuslake.functions.text import SPACE, stripped, terms
from corpuslake.sources.batches import BATCH_BYTES, cuts

# Chunk size and overlap by file type.
CHUNK_SETTINGS = {"pdf": (800, 100), "docx": (700, 80), "xlsx": (500, 50), "pptx": (600, 80), "txt": (600, 80), "code": (400, 60)}
DEFAULT_SETTING = (600, 80)
SHORTEST = 30


def windows(text: Column, size, overlap) -> Column:
    """Sliding windows of ``size`` characters, each beginning max(1, size - overlap) after the last."""
    size, overlap = (x if isinstance(x, Column) else F.lit(x) for x in (size, overlap))
    step = F.greatest(F.lit(1), size - overlap)
    starts = F.sequence(F.lit(0), F.length(text) - 1, step)
    return F.when(F.length(text) > 0, F.transform(starts, lambda s: F.substring(text, s + 1, size))).otherwise(F.array().cast("array<string>"))


def chunk_fixed(sections: DataFrame, size: int, overlap: int, shortest: int = SHORTEST) -> DataFrame:
    """The rows of ``sections``, one for each window of its text, with pos and chunk; windows of
    fewer than ``shortest`` characters are dropped (0 keeps all)."""
    out = sections.select(*[c for c in sections.columns if c != "text"], F.posexplode(windows(F.col("text"), size, overlap)).alias("pos", "chunk"))
    return out.where(F.length("chunk") >= shortest) if shortest else out


def settings_by_type(file_type: Column) -> tuple[Column, Column]:
    """Chunk size and overlap of a file type."""
    def pick(i: int) -> Column:
        known = F.create_map(*[F.lit(x) for k, v in CHUNK_SETTINGS.items() for x in (k, v[i])])
        return F.coalesce(F.try_element_at(known, file_type), F.lit(DEFAULT_SETTING[i]))

    return pick(0), pick(1)


def split_semantic(text: str, words: int) -> list[str]:
    """As ``chunk_semantic``, for one text."""
    out: dict[int, list[str]] = {}
    before = 0
    for para in text.split("\n"):
        if para.strip():
            out.setdefault(before // words, []).append(para)
            before += len(para.split())
    return ["\n".join(out[i]) for i in sorted(out)]


def create_strategy(name: str, **options: int) -> Callable[[str, str], list[str]]:
    """A function from (text, file type) to chunks: ``fixed`` or its alias ``overlap``, ``recursive``, or
    ``semantic``; any other name is an error. options: chunk_size, chunk_overlap (or overlap), max_tokens."""
    size, overlap = options.get("chunk_size", 600), options.get("chunk_overlap", options.get("overlap", 80))
    if name in ("fixed", "overlap"):
        return lambda text, _: [text[i : i + size] for i in range(0, len(text), max(1, size - overlap))]
    if name == "recursive":
        return lambda text, _: split_recursive(text, size, overlap)
    if name == "semantic":
        return lambda text, _: split_semantic(text, options.get("max_tokens", 512))
    raise ValueError(f"unknown strategy: {name}")


def chunk_with(sections: DataFrame, split: Callable[[str, str], list[str]], file_type: str | None = None) -> DataFrame:
    """The rows of ``sections``, one for each chunk that a strategy makes of its text (in Arrow
    batches), with pos and chunk; chunks shorter than SHORTEST once stripped are dropped."""
    kind = F.col(file_type) if file_type else F.lit("txt")
    cut = _cutter(lambda text, kind: [c for c in split(text, kind) if len(c.strip()) >= SHORTEST])
    return sections.select(*[c for c in sections.columns if c != "text"], F.posexplode(cut("text", kind)).alias("pos", "chunk"))


def _cutter(split: Callable[[str, str], list[str]]):
    """A function of text and file type columns to arrays of chunks; of a batch some bytes of texts are taken at a time."""
    @F.arrow_udf("array<string>")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, kinds in batches:
            for at, end in cuts(texts, BATCH_BYTES):
                part = zip(texts[at:end].to_pylist(), kinds[at:end].to_pylist(), strict=True)
                yield pa.array([split(t or "", k or "txt") for t, k in part], pa.list_(pa.string()))

    return cut


@udtf(returnType="pos int, chunk string")
class Chunk:
    """``chunk(text, strategy, size, overlap)`` as a table function for SQL: pos and chunk of the chunks that
    ``chunk_with`` keeps. ``size`` is the chunk size, or the words of a semantic chunk. A null text has none."""

    def __init__(self):
        self.splits: dict[tuple, Callable[[str, str], list[str]]] = {}

    def eval(self, text: str | None, strategy: str, size: int, overlap: int):
        key = (strategy, size, overlap)
        if key not in self.splits:
            self.splits[key] = create_strategy(strategy, chunk_size=size, overlap=overlap, max_tokens=size)
        kept = (c for c in self.splits[key](text or "", "txt") if len(c.strip()) >= SHORTEST)
        yield from enumerate(kept)


def register_functions(spark) -> None:
    """Make ``chunk`` callable from SQL, for a lateral join with a table of texts."""
    spark.udtf.register("chunk", Chunk)


def drop_short(chunks: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    return chunks.where(F.length(stripped(F.col("chunk"))) >= shortest)


def number_chunks(chunks: DataFrame, document: str, *order: str) -> DataFrame:
    """chunk_index from 0 over the whole document."""
    return chunks.withColumn("chunk_index", F.row_number().over(Window.partitionBy(document).orderBy(*order)) - 1)


SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def split_recursive(text: str, size: int, overlap: int, separators=SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the first separator that is found, finer
    ones inside pieces that stay too long; neighbours are joined up to ``size`` and share up to
    ``overlap`` characters of whole pieces."""
    sep = next((s for s in separators if s == "" or s in text), "")
    finer = separators[separators.index(sep) + 1 :]
    parts = list(text) if sep == "" else [p for p in text.split(sep) if p]
    out: list[str] = []
    held: list[str] = []
    length = 0

    def flush() -> None:
        joined = sep.join(held).strip()
        if joined:
            out.append(joined)

    for p in parts:
        if len(p) > size and finer:
            flush()
            held, length = [], 0
            out += split_recursive(p, size, overlap, finer)
            continue
        if held and length + len(sep) + len(p) > size:
            flush()
            while held and (length > overlap or length + len(sep) + len(p) > size):
                length -= len(held.pop(0)) + (len(sep) if held else 0)
        length += len(p) + (len(sep) if held else 0)
        held.append(p)
    flush()
    return out


def chunk_recursive(sections: DataFrame, size: int, overlap: int) -> DataFrame:
    """As ``chunk_fixed``, cut by ``split_recursive`` in Arrow batches; short chunks are dropped."""
    cut = _cutter(lambda text, _: [c for c in split_recursive(text, size, overlap) if len(c) >= SHORTEST])
    return sections.select(*[c for c in sections.columns if c != "text"], F.posexplode(cut("text", F.lit("txt"))).alias("pos", "chunk"))


def chunk_semantic(sections: DataFrame, key: str, words: int) -> DataFrame:
    """Paragraphs of a text packed in order into chunks of about ``words`` words: a paragraph
    belongs to the chunk in which the running count of the words before it falls."""
    paras = sections.select(key, F.posexplode(F.split("text", r"\n")).alias("p", "para")).where(F.length(stripped(F.col("para"))) > 0)
    paras = paras.withColumn("w", F.size(F.filter(F.split("para", rf"{SPACE}+"), lambda x: x != "")))
    before = F.coalesce(F.sum("w").over(Window.partitionBy(key).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    paras = paras.withColumn("pos", F.floor(before / words).cast("int"))
    packed = paras.groupBy(key, "pos").agg(F.array_sort(F.collect_list(F.struct("p", "para"))).alias("ps"), F.sum("w").alias("words"))
    return packed.select(key, "pos", "words", F.array_join(F.transform("ps", lambda x: x["para"]), "\n").alias("chunk"))


def top_terms(chunks: DataFrame, key: str, text: str, k: int = 8) -> DataFrame:
    """(key, terms): the ``k`` most frequent terms of each chunk, ties by first occurrence. Rows
    without a term are left out. Counted inside the row, in Arrow batches: nothing is shuffled."""
    @F.pandas_udf("array<string>")
    def most(found: pd.Series) -> pd.Series:
        # Counter keeps the order of first occurrence, and its sort is stable.
        return found.map(lambda t: [w for w, _ in Counter(t.tolist()).most_common(k)] if t is not None else [])

    return chunks.select(key, terms(F.col(text)).alias("t")).where(F.size("t") > 0).select(key, most("t").alias("terms"))


def topic_counts(labelled: DataFrame, topics: str) -> DataFrame:
    return labelled.select(F.explode(topics).alias("topic")).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


def related_chunks(chunks: DataFrame, most: int = 100, shown: int = 200) -> DataFrame:
    """The first ``most`` chunks of each doc_graph_id (by source_file and chunk_index), with previews
    of ``shown`` characters: what a chunk of that document graph is related to."""
    order = Window.partitionBy("doc_graph_id").orderBy("source_file", "chunk_index")
    first = chunks.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    preview = F.when(F.length("chunk") > shown, F.concat(F.substring("chunk", 1, shown), F.lit("..."))).otherwise(F.col("chunk"))
    return first.select("doc_graph_id", "place", "source_file", "chunk_index", preview.alias("preview"))


def related_documents(labelled: DataFrame, key: str, hints: str) -> DataFrame:
    """Pairs of documents that share hint labels, and how many, between representatives: (a, b,
    shared, links) with the least key of each class of documents of equal labels (see
    ``related_classes``) and the number of document pairs that each row stands for."""
    members, pairs = related_classes(labelled, key, hints)
    least = members.groupBy("class_id").agg(F.min(key).alias("least"))
    both = pairs.join(least.select(F.col("class_id").alias("a"), F.col("least").alias("x")), "a").join(least.select(F.col("class_id").alias("b"), F.col("least").alias("y")), "b")
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "shared", "links")


def related_classes(labelled: DataFrame, key: str, hints: str) -> tuple[DataFrame, DataFrame]:
    """All pairs of documents that share hint labels, without making pairs within a common label.

    Documents with the same set of labels are one class. Returns (key, class_id, links), links
    being the number of other documents with at least one label in common, and pairs of classes
    (a, b, shared, links) with their common labels and the document pairs that they stand for;
    a = b for the pairs within a class. Rows of one key count as one document; null keys have
    no pairs and are left out.
    """
    each = labelled.where(F.col(key).isNotNull()).select(key, F.explode_outer(hints).alias("label"))
    sets = each.groupBy(key).agg(F.array_sort(F.collect_set("label")).alias("labels"))
    members = sets.select(key, F.sha2(F.array_join("labels", "\x1f").cast("binary"), 256).alias("class_id"), "labels")
    classes = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"), F.first("labels").alias("labels"))
    held = classes.select("class_id", "n", F.explode("labels").alias("label"))
    both = held.alias("a").join(held.alias("b"), "label").where("a.class_id <= b.class_id")
    found = both.groupBy(F.col("a.class_id").alias("a"), F.col("b.class_id").alias("b"), F.col("a.n").alias("m"), F.col("b.n").alias("n")).agg(F.count(F.lit(1)).alias("shared"))
    inner = F.col("a") == F.col("b")
    ways = found.select(F.explode(F.when(inner, F.array(F.struct(F.col("a").alias("class_id"), (F.col("n") - 1).alias("links")))).otherwise(
        F.array(F.struct(F.col("a").alias("class_id"), F.col("n").alias("links")), F.struct(F.col("b").alias("class_id"), F.col("m").alias("links"))))).alias("w")).select("w.*")
    members = members.drop("labels").join(ways.groupBy("class_id").agg(F.sum("links").alias("links")), "class_id", "left")
    pairs = found.select("a", "b", "shared", F.when(inner, F.expr("m * (m - 1) div 2")).otherwise(F.col("m") * F.col("n")).alias("links")).where("links > 0")
    return members.select(key, "class_id", F.coalesce("links", F.lit(0)).alias("links")), pairs
