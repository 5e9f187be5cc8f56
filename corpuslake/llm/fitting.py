"""The bounded sample of labelled documents that classifiers are fitted on."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.common import fold, scratch, written

#: The sample holds about this many labelled documents at most, chosen by a hash of the id...
FIT_DOCUMENTS = 8_000
#: ...none of them longer than this many characters...
FIT_CHARS = 50_000
#: ...and as many of them, in the order of another hash, as have this many bytes together.
FIT_BYTES = 64 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, held: int, bound: int = FIT_DOCUMENTS, extra=()) -> tuple[list, list, dict]:
    """Texts (bytes), labels (0 or 1) and extra columns of a bounded sample of labelled rows.

    Rows of fold ``held`` of ``parts``, null labels and texts beyond FIT_CHARS are left out. Where
    an id has several labels the largest counts; where it has several rows the shortest text
    does, of equally short ones the least. Reruns give the same sample.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), parts) != held))
    known = known.groupBy("doc_id").agg(F.max(F.col(label)).alias("y"))
    total = known.count()
    if not total:
        return [], [], {c: [] for c in extra}
    share = min(1.0, bound / total)
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0))
    rows = docs.where(F.coalesce(F.length("text"), F.lit(0)) <= FIT_CHARS)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = rows.select("doc_id", F.struct(F.length(text).alias("size"), text.alias("text"), *[F.col(c).alias(f"x{i}") for i, c in enumerate(extra)]).alias("row"))
    with scratch():
        # The chosen ids are bounded by ``bound``, so they can be sent to every task.
        found = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("row").alias("row"))
        found = written(found.select(F.xxhash64("doc_id", F.lit("order")).alias("key"), "doc_id", "y", "row.*"), "labelled")
        sizes = found.select("key", "size").toArrow().sort_by("key")
        fits = int(np.searchsorted(np.cumsum(sizes["size"].to_numpy().astype(np.int64)), FIT_BYTES, "right"))
        last = sizes["key"][fits - 1].as_py() if fits else None
        found = found.where(F.col("key") <= F.lit(last).cast("long")).toArrow().sort_by([("key", "ascending"), ("doc_id", "ascending")])
    out = found["text"].to_pylist(), [int(v > 0) for v in found["y"].to_pylist()], {c: found[f"x{i}"].to_pylist() for i, c in enumerate(extra)}
    del found
    pa.default_memory_pool().release_unused()
    return out
