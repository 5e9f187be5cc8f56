"""Near-duplicates by the Jaccard similarity of word shingles.

Candidates come first from SimHash: fingerprints of the shingle sets are linked at up to ``RADIUS``
differing bits by the generalised pigeonhole principle (``simhash.links``). That finds texts that
differ in a few words. At a similarity of 0.8 fingerprints differ in about 10 bits and up to 17,
where partitions of 64 bits leave nearly all pairs as candidates; what lies beyond the radius
comes from min-hash bands: texts that agree on one of ``BANDS`` bands of ``ROWS``
min-hashes each are candidates too. Texts that either way links are put into one group, and groups
that share a text are one group. At a similarity of 0.8 two texts share a band with a probability
of 0.9995, above it with more.
Inside a group texts are compared on their whole shingle sets, whether they share a band or
not, so a link is never false. A text that nothing is linked to yet is compared with all others;
once every text belongs to a cluster, only those outside the largest one are. So near copies by
the thousand cost one comparison each and no pairs are made among them, and no cluster that
hangs together is missed. A group with many shingles is dealt into blocks, and each pair
of blocks is a task of its own: memory is bounded and no member is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslake.llm.common import written
from corpuslake.llm.graph import components
from corpuslake.llm.simhash import BLOCK, keep_rows, least_row, links, row_digest, row_key

BANDS, ROWS = 32, 7
#: Bits in which the fingerprints of candidates may differ.
RADIUS = 2
#: Shingles of a block of a group.
BLOCK_SHINGLES = 1 << 20
_RANDOM = np.random.default_rng(11).integers(0, 2**63, (2, BANDS * ROWS)).astype(np.uint64)
_FACTORS, _ADDENDS = _RANDOM[0] * np.uint64(2) + np.uint64(1), _RANDOM[1]


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct XXH64 of the runs of ``size`` lower-cased words; a shorter text is one run."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = np.concatenate(([0], ends[:-1] + 1))[: max(1, len(words) - size + 1)].tolist()
    last = ends[min(size, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[s:e], 42) for s, e in zip(first, last, strict=True)), np.uint64, len(first)))


def bands(found: np.ndarray) -> list[int]:
    """A signed 64-bit key of each band; none where there is no shingle."""
    import xxhash

    if not len(found):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), BLOCK >> 5):
        part = found[at : at + (BLOCK >> 5), None] * _FACTORS + _ADDENDS
        np.minimum(least, part.min(axis=0), out=least)
    keys = [xxhash.xxh64_intdigest(row.tobytes(), b) for b, row in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def fingerprint(found: np.ndarray) -> int | None:
    """The SimHash of a shingle set: majority bits of its hashes, as a signed number; none where there is no shingle."""
    if not len(found):
        return None
    counts = np.zeros(64, np.int64)
    for at in range(0, len(found), BLOCK):
        counts += np.unpackbits(found[at : at + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > len(found)).tobytes(), "big", signed=True)


def _signer(size: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            found = [shingles(t, size) for t in b.column(1).to_pylist()]
            ids = pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) for s in found], pa.string())
            columns = [b.column(0), ids, pa.array([len(s) for s in found], pa.int64()), pa.array([bands(s) for s in found], pa.list_(pa.int64())), pa.array([fingerprint(s) for s in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "id", "n", "bands", "fp"])

    return sign


def _adder(size: int):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(t, size).view(np.int64) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.list_(pa.int64()))], names=[*b.schema.names[:-1], "shingles"])

    return add


def _linker(similarity: float):
    def link(cell: pa.Table) -> pa.Table:
        """Links of all texts of the cell which hang together: the least id of each cluster with its others."""
        ids = cell["id"].to_pylist()
        sets = [np.asarray(s, np.int64) for s in cell["shingles"].combine_chunks().to_numpy(zero_copy_only=False)]
        sizes = np.array([len(s) for s in sets])
        values, owners = np.concatenate(sets), np.repeat(np.arange(len(ids)), sizes)
        order = np.argsort(values, kind="stable")
        values, owners = values[order], owners[order]
        root, linked = np.arange(len(ids)), np.zeros(len(ids), bool)

        def compare(i: int) -> None:
            lo, hi = np.searchsorted(values, sets[i], "left"), np.searchsorted(values, sets[i], "right")
            common = np.bincount(owners[np.repeat(lo - np.concatenate(([0], np.cumsum(hi - lo)[:-1])), hi - lo) + np.arange((hi - lo).sum())], minlength=len(ids))
            near = np.flatnonzero(common >= similarity * (sizes + sizes[i] - common) - 1e-9)
            linked[near] = True
            for r in np.setdiff1d(root[near], [root[i]]).tolist():
                root[root == r] = root[i]

        for i in range(len(ids)):
            if not linked[i]:
                compare(i)
        # What links two clusters has an end outside the largest one.
        largest = np.bincount(root).argmax() if len(ids) else 0
        for i in np.flatnonzero(root != largest).tolist():
            if root[i] != largest:
                compare(i)
        least: dict[int, str] = {}
        for r, i in zip(root.tolist(), ids, strict=True):
            least[r] = min(i, least.get(r, i))
        out = [(least[r], i) for r, i in zip(root.tolist(), ids, strict=True) if least[r] != i]
        return pa.table({"a": pa.array([a for a, _ in out], pa.string()), "b": pa.array([b for _, b in out], pa.string())})

    return link


def _near_fingerprints(classes: DataFrame) -> DataFrame:
    """(a, b) ids whose fingerprints are within the radius, or that the same linked fingerprints hold together."""
    held = written(classes.where("fp IS NOT NULL").groupBy("fp").agg(F.min("id").alias("least")), "set-fingerprints")
    same = classes.join(held, "fp").where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    first, second = (held.select(F.col("fp").alias(c), F.col("least").alias(n)) for c, n in (("a", "x"), ("b", "y")))
    # Stored apart: one plan of everything would hold all its stages at once.
    pairs = written(links(held.select("fp"), RADIUS), "fingerprint-links")
    near = pairs.join(first, "a").join(second, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return same.unionAll(near)


def similar_classes(docs: DataFrame, size: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(id, doc_id) of each distinct shingle set, doc_id being the least row key, and (node, root)
    of the sets linked to another one."""
    digest = row_digest()
    rows = docs.select(F.struct("doc_id", digest.alias("digest")).alias("doc_id"), F.col("text").cast("binary").alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("id", T.StringType()), T.StructField("n", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("fp", T.LongType())])
    signed = written(rows.mapInArrow(_signer(size), schema), "signatures")
    classes = written(signed.groupBy("id").agg(least_row("doc_id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("fp").alias("fp")), "shingle-classes")
    each = classes.select("id", F.explode("bands").alias("key"))
    least = each.groupBy("key").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("held")).where("held > 1").select("key", "a")
    stars = written(each.join(least, "key").where("id <> a").select("a", F.col("id").alias("b")).distinct(), "band-stars")
    groups = components(stars.unionAll(_near_fingerprints(classes))).withColumnRenamed("node", "id").withColumnRenamed("root", "grp")
    members = written(classes.join(groups, "id").select("id", "doc_id", "n", "grp"), "group-members")
    blocks = members.groupBy("grp").agg(F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES)).cast("long").alias("k"))
    placed = members.join(blocks, "grp").select(*row_key(F.col("doc_id")["doc_id"], F.col("doc_id")["digest"]), "id", "grp", "k", F.pmod(F.xxhash64("id"), "k").alias("block"))
    named = docs.select(*row_key(F.col("doc_id"), digest), F.col("text").cast("binary").alias("text"))
    texts = named.join(placed, ["__id", "__row"]).select("id", "grp", "k", "block", "text")
    schema = T.StructType([*[f for f in texts.schema if f.name != "text"], T.StructField("shingles", T.ArrayType(T.LongType()))])
    sets = texts.mapInArrow(_adder(size), schema)
    cell = F.expr("explode(transform(sequence(0L, k - 1), j -> struct(least(block, j) AS x, greatest(block, j) AS y)))")
    cells = sets.select("id", "grp", "block", "shingles", cell.alias("cell")).select("id", "grp", "block", "shingles", "cell.x", "cell.y")
    linked = cells.groupBy("grp", "x", "y").applyInArrow(_linker(similarity), "a string, b string")
    return classes.select("id", "doc_id"), components(linked)


def similar_texts_removed(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` without near-duplicates: texts whose sets of ``size``-word shingles have a Jaccard
    similarity of ``similarity`` or more are linked, and of each component the row with the least
    doc_id stays. Texts without a word are alike. Ties and nulls as in ``simhash.near_duplicates``.
    """
    classes, nodes = similar_classes(docs, size, similarity)
    rooted = classes.join(nodes.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    return keep_rows(docs, rooted.groupBy("root").agg(least_row("doc_id")).select("doc_id.*"))
