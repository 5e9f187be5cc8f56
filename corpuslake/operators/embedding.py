"""Embedding as a distributed, de-duplicated map, and an approximate search over vectors."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.operators.retrieval import block_hits, ranked

DIM = 64
#: Vectors that a task hands on at a time, about.
HANDED_ON = 1024


#: CRC-32 of each byte, bytes between words, white space that is no ASCII, and bytes of a word that are hashed side by side with others.
_CRCS = np.array([zlib.crc32(bytes([i ^ 255])) ^ 0xFF000000 for i in range(256)], np.uint32)
_GAPS = np.isin(np.arange(256), list(b"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f "))
_WIDE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SIDE_BY_SIDE = 32


def _word_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each word of lower-cased texts the text's place and the CRC-32, in no order."""
    parts = [(t if t.isascii() else _WIDE.sub(" ", t)).lower().encode() for t in texts]
    whole = b"\n".join([b"", *parts, b""])
    held = np.frombuffer(whole, np.uint8)
    gap = _GAPS[held]
    edges = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    h = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    for i in range(min(int(sizes[0]) if len(sizes) else 0, _SIDE_BY_SIDE)):
        n = int(np.searchsorted(-sizes, -i))  # longer ones
        h[:n] = _CRCS[(h[:n] ^ held[starts[:n] + i]) & 255] ^ (h[:n] >> 8)
    h ^= 0xFFFFFFFF
    for i in range(int(np.searchsorted(-sizes, -_SIDE_BY_SIDE))):
        h[i] = zlib.crc32(whole[starts[i] : starts[i] + sizes[i]])
    return np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), starts), h.astype(np.int64)


def hash_provider(texts: list[str], dim: int = DIM) -> np.ndarray:
    """A deterministic stand-in for a model: signed hashing of words, of unit length."""
    row, h = _word_codes([t or "" for t in texts])
    # Sums of ones are exact in any order.
    out = np.bincount(row * dim + h % dim, np.where(h & 0x80000000, 1.0, -1.0), len(texts) * dim).reshape(len(texts), dim)
    return out / np.maximum(1e-12, np.linalg.norm(out, axis=1, keepdims=True))


def embed(texts: DataFrame, column: str, *providers: Callable[[list[str]], np.ndarray], batch: int = 32) -> DataFrame:
    """``texts`` with vector and error. Texts go to the first provider in batches; those of a
    batch that it fails on go to the next, and get an error if all fail."""
    providers = providers or (hash_provider,)

    def table(vectors: list[np.ndarray | None], errors: list[str | None]) -> pa.StructArray:
        none = np.array([v is None for v in vectors])
        ends = np.cumsum([0, *(0 if v is None else len(v) for v in vectors)])
        flat = np.concatenate([np.zeros(0, np.float32), *(v for v in vectors if v is not None)])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.float32()), mask=pa.array(none))
        return pa.StructArray.from_arrays([lists, pa.array(errors, pa.string())], ["vector", "error"])

    @F.arrow_udf("vector array<float>, error string")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for whole in parts:
            vectors: list[np.ndarray | None] = []
            errors: list[str | None] = []
            for at in range(0, len(whole), batch):
                part = whole.slice(at, batch).to_pylist()
                error = None
                for p in providers:
                    try:
                        made = [np.asarray(v, np.float32) for v in p(part)]
                        vectors += made
                        errors += [None] * len(made)
                        break
                    except Exception as e:  # a provider's own failures
                        error = str(e)[:200]
                else:
                    vectors += [None] * len(part)
                    errors += [error] * len(part)
                if len(vectors) >= HANDED_ON:
                    yield table(vectors, errors)
                    vectors, errors = [], []
            if vectors:
                yield table(vectors, errors)

    return texts.withColumn("e", run(F.col(column))).select(*texts.columns, "e.vector", "e.error")


def embed_distinct(texts: DataFrame, column: str, *providers) -> DataFrame:
    """As ``embed``, with each distinct text embedded once."""
    key = F.sha2(F.coalesce(F.col(column), F.lit("")).cast("binary"), 256)
    keyed = texts.withColumn("__key", key)
    once = embed(keyed.select("__key", column).dropDuplicates(["__key"]), column, *providers)
    return keyed.join(once.select("__key", "vector", "error"), "__key").drop("__key")


#: Vectors that cells are fitted on, and queries by which the probed share is chosen.
FIT_VECTORS, FIT_QUERIES = 8192, 128


def _unit(frame: DataFrame, most: int) -> np.ndarray:
    """At most ``most`` vectors, chosen by a hash of what they hold, of unit length."""
    rows = frame.where(F.col("vector").isNotNull() & (F.size("vector") > 0)).select(F.xxhash64("vector").alias("h"), "vector").orderBy("h").limit(most).collect()
    if not rows:
        return np.zeros((0, 0))
    v = np.array([r["vector"] for r in rows], np.float64)
    return v / np.maximum(1e-12, np.linalg.norm(v, axis=1, keepdims=True))


def fit_cells(sample: np.ndarray, k: int, target: float, seed: int = 3) -> tuple[np.ndarray, int]:
    """Centres of cells and how many a query must probe for ``target`` of its ``k`` nearest, as
    measured on the sample itself."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), max(1, min(len(sample), int(2 * len(sample) ** 0.5))), replace=False)]
    for _ in range(8):
        home = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        centres = np.where(np.bincount(home, minlength=len(centres))[:, None] > 0, sums, centres)
        centres = centres / np.maximum(1e-12, np.linalg.norm(centres, axis=1, keepdims=True))
    home = (sample @ centres.T).argmax(axis=1)
    asked = sample[rng.choice(len(sample), min(len(sample), FIT_QUERIES), replace=False)]
    near = np.argsort(-(asked @ sample.T), axis=1, kind="stable")[:, 1 : k + 1]
    order = np.argsort(-(asked @ centres.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    needed = np.take_along_axis(place, home[near], axis=1)
    probes = next((p for p in range(1, len(centres)) if (needed < p).mean() >= target), len(centres))
    return centres, probes


def ann_topk(queries: DataFrame, chunks: DataFrame, k: int, threshold: float = -1.0, target: float = 0.95) -> DataFrame:
    """Approximate cosine top-k by inverted cells: every chunk lies in the cell of its nearest
    centre, and a query is compared exactly with the chunks of its nearest cells.

    Centres are fitted on FIT_VECTORS chunks at most, and as many cells are probed as bring
    ``target`` of the nearest within reach on that sample. All chunks are indexed.
    """
    sample = _unit(chunks, FIT_VECTORS)
    if not len(sample):
        return ranked(queries.select("query_id").join(chunks.select("chunk_id").limit(0)).withColumn("score", F.lit(0.0)), k)
    centres, probes = fit_cells(sample, k, target)

    def cells(n: int):
        @F.pandas_udf("array<int>")
        def run(v: pd.Series) -> pd.Series:
            x = np.array([np.zeros(centres.shape[1]) if a is None or len(a) != centres.shape[1] else np.asarray(a, np.float64) for a in v]).reshape(len(v), -1)
            return pd.Series(list(np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :n].astype(np.int32)))

        return run("vector")

    q = queries.select(F.explode(cells(probes)).alias("cell"), "query_id", "vector")
    return ranked(block_hits(q, chunks.select(cells(1)[0].alias("cell"), "chunk_id", "vector"), k, threshold), k)
