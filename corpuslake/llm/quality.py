"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

Every document becomes a sparse vector: hashed words with damped counts (unit length), one
indicator for the bin of each structure statistic, and one for each metadata column's
magnitude. Low-rank factors give the pairwise interactions in linear time, by
sum_{i<j} <v_i,v_j> x_i x_j = 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2].
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslake.llm.common import fold, table
from corpuslake.llm.fitting import FIT_DOCUMENTS, labelled_sample
from corpuslake.llm.numtext import SPACES, pieces, range_hash, prefix_hash, spans

BUCKETS = 1 << 14
BINS = 17
STATS = 12
FACTORS = 6


def _byte_classes() -> np.ndarray:
    """0 other punctuation, 1 lower-case, 2 upper-case, 3 digit, 4 space, 5 line feed, 6 sentence mark, 7 not ASCII."""
    t = np.zeros(256, np.int64)
    t[97:123], t[65:91], t[48:58], t[128:] = 1, 2, 3, 7
    t[[9, 11, 12, 13, 32]] = 4
    t[10] = 5
    t[[33, 39, 44, 45, 46, 58, 59, 63]] = 6
    return t


_CLASSES = _byte_classes()


def features(texts: list[bytes | None], metadata: list[list[float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (offsets, ids, values) of whole texts."""
    n = len(texts)
    kinds = np.zeros(n * 8)
    words, same, chars, odd = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    counts: list[np.ndarray] = []
    weights: list[np.ndarray] = []
    for buf, row in pieces(texts):
        kinds += np.bincount(row * 8 + _CLASSES[buf], minlength=n * 8)
        s, e = spans(buf, SPACES)
        h, r = range_hash(prefix_hash(buf), s, e), row[s]
        words += np.bincount(r, minlength=n)
        chars += np.bincount(r, weights=e - s, minlength=n)
        same += np.bincount(r[1:], weights=(h[1:] == h[:-1]) & (r[1:] == r[:-1]), minlength=n)
        last = _CLASSES[buf[e - 1]]
        odd += np.bincount(r, weights=last == 0, minlength=n)
        k, c = np.unique(r * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
        counts.append(k)
        weights.append(c)
    keys, where = np.unique(np.concatenate(counts) if counts else np.zeros(0, np.int64), return_inverse=True)
    times = np.bincount(where, weights=np.concatenate(weights) if weights else None, minlength=len(keys)) if len(keys) else np.zeros(0)
    r = keys // BUCKETS
    distinct = np.bincount(r, minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, r, times)
    kinds = kinds.reshape(n, 8)
    total = np.maximum(1.0, kinds.sum(axis=1))
    each = np.maximum(1.0, words)
    stats = np.stack([
        kinds[:, 0] / total, kinds[:, 2] / total, kinds[:, 3] / total, kinds[:, 5] / each, kinds[:, 6] / each,
        same / each, odd / each, distinct / each, most / each,
        np.minimum(1.0, chars / each / 16), np.log2(1 + words) / 24, kinds[:, 7] / total,
    ], axis=1)
    bins = np.minimum(BINS - 1, (np.sqrt(np.clip(stats, 0, 1)) * BINS)).astype(np.int64)
    fields = [BUCKETS + np.arange(STATS) * BINS + bins]
    for j, column in enumerate(metadata):
        size = np.array([np.nan if x is None else float(x) for x in column])
        # Null has a bin of its own.
        bin_ = np.where(np.isnan(size), BINS - 1, np.minimum(BINS - 2, np.log2(1 + np.abs(np.nan_to_num(size))) / 2)).astype(np.int64)
        fields.append((BUCKETS + (STATS + j) * BINS + bin_)[:, None])
    dense = np.concatenate(fields, axis=1)
    value = np.log1p(times)
    norm = np.sqrt(np.bincount(r, weights=value**2, minlength=n))
    value = value / norm[r] if len(r) else value
    rows = np.concatenate((r, np.repeat(np.arange(n), dense.shape[1])))
    ids = np.concatenate((keys % BUCKETS, dense.ravel()))
    vals = np.concatenate((value, np.full(dense.size, 0.5)))
    order = np.argsort(rows, kind="stable")
    offsets = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=n))))
    return offsets, ids[order], vals[order].astype(np.float32)


def _raw(model, offsets, ids, vals) -> tuple[np.ndarray, np.ndarray]:
    bias, w, v = model
    first = offsets[:-1]
    vx = v[ids] * vals[:, None]
    s = np.add.reduceat(vx, first, axis=0)
    pair = 0.5 * (s**2 - np.add.reduceat(vx**2, first, axis=0)).sum(axis=1)
    return bias + np.add.reduceat(w[ids] * vals, first) + pair, s


def fit(texts: list[bytes], y: list[int], metadata: list[list[float]], epochs: int = 10, batch: int = 256, rate: float = 0.15, decay: float = 1e-5, seed: int = 3):
    """The model (bias, w, v), by AdaGrad over minibatches; constant where one class is missing."""
    rng = np.random.default_rng(seed)
    size = BUCKETS + (STATS + len(metadata)) * BINS
    w, v, bias = np.zeros(size), rng.normal(0, 0.03, (size, FACTORS)), 0.0
    y_ = np.array(y, np.float64)
    if not len(y) or y_.min() == y_.max():
        return (2.0 if not len(y) or y_[0] else -2.0), w, v * 0
    offsets, ids, vals = features(texts, metadata)
    ids = ids.astype(np.int32)
    gw, gv, gb = np.full(size, 1e-3), np.full(v.shape, 1e-3), 1e-3
    for _ in range(epochs):
        order = rng.permutation(len(y_))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            length = offsets[rows + 1] - offsets[rows]
            here = np.repeat(offsets[rows] - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(length.sum())
            off = np.concatenate(([0], np.cumsum(length)))
            i, x = ids[here], vals[here].astype(np.float64)
            z, s = _raw((bias, w, v), off, i, x)
            d = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y_[rows]
            dx = np.repeat(d, length) * x
            g = np.bincount(i, weights=dx, minlength=size) / len(rows) + decay * w
            gw += g * g
            w -= rate * g / np.sqrt(gw)
            each = dx[:, None] * (s[np.repeat(np.arange(len(rows)), length)] - v[i] * x[:, None])
            for f in range(FACTORS):
                g = np.bincount(i, weights=each[:, f], minlength=size) / len(rows) + decay * v[:, f]
                gv[:, f] += g * g
                v[:, f] -= 0.5 * rate * g / np.sqrt(gv[:, f])
            g0 = d.mean()
            gb += g0 * g0
            bias -= rate * g0 / np.sqrt(gb)
    return bias, w, v


def score(model, texts: list[bytes | None], metadata: list[list[float]]) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    z, _ = _raw(model, *features(texts, metadata))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


#: Documents that are held as sparse vectors at a time.
SLICE = 256


def quality_scores(docs: DataFrame, labels: DataFrame, keep=("doc_id",), metadata=("n_chars",), parts: int = 4, held: int = 2, bound: int = FIT_DOCUMENTS) -> DataFrame:
    """The columns ``keep`` of every row of ``docs``, and score: the probability of quality 1.

    Fitted on a bounded sample of labelled rows outside fold ``held`` (see fitting). Inputs are
    the text and the numbers in the columns ``metadata``, of which those that ``docs`` lacks are
    left out. Null and empty texts get a score too.
    Without labels, or with one class only, the score is constant. Ties and repeated rows are
    scored alike. Empty input gives empty output.
    """
    metadata = [c for c in metadata if c in docs.columns]
    texts, y, extra = labelled_sample(docs, labels, "quality", parts, held, bound, metadata)
    model = fit(texts, y, [extra[c] for c in metadata])
    del texts
    model = (float(model[0]), model[1].astype(np.float32), model[2].astype(np.float32))
    kept = F.struct(*[F.col(c) for c in keep]).alias("kept")
    rows = docs.select(kept, F.col("text").cast("binary").alias("text"), *[F.col(c).cast("double").alias(f"m{i}") for i, c in enumerate(metadata)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                z = score(model, b.column(1).to_pylist(), [b.column(2 + i).to_pylist() for i in range(len(metadata))])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(z, pa.float64())], names=["kept", "score"])

    return rows.mapInArrow(run, T.StructType([rows.schema["kept"], T.StructField("score", T.DoubleType())])).select("kept.*", "score")


def op5_quality_fm(spark, sf_dir: str) -> DataFrame:
    scores = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
