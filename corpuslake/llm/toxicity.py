"""Toxicity classifier: subword-bag embeddings averaged into a linear softmax.

A word's bag holds its hashed character n-grams and pairs of letters around a gap, so that an
unseen misspelling shares many vectors with the word it comes from. The vectors of a segment are
averaged and go through a linear softmax. Segments are taken on three scales, which share
the embeddings and have a bias each: single words, runs of several words, and the document. A
document is as toxic as its segments together (log-sum-exp), so that neither one word in a
long text nor a phrase of ordinary words is lost in an average over all of it.

Embeddings and softmax are trained jointly in numpy on a bounded sample. Part of the buckets
rest in each step, as if the word were spelt otherwise. Because the softmax is linear, an
n-gram's logit is a dot product known after training, and scoring needs one number for each bucket.
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
from corpuslake.llm.numtext import class_table, mixed, pieces, prefix_hash, range_hash, spans

BUCKETS = 1 << 17
DIM = 8
GRAMS = (3, 4)
#: Words of one segment on each scale (0: the whole document) and what its average is multiplied by.
SCALES = ((1, 1.0), (8, 4.0), (0, 8.0))
#: Share of the buckets that take part in a training step, and what stands for those at rest.
KEEP, BOOST = 0.5, 1.0
#: What clean and toxic documents weigh in training, all of a kind together.
WEIGHTS = (0.7, 0.3)
#: Documents of one training step.
BATCH = 1024
#: ASCII that separates words: all but letters and digits, and but for marks that stand in for letters.
_INSIDE = class_table(bytes(c for c in range(128) if not (chr(c).isalnum() or chr(c) in "@$*")))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _bags(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each word [s, e) with its boundaries, and how many each has."""
    # Each distinct word stands between boundary marks in a buffer of its own.
    size = e - s + 2
    offset = np.concatenate(([0], np.cumsum(size)))
    own = np.full(offset[-1], 31, np.uint8)
    at = np.arange(offset[-1]) - np.repeat(offset[:-1], size)
    body = (at > 0) & (at < np.repeat(size - 1, size))
    own[body] = buf[np.repeat(s, size)[body] + at[body] - 1]
    prefix = prefix_hash(own)
    word = np.repeat(np.arange(len(s)), size)
    rest = np.repeat(offset[1:], size) - np.arange(len(own))
    ids, of = [], []
    for n in GRAMS:
        start = np.flatnonzero(rest >= n)
        ids.append(range_hash(prefix, start, start + n))
        of.append(word[start])
    start = np.flatnonzero(rest >= 3)
    ids.append(mixed(own[start].astype(np.uint64) << np.uint64(8) | own[start + 2]))
    of.append(word[start])
    of_ = np.concatenate(of)
    order = np.argsort(of_, kind="stable")
    return (np.concatenate(ids)[order] % np.uint64(BUCKETS)).astype(np.int64), np.bincount(of_, minlength=len(s))


def _tokens(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each piece of the texts: row and distinct-word number of each word, buckets and bag sizes of the distinct words, their hashes."""
    for buf, row in pieces(texts):
        buf = _LOWER[buf]
        s, e = spans(buf, _INSIDE)
        if len(s):
            h, first, word = np.unique(range_hash(prefix_hash(buf), s, e), return_index=True, return_inverse=True)
            ids, sizes = _bags(buf, s[first], e[first])
            yield row[s], word, ids, sizes, h, first


def _segments(row: np.ndarray, words: int) -> np.ndarray:
    """First word of each segment: ``words`` words of one row, or all of them."""
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    if not words:
        return starts
    place = np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row))))
    return np.flatnonzero(place % words == 0)


def _sums(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, np.concatenate(([0], np.cumsum(sizes)[:-1]))) if len(sizes) else np.zeros(0)


class Batch:
    """Texts as arrays: the distinct words' bags, and for each scale where its segments lie."""

    def __init__(self, texts: list[bytes], y: np.ndarray):
        known: dict[int, int] = {}
        bag_ids, bag_sizes, rows, words = [], [], [], []
        for row, word, ids, sizes, h, _ in _tokens(texts):
            before = len(known)
            number = np.array([known.setdefault(x, len(known)) for x in h.tolist()])
            new = number >= before
            bag_sizes.append(sizes[new].astype(np.int32))
            bag_ids.append(ids[np.repeat(new, sizes)].astype(np.int32))
            # New words are numbered in the order of their hashes, as their bags are.
            rows.append(row.astype(np.int32))
            words.append(number[word].astype(np.int32))
        self.any = bool(rows)
        if rows:
            self.ids, self.sizes, self.row, self.word = map(np.concatenate, (bag_ids, bag_sizes, rows, words))
            self.target = y[self.row[_segments(self.row, 0)]]

    def gradient(self, z: np.ndarray, bias: np.ndarray, weight: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
        """Of the loss by the buckets' logits and by the biases."""
        sizes, word, row = self.sizes, self.word, self.row
        by_token, scales, logits = _sums(z[self.ids], sizes)[word], [], []
        for (n, gain), b in zip(SCALES, bias, strict=True):
            first = _segments(row, n)
            per_gram = np.float32(gain) / np.add.reduceat(sizes[word], first).astype(np.float32)
            doc_first = np.flatnonzero(np.diff(row[first], prepend=-1))
            scales.append((per_gram, doc_first, np.diff(doc_first, append=len(first)), np.diff(first, append=len(row))))
            logits.append(np.add.reduceat(by_token, first) * per_gram + np.float32(b))
        top = np.max([np.maximum.reduceat(s, d) for s, (_, d, _, _) in zip(logits, scales, strict=True)], axis=0)
        soft = [np.exp(s - np.repeat(top, n)) for s, (_, _, n, _) in zip(logits, scales, strict=True)]
        total = sum(np.add.reduceat(s, d) for s, (_, d, _, _) in zip(soft, scales, strict=True))
        p = 1 / (1 + np.exp(-np.clip(top + np.log(total), -30, 30)))
        error = ((p - self.target) * np.where(self.target > 0, *weight) / total).astype(np.float32)
        of_word, of_bias = np.zeros(len(sizes)), np.zeros(len(SCALES))
        for i, (s, (per_gram, _, n, tokens)) in enumerate(zip(soft, scales, strict=True)):
            d = np.repeat(error, n) * s
            of_bias[i] = d.sum()
            of_word += np.bincount(word, weights=np.repeat(d * per_gram, tokens), minlength=len(sizes))
        return np.bincount(self.ids, weights=np.repeat(of_word, sizes), minlength=BUCKETS), of_bias


def fit(texts: list[bytes], y: list[int], passes: int = 120, rate: float = 0.08, seed: int = 5):
    """(logit of each bucket, bias of each scale). Without texts, or with one class only, a constant."""
    y_ = np.array(y, np.float64)
    if not len(y_) or y_.min() == y_.max():
        return np.zeros(BUCKETS, np.float32), np.full(len(SCALES), -2.0 if not len(y_) or y_[0] == 0 else 2.0)
    rng = np.random.default_rng(seed)
    mixed_up = rng.permutation(len(texts))
    batches = [Batch([texts[i] for i in part], y_[part]) for part in np.array_split(mixed_up, -(-len(texts) // BATCH))]
    batches = [b for b in batches if b.any]
    weight = tuple(len(batches) * w / max(1, (y_ == c).sum()) for c, w in enumerate(WEIGHTS))[::-1]
    emb, out, bias = rng.normal(0, 0.1, (BUCKETS, DIM)), rng.normal(0, 0.5, (DIM, 2)), np.full(len(SCALES), -1.0)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (emb, out, bias)]
    # More batches need fewer passes over each: the number of steps grows with their root.
    steps = int(passes * len(batches) ** 0.5)
    for step in range(1, steps + 1):
        keep = BOOST * (rng.random(BUCKETS) < KEEP)
        dz, of_bias = batches[step % len(batches)].gradient((emb @ (out[:, 1] - out[:, 0]) * keep).astype(np.float32), bias, weight)
        both = np.stack([-dz * keep, dz * keep], axis=1)
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for par, g, (m, s) in zip((emb, out, bias), (both @ out.T, emb.T @ both, of_bias), state, strict=True):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            par -= now * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return (emb @ (out[:, 1] - out[:, 0])).astype(np.float32), bias


def score(model, texts: list[bytes | None]) -> np.ndarray:
    """Probability of toxicity of each whole text: of the log-sum-exp of its segments."""
    z, bias = model
    total = np.full(len(texts), -np.inf)
    whole, grams = np.zeros(len(texts)), np.zeros(len(texts))
    for row, word, ids, sizes, _, _ in _tokens(texts):
        by_token, n_token = _sums(z[ids].astype(np.float64), sizes)[word], sizes[word]
        for (n, gain), b in zip(SCALES, bias, strict=True):
            first = _segments(row, n)
            sums, counts = np.add.reduceat(by_token, first), np.add.reduceat(n_token, first)
            if n:
                np.logaddexp.at(total, row[first], gain * sums / counts + b)
            else:
                # A long text comes in pieces; its average is made of their sums.
                np.add.at(whole, row[first], sums)
                np.add.at(grams, row[first], counts)
    for (n, gain), b in zip(SCALES, bias, strict=True):
        if not n:
            total = np.logaddexp(total, gain * whole / np.maximum(1, grams) + b)
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


SLICE = 512


def toxicity_scores(docs: DataFrame, labels: DataFrame, keep=("doc_id",), parts: int = 5, held: int = 0, bound: int = FIT_DOCUMENTS) -> DataFrame:
    """The columns ``keep`` of every row of ``docs``, and score: the probability of label toxic 1.

    Fitted on a bounded sample of labelled rows outside fold ``held`` (see fitting); only the
    text is an input. Null and empty texts score as one neutral segment. Without labels, or
    with one class only, the score is constant. Repeated rows score alike. Empty input gives
    empty output.
    """
    texts, y, _ = labelled_sample(docs, labels, "toxic", parts, held, bound)
    model = fit(texts, y)
    del texts
    kept = F.struct(*[F.col(c) for c in keep]).alias("kept")
    rows = docs.select(kept, F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score(model, b.column(1).to_pylist()), pa.float64())], names=["kept", "score"])

    return rows.mapInArrow(run, T.StructType([rows.schema["kept"], T.StructField("score", T.DoubleType())])).select("kept.*", "score")


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    scores = toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
