"""LM scoring: a hashed maximum-entropy model with a class-factored softmax.

A token's probability is that of its class given the tokens before it, times its own within
the class. The first factor is a softmax over the classes with hashed features of the history:
the token before (bigram), the two before (trigram) and the one before those (skip). The
second is a softmax over the words of the class by their counts, with a share for unknown
words in the rare classes. Counts, classes and weights are gathered over all training texts:

1. word counts, with partial sums in each task;
2. every text once as the numbers of its tokens, stored; the steps below read those;
3. how often each frequent word follows each of the most frequent ones; words with like
   neighbours form classes (k-means), split by frequency;
4. distributed gradient updates: each task descends over its own tokens, and the tasks'
   weights are averaged, each feature by how often a task saw it;
5. scoring in sparse numpy batches. Frequent words, a bounded number of bounded length, are
   sent to the tasks; all others are looked up by a join on the word.

The rows of hashed features grow with the training tokens, one for TOKENS_A_ROW of them, up
to what a task holds (2 ** MOST_BITS).
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslake.llm.common import finished, fold, slices, table, written

#: Frequent words that are sent to the tasks, at most, and their bytes.
FREQUENT, FREQUENT_BYTES = 1 << 17, 128
#: Of these, words that get a class by their neighbours, and neighbours that are counted.
CLASSED, NEIGHBOURS = 8192, 32
CLUSTERS, BINS, RARE = 9, 3, 4
CLASSES = 32
#: Rows of hashed features: powers of two.
LEAST_BITS, MOST_BITS, TOKENS_A_ROW = 15, 20, 1024
STEP = 16384
#: Bytes of text, and tokens, that are looked at together.
TEXT_BYTES, BATCH_TOKENS = 1 << 19, 1 << 17
#: Tokens that one task of the training descends over, on average, at least; as many times more as
#: there are more rows than the least, so that what the tasks send to be averaged grows with the tokens.
TASK_TOKENS = 2_000_000
_BLOCK = 512


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over the texts of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 0, 8 << 20):
            found: Counter = Counter()
            for t in b.column(0).to_pylist():
                found.update(tokens(t))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "c"])

    rows = docs.where("text IS NOT NULL").select(F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary(dict):
    """Numbers of tokens: frequent words by rank, then the end, the start, and rare words by checksum."""

    def __init__(self, words: list[bytes]):
        super().__init__(zip(words, range(len(words)), strict=True))
        self.end, self.start, self.rare = len(words), len(words) + 1, len(words) + 2

    def __missing__(self, word: bytes) -> int:
        return self.rare + (zlib.crc32(word) & 0xFFFFF)

    def __reduce__(self):
        return Vocabulary, (list(self),)

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
        """Numbers of all tokens, how many each text has, the rare words met and how many of those."""
        words: list[bytes] = []
        sizes = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            own = tokens(t)
            sizes[i] = len(own)
            words += own
        numbers = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        rare = np.flatnonzero(numbers >= self.rare)
        per_text = np.bincount(np.repeat(np.arange(len(texts)), sizes)[rare], minlength=len(texts))
        return numbers, sizes, [words[i] for i in rare.tolist()], per_text

    def lines(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Start, start, tokens, end of each text in a row; the text of each."""
        sizes = np.diff(lists.offsets.to_numpy())
        doc = np.arange(len(sizes))
        ids = np.full(int(sizes.sum()) + 3 * len(sizes), self.start, np.int64)
        ids[np.arange(int(sizes.sum())) + np.repeat(3 * doc + 2, sizes)] = lists.flatten().to_numpy()
        ids[np.cumsum(sizes) + 3 * doc + 2] = self.end
        return ids, np.repeat(doc, sizes + 3)


def _offsets(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))


def encoded(docs: DataFrame, vocabulary: Vocabulary, keep: list[str], learns: Column) -> DataFrame:
    """The stored numbers of all texts: kept, learns, row (a number of its own), ids and the rare words."""
    known = F.struct(*[F.col(c) for c in keep]).alias("kept")
    rows = docs.select(known, F.coalesce(learns, F.lit(False)).alias("learns"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2, TEXT_BYTES):
            ids, sizes, rare, per_text = shared.value.encode(b.column(2).to_pylist())
            lists = [pa.ListArray.from_arrays(_offsets(sizes), pa.array(ids)), pa.ListArray.from_arrays(_offsets(per_text), pa.array(rare, pa.binary()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], names=["kept", "learns", "ids", "rare"])

    schema = T.StructType([rows.schema["kept"], T.StructField("learns", T.BooleanType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("rare", T.ArrayType(T.BinaryType()))])
    return written(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "token-numbers")


def _token_batches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Slices of about BATCH_TOKENS tokens in a column of number lists."""
    for whole in batches:
        ends = whole.column(column).offsets.to_numpy().astype(np.int64)
        at = 0
        while at < whole.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, ends[at] + BATCH_TOKENS, "right")) - 1)
            yield whole.slice(at, end - at)
            at = end


def _features(ids: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    """Hashed features of the tokens at ``at``: one row of three numbers each."""
    one, two = ids[at - 1].astype(np.uint64), ids[at - 2].astype(np.uint64)
    mix = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int32)
    return np.stack([mix(one * np.uint64(4) + np.uint64(1)), mix((two * np.uint64(1 << 22) + one) * np.uint64(4) + np.uint64(2)), mix(two * np.uint64(4) + np.uint64(3))])


def _probabilities(weights: np.ndarray, bias: np.ndarray, f: np.ndarray) -> np.ndarray:
    z = weights.take(f[0], axis=0)
    z += weights.take(f[1], axis=0)
    z += weights.take(f[2], axis=0)
    z += bias
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def _by_row(own: np.ndarray) -> np.ndarray:
    """A stable order of row numbers below 2**32, by two passes over 16 bits each."""
    order = np.argsort(own.astype(np.uint16), kind="stable")
    high = (own >> 16).astype(np.uint16)
    return order[np.argsort(high[order], kind="stable")] if high.any() else order


class Model:
    """What scoring needs, all of bounded size."""

    def __init__(self, words: list[bytes], counts: np.ndarray, total: int, distinct: int, ends: int):
        self.words, self.counts = words, counts
        self.total, self.distinct, self.ends = total, distinct, ends
        self.vocabulary = Vocabulary(words)
        self.word_class = np.zeros(len(words), np.int8)
        self.bits = min(MOST_BITS, max(LEAST_BITS, (max(1, -(-total // TOKENS_A_ROW)) - 1).bit_length()))
        self.weights = np.zeros((1 << self.bits, CLASSES), np.float32)

    def classes_of(self, ids: np.ndarray) -> np.ndarray:
        """Class 0 is the end, the last RARE ones are those of words without a class of their own."""
        v = self.vocabulary
        rare = CLASSES - RARE + (ids - v.rare) % RARE
        return np.where(ids >= v.rare, rare, np.where(ids == v.end, 0, self.word_class[np.minimum(ids, max(0, len(self.words) - 1))] if len(self.words) else 0))


def neighbour_counts(numbers: DataFrame, model: Model) -> np.ndarray:
    """How often each of the CLASSED words follows each of the NEIGHBOURS, or any other token."""
    vocabulary, rows, wide = model.vocabulary, min(CLASSED, len(model.words)), NEIGHBOURS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(rows * wide, np.int64)
        for b in _token_batches(batches, 0):
            ids, _ = vocabulary.lines(b.column(0))
            at = np.flatnonzero(ids < rows)
            total += np.bincount(ids[at] * wide + np.minimum(ids[at - 1], NEIGHBOURS), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["cell", "n"])

    out = np.zeros(rows * wide)
    found = numbers.where("learns").select("ids").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out[found["cell"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(rows, wide)


def assign_classes(model: Model, near: np.ndarray, seed: int = 7) -> None:
    """Cluster words by the square roots of their neighbours' shares; split clusters by frequency."""
    rng = np.random.default_rng(seed)
    x = np.sqrt(near / np.maximum(1, near.sum(axis=1, keepdims=True)))
    mass = model.counts[: len(x)].astype(np.float64)
    home = np.zeros(len(x), np.int64)
    if len(x) > CLUSTERS:
        centre = x[rng.choice(len(x), CLUSTERS, replace=False, p=mass / mass.sum())]
        for _ in range(15):
            home = ((x[:, None, :] - centre[None]) ** 2).sum(axis=2).argmin(axis=1)
            for c in range(CLUSTERS):
                if (home == c).any():
                    centre[c] = np.average(x[home == c], axis=0, weights=mass[home == c])
    for c in range(CLUSTERS):
        own = np.flatnonzero(home == c)
        if len(own):
            share = np.cumsum(mass[own]) - mass[own]
            model.word_class[own] = 1 + c * BINS + np.minimum(BINS - 1, share * BINS / mass[own].sum()).astype(np.int64)
    rest = np.arange(len(x), len(model.words))
    checks = np.array([zlib.crc32(model.words[i]) & 0xFFFFF for i in rest], np.int64)
    model.word_class[rest] = CLASSES - RARE + checks % RARE


def class_totals(model: Model, rare: dict[int, tuple[int, int]]) -> None:
    """Words and tokens of each class; ``rare``: those of the words that are not sent to the tasks."""
    n = np.bincount(model.word_class, weights=model.counts, minlength=CLASSES)
    v = np.bincount(model.word_class, minlength=CLASSES).astype(np.float64)
    n[0], v[0] = model.ends, 1
    for c, (words, count) in rare.items():
        v[CLASSES - RARE + c] += words
        n[CLASSES - RARE + c] += count
    unknown = np.arange(CLASSES) >= CLASSES - RARE
    model.bias = np.log(np.maximum(n, 1e-2 + unknown)).astype(np.float32)
    model.class_size = n + v + unknown


def train(numbers: DataFrame, model: Model, rate: float = 0.5) -> None:
    """One pass of gradient updates over all texts that are learnt from, in parallel, then averaged."""
    bits, size = model.bits, 1 << model.bits
    shared = numbers.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, classes, vocabulary = shared.value.bias, shared.value.classes_of, shared.value.vocabulary
        w, speed, seen = np.zeros((size, CLASSES), np.float32), np.full(size, 1e-2, np.float32), np.zeros(size, np.float32)
        for b in _token_batches(batches, 0):
            ids, _ = vocabulary.lines(b.column(0))
            where = np.flatnonzero(ids != vocabulary.start)
            for i in range(0, len(where), STEP):
                at = where[i : i + STEP]
                f = _features(ids, at, bits)
                p = _probabilities(w, bias, f)
                p[np.arange(len(at)), classes(ids[at])] -= 1
                for own in f:
                    order = _by_row(own)
                    rows = own[order]
                    first = np.flatnonzero(np.diff(rows, prepend=-1))
                    g = np.add.reduceat(p.take(order, axis=0), first, axis=0)
                    rows, times = rows[first], np.diff(first, append=len(rows))
                    speed[rows] += np.einsum("ij,ij->i", g, g) / CLASSES
                    w[rows] -= rate / 3 * g / np.sqrt(speed[rows])[:, None]
                    seen[rows] += times
        for b in range(0, size, _BLOCK):
            if seen[b : b + _BLOCK].any():
                part = np.concatenate((w[b : b + _BLOCK] * seen[b : b + _BLOCK, None], seen[b : b + _BLOCK, None]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([part.astype(np.float32).tobytes()], pa.binary())], names=["block", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One running sum for each block: there are 2 ** MOST_BITS / _BLOCK of them at most.
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[block] = sums.get(block, 0) + np.frombuffer(part, np.float32)
        for block, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([s.astype(np.float32).tobytes()], pa.binary())], names=["block", "part"])

    kind = "block int, part binary"
    tasks = max(1, -(-model.total // (TASK_TOKENS << (bits - LEAST_BITS))))
    parts = numbers.where("learns").select("ids").coalesce(tasks).mapInArrow(run, kind)
    parts = parts.repartition(F.col("block"), F.spark_partition_id() % 16).mapInArrow(add, kind)
    for r in parts.repartition("block").mapInArrow(add, kind).collect():
        part = np.frombuffer(r["part"], np.float32).reshape(_BLOCK, CLASSES + 1)
        model.weights[r["block"] : r["block"] + _BLOCK] = part[:, :-1] / np.maximum(part[:, -1:], 1e-6)


def vocabulary_of(docs: DataFrame) -> tuple[Model, DataFrame]:
    """A model that knows the counts of the texts of ``docs``, and the stored counts of its rare words (word, c)."""
    counts = written(word_counts(docs), "word-counts")
    ends = docs.count()
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # Frequent words are those of the highest counts that together are no more than FREQUENT,
    # in steps of a tenth; the steps are few, so nothing is sorted or gathered to find them.
    step = F.when(F.length("word") <= FREQUENT_BYTES, F.floor(F.log("c") / F.log(F.lit(1.1)))).otherwise(F.lit(-1))
    ladder = sorted(counts.where(step >= 0).groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["step"])
    sums = np.cumsum([r["n"] for r in ladder])
    fits = int(np.searchsorted(sums, FREQUENT, side="right"))
    least = ladder[fits - 1]["step"] if fits else 1 << 30
    top = counts.where(step >= least).toArrow()
    order = np.lexsort((np.array(top["word"].to_pylist(), object), -top["c"].to_numpy())) if top.num_rows else np.zeros(0, np.int64)
    words = top["word"].take(pa.array(order)).to_pylist()
    model = Model(words, top["c"].to_numpy()[order].astype(np.int64), total + ends, distinct + (ends > 0), ends)
    return model, counts.where(step < least)


def fit(numbers: DataFrame, model: Model, others: DataFrame) -> None:
    """Classes and weights of ``model`` from the encoded texts that are learnt from."""
    if model.words:
        assign_classes(model, neighbour_counts(numbers, model))
    rare = others.groupBy((F.crc32("word").bitwiseAND(F.lit(0xFFFFF)) % RARE).alias("r")).agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n"))
    class_totals(model, {r["r"]: (r["v"], r["n"]) for r in rare.collect()})
    train(numbers, model)


def score(numbers: DataFrame, model: Model, others: DataFrame, keep=("doc_id",)) -> DataFrame:
    """The columns ``keep``, n_tokens, n_known, train_tokens, base_score and score (log10) of every encoded row."""
    shared = numbers.sparkSession.sparkContext.broadcast(model)
    tail = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base", T.DoubleType()), ("score", T.DoubleType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        v = m.vocabulary
        floor = np.log10(m.total + m.distinct + 1)
        own_base = np.append(np.log10(m.counts + 1.0), [np.log10(m.ends + 1.0)])
        size = np.log10(np.maximum(1.0, m.class_size))
        for b in _token_batches(batches, 2):
            ids, row = v.lines(b.column(2))
            where = np.flatnonzero(ids != v.start)
            n = np.bincount(row[where], minlength=b.num_rows)
            got = ids[where] < v.rare
            frequent = np.where(got, own_base[np.minimum(ids[where], v.end)], 0.0)
            base = np.bincount(row[where], weights=frequent - floor, minlength=b.num_rows)
            lp = np.empty(len(where))
            for i in range(0, len(where), STEP):
                at = where[i : i + STEP]
                c = m.classes_of(ids[at])
                p = _probabilities(m.weights, m.bias, _features(ids, at, m.bits))[np.arange(len(at)), c]
                lp[i : i + STEP] = np.log10(np.maximum(p, 1e-30)) - size[c]
            model_score = np.bincount(row[where], weights=lp + frequent, minlength=b.num_rows)
            seen = np.bincount(row[where], weights=got & ((ids[where] != v.end) | (m.ends > 0)), minlength=b.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), pa.array(seen), pa.array(base), pa.array(model_score)], names=["kept", "row", *[c for c, _ in tail]])

    scored = numbers.select("kept", "row", "ids").mapInArrow(run, T.StructType([numbers.schema["kept"], T.StructField("row", T.LongType()), *[T.StructField(c, k) for c, k in tail]]))
    found = numbers.select("row", F.explode("rare").alias("word")).join(others, "word")
    found = found.groupBy("row").agg(F.sum(F.log10(F.col("c") + 1)).alias("more"), F.count(F.lit(1)).alias("more_known"))
    out = scored.join(found, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        *[F.col(f"kept.{c}").alias(c) for c in keep], "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(int(model.total)).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"),
    )


def lm_scores(docs: DataFrame, learns: Column, keep=("doc_id",)) -> DataFrame:
    """The columns ``keep``, n_tokens, n_known, train_tokens, base_score and score (log10) of every
    row of ``docs``, from a model of the rows for which ``learns`` is true.

    Null and empty texts are scored for their end alone. Repeated rows score alike. Without
    training texts every token is unknown. Words of any length are counted; those beyond
    FREQUENT_BYTES are never sent to tasks. Empty input gives empty output; other columns are
    ignored unless named in ``keep``.
    """
    model, others = vocabulary_of(docs.where(learns).select("text"))
    numbers = encoded(docs, model.vocabulary, list(keep), learns)
    fit(numbers, model, others)
    return score(numbers, model, others, keep)


def op2_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 7) == 2
    found = finished("lm-scores", lambda: lm_scores(docs, ~held))
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
