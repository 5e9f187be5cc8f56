"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds its letters: the
first permuted twice, the second once, the third as it is, multiplied element by element
(word boundaries count as a letter). A text's vector is the bundle (sum) of its trigrams'
vectors, damped by the square root of their counts; a language's prototype is the bundle of
its training texts, each weighted to about unit length. A text gets the language whose centred
prototype has the largest cosine with its vector.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslake.llm.common import fold, table

DIM = 1024
#: Letters: 0 is the boundary, 1-26 are a-z, other letters share the rest by a rule.
LETTERS = 96
#: Code points that are held as arrays at a time.
PIECE = 1 << 20

_codes = np.full(0x110000, 255, np.uint8)


def _letter(cp: int) -> int:
    c = chr(cp)
    if not unicodedata.category(c).startswith("L"):
        return 0
    low = c.lower()
    if "a" <= low <= "z" and len(low) == 1:
        return ord(low) - 96
    return 27 + (ord(low[0]) * 2654435761 >> 7) % (LETTERS - 27)


def _trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Distinct trigrams and their counts in the whole text; None without a letter.

    What is not a letter is a boundary; a run of boundaries counts once.
    """
    tail, found, counts = np.zeros(1, np.uint8), [], []
    for at in range(0, len(text or ""), PIECE):
        points = np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        c = _codes[points]
        if (c == 255).any():
            for cp in np.unique(points[c == 255]).tolist():
                _codes[cp] = _letter(cp)
            c = _codes[points]
        c = c[(c > 0) | (np.concatenate((tail[-1:], c[:-1])) > 0)]
        if at + PIECE >= len(text) and len(c) and c[-1]:
            c = np.append(c, np.uint8(0))
        line = np.concatenate((tail, c)).astype(np.int32)
        tail = line[-2:].astype(np.uint8)
        if len(line) > 2:
            t = np.sort((line[:-2] * LETTERS + line[1:-1]) * LETTERS + line[2:])
            first = np.flatnonzero(np.diff(t, prepend=-1))
            found.append(t[first])
            counts.append(np.diff(first, append=len(t)))
    if not found:
        return None
    if len(found) == 1:
        return found[0], counts[0]
    t, where = np.unique(np.concatenate(found), return_inverse=True)
    return t, np.bincount(where, weights=np.concatenate(counts))


def _weights(counts: np.ndarray) -> np.ndarray:
    """Weights of a text's trigrams in its bundle, of about unit length: bound random vectors
    are nearly orthogonal, so a bundle's length is about that of its weights."""
    w = np.sqrt(counts)
    return w / np.sqrt((w * w).sum())


class Space:
    """The random letter vectors, and trigrams bound from them."""

    def __init__(self, dim: int = DIM, seed: int = 11):
        self.dim = dim
        self.letters = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (LETTERS, dim))
        self.first, self.second = np.roll(self.letters, 2, axis=1), np.roll(self.letters, 1, axis=1)

    def bind(self, t: np.ndarray) -> np.ndarray:
        """Vectors of trigrams."""
        return self.first[t // (LETTERS * LETTERS)] * self.second[t // LETTERS % LETTERS] * self.letters[t % LETTERS]

    def bundle(self, t: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return sum((weights[i : i + 4096].astype(np.float32) @ self.bind(t[i : i + 4096]).astype(np.float32) for i in range(0, len(t), 4096)), np.zeros(self.dim, np.float32))


class Comparer:
    """Cosines of texts' vectors with prototypes. The trigrams met first are kept bound."""

    def __init__(self, protos: np.ndarray, dim: int = DIM, room: int = 1 << 15):
        self.space, self.protos = Space(dim), protos
        self.place = np.full(LETTERS**3, -1, np.int32)
        self.bound, self.used = np.empty((room, dim), np.int8), 0

    def bundle(self, t: np.ndarray, weights: np.ndarray) -> np.ndarray:
        place = self.place[t]
        new = t[place < 0][: len(self.bound) - self.used]
        if len(new):
            self.bound[self.used : self.used + len(new)] = self.space.bind(new)
            self.place[new] = np.arange(self.used, self.used + len(new))
            self.used += len(new)
            place = self.place[t]
        kept = place >= 0
        w, rows = (weights, place) if kept.all() else (weights[kept], place[kept])
        w = w.astype(np.float32)
        out = sum((w[i : i + 1024] @ self.bound[rows[i : i + 1024]].astype(np.float32) for i in range(0, len(rows), 1024)), np.zeros(self.space.dim, np.float32))
        return out if len(rows) == len(t) else out + self.space.bundle(t[~kept], weights[~kept])

    def __call__(self, text: str | None) -> np.ndarray | None:
        found = _trigrams(text)
        if found is None:
            return None
        v = self.bundle(found[0], _weights(found[1]))
        return self.protos @ v / max(1e-12, float(np.linalg.norm(v)))


def prototypes(docs: DataFrame, dim: int = DIM) -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and their centred, normed prototypes, from (text, lang) rows.

    Each task sends one vector for each language; their sums are made by Spark. What comes to
    the driver is one vector for each language.
    """
    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = _trigrams(text)
                if found is not None:
                    # Weights add up over texts; the bundle is made of their sums.
                    sums.setdefault(lang, np.zeros(LETTERS**3, np.float32))[found[0]] += _weights(found[1])
        space = Space(dim)
        for lang, w in sums.items():
            t = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([space.bundle(t, w[t]).tolist()], pa.list_(pa.float64()))], names=["lang", "v"])

    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang")
    parts = rows.mapInArrow(bundle, "lang string, v array<double>").select("lang", F.posexplode("v"))
    sums = parts.groupBy("lang", "pos").agg(F.sum("col").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v"))
    found = sorted((r["lang"], [x["x"] for x in r["v"]]) for r in sums.collect())
    p = np.array([v for _, v in found]).reshape(len(found), dim)
    p = p / np.maximum(1e-12, np.linalg.norm(p, axis=1, keepdims=True))
    if len(found) > 1:
        p = p - p.mean(axis=0)
        p = p / np.maximum(1e-12, np.linalg.norm(p, axis=1, keepdims=True))
    return [lang for lang, _ in found], p.astype(np.float32)


def identify(docs: DataFrame, langs: list[str], protos: np.ndarray, keep=("doc_id",), dim: int = DIM) -> DataFrame:
    """The columns ``keep``, lang_pred and score of every row of ``docs``.

    score is the cosine with the chosen prototype brought to 0..1. Texts that are null, empty
    or without a letter are ``und`` with score 0, and so is every text if no language was
    learned. Ties go to the first language in code-point order. Empty input gives empty output.
    """
    kept = F.struct(*[F.col(c) for c in keep]).alias("kept")
    rows = docs.select(kept, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compare = Comparer(protos, dim)
        for b in batches:
            names, scores = [], []
            for text in b.column(1).to_pylist():
                cosine = compare(text) if langs else None
                if cosine is None:
                    names.append("und")
                    scores.append(0.0)
                    continue
                best = int(np.argmax(cosine))
                names.append(langs[best])
                scores.append(float(np.clip((1 + cosine[best]) / 2, 0, 1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["kept", "lang_pred", "score"])

    schema = T.StructType([rows.schema["kept"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema).select("kept.*", "lang_pred", "score")


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    langs, protos = prototypes(docs.where(fold(F.col("doc_id"), 4) != 2).select("text", "lang"))
    return identify(docs, langs, protos).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
