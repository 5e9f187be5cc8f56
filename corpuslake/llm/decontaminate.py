"""Benchmark decontamination with a distributed positional inverted index.

The index is built once over all tokens of the training texts, whatever is asked of it later. Texts are
taken in segments; a segment's postings (term, document, position) are sorted and dealt to partitions by
the hash of their term, and each partition is a folder of the stored index, so a lookup opens only the
folders of the terms that it asks for. Terms are 64-bit hashes of lower-case words.

A window is looked up from its rarest terms by the index's own counts: the position lists of
the RAREST first ones are moved back by their offsets and intersected, so what is left are starts at which all of them
agree. These few candidates are compared with the words of their documents byte by byte, which gives exact
phrase matches; proximity matches are taken from the rarest term's positions alike. Any number of
benchmarks is answered from one build.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslake.llm.common import finished, slices, table, written
from corpuslake.llm.numtext import pieces, prefix_hash, range_hash, spans
from corpuslake.llm.repeats import row_keys

WINDOW = 13
#: Rarest terms of a window whose position lists are intersected.
RAREST = 3
#: Partitions of the index, and bytes of the texts of a segment (a longer text is a segment of its own).
PARTITIONS, SEGMENT_BYTES = 64, 8 << 20
#: Different terms that are sent to the tasks at a time; windows that ask for more are dealt into parts.
ASKED_TERMS = 1 << 22
#: Documents whose keys are sent to all tasks; more candidates are joined.
SENT_DOCUMENTS = 200_000
#: Words on either side within which proximity matches are reported.
SLOP = 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words are runs of ASCII digits and letters and of bytes beyond ASCII.
_INSIDE = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_KEY = ("k1", "k2")


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item, terms): every distinct window of ``size`` words of each item (item_id, text); a
    shorter item is one window, one without words has none."""
    lower = F.translate(F.coalesce(F.col("text"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.regexp_extract_all(lower, F.lit(_WORD), F.lit(0)).alias("words"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    return words.where(F.size("words") > 0).select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, size))).alias("terms")).distinct()


def _words(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Lower-case bytes, and the row, start and end of each word in them, some texts at a time."""
    for buf, row in pieces(texts):
        buf = _LOWER[buf]
        s, e = spans(buf, _INSIDE)
        yield buf, row[s], s, e


def postings(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Term, row and place in the row of every word, in order; words of each row."""
    words = np.zeros(len(texts), np.int64)
    out = [(np.zeros(0, np.int64),) * 3]
    for buf, r, s, e in _words(texts):
        first = np.flatnonzero(np.diff(r, prepend=-1))
        place = np.arange(len(r)) + np.repeat(words[r[first]] - first, np.diff(np.append(first, len(r))))
        out.append((range_hash(prefix_hash(buf), s, e).view(np.int64), r, place))
        words += np.bincount(r, minlength=len(texts))
    return *(np.concatenate(x) for x in zip(*out, strict=True)), words


@dataclass
class PositionalIndex:
    """documents: seg, local, k1, k2, n_words and kept of each; lists: the sorted postings of each segment and
    partition (part, seg, and terms, counts, rows and places as arrays of numbers)."""

    documents: DataFrame
    lists: DataFrame
    parts: int
    docs: DataFrame

    def folders(self, terms: np.ndarray) -> DataFrame:
        """The lists of the partitions that ``terms`` lie in."""
        asked = np.unique(terms.view(np.uint64) % np.uint64(self.parts)).astype(int).tolist()
        return self.lists.where(F.col("part").isin(asked)) if asked else self.lists.where("false")


def build_index(docs: DataFrame, keep: list[str], parts: int = PARTITIONS) -> PositionalIndex:
    """The stored index of all tokens of ``docs`` (doc_id, text), with the columns ``keep``."""
    rows = docs.select(F.struct(*[F.col(c) for c in keep]).alias("kept"), *row_keys(F.col("doc_id"), F.col("text")), F.col("text").cast("binary").alias("text"))
    longs, blobs = ("seg", "k1", "k2", "n_words"), ("terms", "counts", "rows", "places")
    schema = T.StructType(
        [T.StructField("part", T.IntegerType()), T.StructField("local", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in longs]]
        + [T.StructField(c, T.BinaryType()) for c in blobs] + [T.StructField("kept", rows.schema["kept"].dataType)]
    )
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = TaskContext.get().partitionId() << 32
        for b in slices(batches, 3, SEGMENT_BYTES):
            term, row, place, words = postings(b.column(3).to_pylist())
            n = b.num_rows
            whole = lambda v, n: pa.array(np.full(n, v), pa.int64())
            none = lambda n: [pa.nulls(n, pa.binary())] * 4
            own = [pa.array(np.full(n, -1, np.int32)), pa.array(np.arange(n, dtype=np.int32)), whole(seg, n), b.column(1), b.column(2), pa.array(words), *none(n), b.column(0)]
            yield pa.RecordBatch.from_arrays(own, names=names)
            order = np.argsort(term, kind="stable")
            term = term[order]
            first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
            terms, counts = term[first], np.diff(np.append(first, len(term)))
            part = (terms.view(np.uint64) % np.uint64(parts)).astype(np.int32)
            by_part = np.argsort(part, kind="stable")
            terms, counts, first, part = terms[by_part], counts[by_part], first[by_part], part[by_part]
            take = order[np.repeat(first, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)]
            row, place, ends, counts = _narrow(row[take]), _narrow(place[take]), np.cumsum(counts), _narrow(counts)
            edges = np.flatnonzero(np.diff(part, prepend=-1))
            held: dict[str, list] = {"part": [], **{c: [] for c in blobs}}
            for a, z in zip(edges.tolist(), [*edges[1:].tolist(), len(part)][: len(edges)], strict=True):
                lo, hi = int(ends[a]) - int(counts[a]), int(ends[z - 1])
                for c, v in (("part", int(part[a])), ("terms", terms[a:z].tobytes()), ("counts", counts[a:z].tobytes()), ("rows", row[lo:hi].tobytes()), ("places", place[lo:hi].tobytes())):
                    held[c].append(v)
            m = len(held["part"])
            empty = [pa.nulls(m, pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([pa.array(held["part"], pa.int32()), pa.nulls(m, pa.int32()), whole(seg, m), *empty, *[pa.array(held[c], pa.binary()) for c in blobs], pa.nulls(m, b.column(0).type)], names=names)
            seg += 1

    # A partition comes to one task, unless it is so large that Spark splits it.
    stored = written(rows.mapInArrow(run, schema).hint("rebalance", "part"), "positional-index", by="part")
    documents = stored.where("part = -1").select("seg", "local", "k1", "k2", "n_words", "kept")
    return PositionalIndex(documents, stored.where("part >= 0").select("part", "seg", *blobs), parts, docs)


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint16 if x.max(initial=0) < 1 << 16 else np.uint32)


def unpacked(terms: bytes, counts: bytes, *lists: bytes) -> list[np.ndarray]:
    """The arrays of a segment and partition; how wide their numbers are follows from how many they must be."""
    out = [np.frombuffer(terms, np.int64)]
    out.append(np.frombuffer(counts, f"u{len(counts) // max(1, len(out[0]))}"))
    total = int(out[1].sum(dtype=np.int64))
    return out + [np.frombuffer(x, f"u{len(x) // max(1, total)}") for x in lists]


def _each(b: pa.RecordBatch, *columns: int) -> Iterator[list[np.ndarray]]:
    for values in zip(*(b.column(c) for c in columns), strict=True):
        yield unpacked(*(v.as_py() for v in values))


def _found(asked: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``terms`` are among the sorted ``asked``, and where."""
    at = np.minimum(np.searchsorted(asked, terms), max(0, len(asked) - 1))
    hit = np.flatnonzero(asked[at] == terms) if len(asked) else np.zeros(0, np.int64)
    return hit, at[hit]


def collection_counts(index: PositionalIndex, asked: np.ndarray) -> np.ndarray:
    """Occurrences of each of the sorted terms ``asked``."""
    sent = index.lists.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sent.value), np.int64)
        for b in batches:
            for terms, counts in _each(b, 0, 1):
                hit, at = _found(sent.value, terms)
                total[at] += counts[hit]  # a segment has each term once
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["at", "n"])

    found = index.folders(asked).select("terms", "counts").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(asked), np.int64)
    out[found["at"].to_numpy()] = found["n"].to_numpy()
    return out


def positions(index: PositionalIndex, asked: np.ndarray) -> DataFrame:
    """(term, seg, local, place): the position lists of the sorted terms ``asked``, from their partitions alone."""
    sent = index.lists.sparkSession.sparkContext.broadcast(asked)
    names = ["term", "seg", "local", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            segs = b.column(0).to_pylist()
            for seg, (terms, counts, rows, places) in zip(segs, _each(b, 1, 2, 3, 4), strict=True):
                hit, _ = _found(sent.value, terms)
                if len(hit):
                    ends = np.cumsum(counts, dtype=np.int64)
                    n = counts[hit].astype(np.int64)
                    take = np.repeat(ends[hit] - n, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    made = [np.repeat(terms[hit], n), np.full(len(take), seg), rows[take].astype(np.int64), places[take].astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in made], names=names)

    return index.folders(asked).select("seg", "terms", "counts", "rows", "places").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def hashed(found: DataFrame) -> DataFrame:
    """(w, phrase, terms): the different phrases of windows, a digest of each, and the hashes of its words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            term, row, _, _ = postings(b.column(1).to_pylist())
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b.num_rows))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(ends, pa.array(term))], names=["w", "phrase", "terms"])

    once = found.select("w", F.col("phrase").cast("binary").alias("phrase")).distinct()
    return once.mapInArrow(run, "w string, phrase binary, terms array<long>")


def chosen(phrases: DataFrame, asked: np.ndarray, counts: np.ndarray, rarest: int) -> DataFrame:
    """(w, term, at, need): the ``rarest`` terms of each phrase, rarest first, the first of equally rare ones, and how many they
    are. Phrases with a term that the index lacks are left out."""
    sent = phrases.sparkSession.sparkContext.broadcast((asked, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, counts = sent.value
        for b in batches:
            out: list[tuple] = []
            for w, terms in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n = counts[np.searchsorted(asked, np.array(terms, np.int64))]
                if n.all():
                    first = np.lexsort((np.arange(len(n)), n))[:rarest].tolist()
                    out += [(w, terms[i], i, len(first)) for i in first]
            cols = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["w", "term", "at", "need"])

    return phrases.select("w", "terms").mapInArrow(run, "w string, term long, at long, need long")


def _terms(frame: DataFrame, column: str) -> np.ndarray:
    return np.unique(frame.select(column).distinct().toArrow()[column].to_numpy().astype(np.int64))


def _parts(phrases: DataFrame) -> Iterator[DataFrame]:
    """The phrases in as many parts as their terms need to be sent."""
    n = phrases.select(F.explode("terms").alias("t")).distinct().count()
    if n <= ASKED_TERMS:
        yield phrases
        return
    parts = 2 * -(-n // ASKED_TERMS)
    for i in range(parts):
        yield phrases.where(F.pmod(F.xxhash64("w"), F.lit(parts)) == i)


def candidates(index: PositionalIndex, phrases: DataFrame, rarest: int) -> DataFrame:
    """(k1, k2, w, start): where the ``rarest`` terms of a phrase stand in a document as they do in the phrase; with
    one term, every place of the rarest one (and the place of the phrase's first word)."""
    found = None
    for part in _parts(phrases):
        asked = _terms(part.select(F.explode("terms").alias("t")), "t")
        rare = written(chosen(part, asked, collection_counts(index, asked), rarest), "rarest-terms")
        where = positions(index, _terms(rare, "term")).join(rare, "term").withColumn("start", F.col("place") - F.col("at"))
        # The lists agree on a start where each of them has it.
        hit = where.groupBy("w", "seg", "local", "start").agg(F.count(F.lit(1)).alias("n"), F.max("need").alias("need"), F.max("at").alias("at")).where("n = need")
        hit = hit.select("seg", "local", "w", "start", "at")
        found = hit if found is None else found.unionByName(hit)
    return written(found.join(index.documents.select("seg", "local", *_KEY), ["seg", "local"]).select(*_KEY, "w", "start", "at").distinct(), "candidates")


def texts_of(index: PositionalIndex, found: DataFrame) -> DataFrame:
    """(k1, k2, text, and the candidates of each document as a list of structs): only documents that have some."""
    keys = found.select(*_KEY).distinct()
    texts = index.docs.select(*row_keys(F.col("doc_id"), F.col("text")), F.col("text").cast("binary").alias("text"))
    keys = F.broadcast(keys) if keys.count() <= SENT_DOCUMENTS else keys
    one = texts.join(keys, list(_KEY), "left_semi").dropDuplicates(list(_KEY))
    return one.join(found.groupBy(*_KEY).agg(F.collect_list(F.struct(*[c for c in found.columns if c not in _KEY])).alias("asked")), list(_KEY))


def _checked(rows: DataFrame, fits) -> DataFrame:
    """(k1, k2, w, start, n) of the candidates that ``fits``(words, place, at, phrase) the document's words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2, SEGMENT_BYTES):
            out: list[tuple] = []
            for k1, k2, text, asked in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                words = [x for buf, _, s, e in _words([text]) for x in (lambda d: [d[i:j] for i, j in zip(s.tolist(), e.tolist(), strict=True)])(buf.tobytes())]
                for a in asked:
                    phrase = a["phrase"].split(b" ")
                    if fits(words, a["start"], a["at"], phrase):
                        out.append((k1, k2, a["w"], a["start"], len(phrase), a["at"]))
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["k1", "k2", "w", "start", "n", "at"])

    return rows.select(*_KEY, "text", "asked").mapInArrow(run, "k1 long, k2 long, w string, start long, n long, at long")


def _asked(items: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(w, item) and (w, phrase, terms) of the windows of the items."""
    phrase = F.array_join("terms", " ")
    found = written(windows(items, size).select("item", F.md5(phrase.cast("binary")).alias("w"), phrase.alias("phrase")), "windows")
    return found.select("w", "item").distinct(), written(hashed(found), "phrases")


def _exact(words: list[bytes], start: int, at: int, phrase: list[bytes]) -> bool:
    return start >= 0 and words[start : start + len(phrase)] == phrase


def phrase_matches(index: PositionalIndex, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(k1, k2, spans, items) of the documents in which windows occur."""
    of, phrases = _asked(items, size)
    found = candidates(index, phrases, RAREST).join(phrases.select("w", "phrase"), "w")
    hit = written(_checked(texts_of(index, found), _exact), "occurrences")
    spans_ = hit.groupBy(*_KEY).agg(_merged(F.collect_set(F.array(F.col("start").cast("int"), (F.col("start") + F.col("n")).cast("int")))).alias("spans"))
    named = hit.select(*_KEY, "w").distinct().join(of, "w").groupBy(*_KEY).agg(F.array_sort(F.collect_set("item")).alias("items"))
    return spans_.join(named, list(_KEY))


def matches(docs: DataFrame, items: DataFrame, size: int = WINDOW, keep=("doc_id",), index: PositionalIndex | None = None) -> DataFrame:
    """The columns ``keep``, n_words, spans and items for every row of ``docs``.

    spans are the [start, end) word ranges covered by occurring windows, merged; items the
    sorted ids of the items that have one. Null or empty texts have no words and no match.
    Repeated items count once, a null item id as the empty string. With no items no document
    matches; empty documents give empty output. ``index`` may be one that ``build_index`` made of ``docs``
    with these columns before.
    """
    names = list(dict.fromkeys(keep))
    index = build_index(docs, names) if index is None else index
    # Stored, so that Spark knows their size and does not move the documents for a few.
    merged = written(phrase_matches(index, items, size), "matches")
    rows = index.documents.join(merged, list(_KEY), "left")
    return rows.select(*[F.col("kept")[c].alias(c) for c in names], "n_words", *[F.coalesce(c, F.array().cast(merged.schema[c].dataType)).alias(c) for c in ("spans", "items")])


def _merged(spans_: Column) -> Column:
    """Spans [start, end) in any order as spans that neither overlap nor touch."""
    def add(out: Column, span: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        joined = F.array_append(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(last[0], F.greatest(last[1], span[1])))
        return F.when(F.coalesce(span[0] <= last[1], F.lit(False)), joined).otherwise(F.array_append(out, span))

    return F.aggregate(F.array_sort(spans_), F.array().cast("array<array<int>>"), add)


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int = SLOP, size: int = WINDOW, keep=("doc_id",), index: PositionalIndex | None = None) -> DataFrame:
    """The columns ``keep``, item and place: each occurrence of a window's rarest term that has
    all its other terms within ``slop`` words on either side, in any order. Equal lines are one.

    Looked up in the same index, with null, empty and repeated rows as in ``matches``.
    """
    names = list(dict.fromkeys(keep))
    index = build_index(docs, names) if index is None else index
    of, phrases = _asked(items, size)

    def near(words: list[bytes], start: int, at: int, phrase: list[bytes]) -> bool:
        place = start + at
        return words[place] == phrase[at] and set(phrase) <= set(words[max(0, place - slop) : place + slop + 1])

    found = candidates(index, phrases, 1).join(phrases.select("w", "phrase"), "w")
    hit = written(_checked(texts_of(index, found), near), "near-occurrences")
    some = hit.select(*_KEY, "w", (F.col("start") + F.col("at")).alias("place")).join(of, "w").join(index.documents.select(*_KEY, "kept"), list(_KEY))
    return some.select(*[F.col("kept")[c].alias(c) for c in names], "item", "place").distinct()


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, keep=("doc_id",), share: int = 20) -> DataFrame:
    """The columns ``keep``, n_words, n_hit, n_items, items and contaminated: some word is hit,
    and at least one in ``share``. Edge cases as in ``matches``."""
    found = matches(docs, items, size, keep)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s[1] - s[0]))
    found = found.withColumn("n_hit", hit).withColumn("n_items", F.size("items").cast("long"))
    return found.select(*keep, "n_words", "n_hit", "n_items", "items", ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def clean_rows(docs: DataFrame, items: DataFrame, size: int = WINDOW, share: int = 20) -> DataFrame:
    """The rows of ``docs`` that ``contamination`` does not find contaminated, as they are: of the index's documents only the
    keys of contaminated rows come back to them, so their texts are not moved."""
    index = build_index(docs, ["doc_id"])
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s[1] - s[0]))
    found = phrase_matches(index, items, size).join(index.documents, list(_KEY)).where((hit > 0) & (share * hit >= F.col("n_words")))
    gone = written(found.select(*[F.col(k).alias(f"__{k}") for k in _KEY]).distinct(), "contaminated")
    keys = [k.alias(f"__{n}") for n, k in zip(_KEY, row_keys(F.col("doc_id"), F.col("text")), strict=True)]
    return docs.select(*docs.columns, *keys).join(gone, [f"__{k}" for k in _KEY], "left_anti").select(*docs.columns)


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    found = finished("contamination", lambda: contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def proximity_decontamination(spark, sf_dir: str) -> DataFrame:
    return finished("proximity", lambda: proximity_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT item, w, least(13, len(w)) AS n, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d CROSS JOIN sizes WHERE len(w) >= n)),
hits AS (SELECT r, i, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.phrase = bw.phrase),
hit_words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY r),
hit_items AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS h FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(h, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""


PROXIMITY_ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, w[i:i + 12] AS terms
  FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)),
places AS (SELECT r, unnest(w) AS term, unnest(generate_series(1, len(w))) AS p FROM d),
counts AS (SELECT term, count(*) AS n FROM places GROUP BY term),
ranked AS (
  SELECT item, terms, x.term, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY item, terms ORDER BY coalesce(n, 0), o) AS nth
  FROM (SELECT item, terms, unnest(terms) AS term, unnest(generate_series(1, len(terms))) AS o FROM bw) AS x LEFT JOIN counts USING (term))
SELECT DISTINCT doc_id, item, CAST(p - 1 AS BIGINT) AS place
FROM (SELECT item, terms, term FROM ranked WHERE nth = 1) JOIN places USING (term) JOIN d USING (r)
WHERE list_has_all(w[greatest(p - 20, 1):p + 20], terms)
"""
