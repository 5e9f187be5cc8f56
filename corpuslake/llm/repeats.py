"""Long passages that occur more than once: the frame that op3 and op7 share.

Texts are sequences of elements (words or bytes). A window is ``size`` consecutive elements;
a window is *repeated* if its sequence also starts anywhere else. To find all repeated
windows without moving every position of every text:

1. Each window chooses an anchor by its own content alone: the gram of ``gram`` elements
   inside it with the least hash (the rightmost among equals). Equal windows choose equal
   grams at equal distances. Consecutive windows with one anchor form a unit, about two for
   every size - gram + 2 elements, and only units are dealt out.
2. Units are counted by their gram, the prefix that all suffixes from their anchors begin
   with, and where a gram occurs twice by their whole content, which is told apart by a 128-bit
   BLAKE2 digest. A gram with a single content is a subtree without a fork and settled by its
   count: either all its windows are repeated, or none.
3. What is left is where repeats begin and end: different units around one gram. Their
   contents, one of each, are dealt out by gram in groups of bounded size and an operator's
   own resolver finds the repeated windows inside a group (suffix trees, or a suffix sort).
   A gram with more than GROUP_LIMIT contents, or with a heavy one, makes too large a group, so its prefix is
   lengthened to the whole window: windows are dealt out by the digest of their sequence and
   counted, with partial sums before the shuffle.

So a passage in a third of all documents, or thousands of copies, costs rows in proportion
to the documents that hold it, and no group is gathered whole. Rows that are equal in id and
text are looked into once: such a row's windows all occur in the other one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslake.llm.common import released, slices, written
from corpuslake.llm.numtext import PIECE, SPACES, _power_table, mixed, prefix_hash, range_hash

#: Contents around one gram beyond which its windows are dealt out by their whole sequence.
GROUP_LIMIT = 1000
#: Units of more bytes (of very long words) are heavy: so are the groups that hold them, whose windows are dealt out too.
HEAVY = 1 << 14
#: Rows, or bytes of units, that a resolver gets at a time, and the rest of the last group.
BATCH, RESOLVED_BYTES = 8192, 32 << 20
#: Windows that are looked at together; below 2**24.
CHUNK = 1 << 17
#: Words of more bytes are hashed one by one.
LONG_WORD = 1 << 12
#: Bytes of text, or of what is made from it, that a task holds at a time besides one text.
HELD = 4 << 20
_LOW = (1 << 24) - 1
#: Marks a heavy unit in the number that packs its windows and anchor.
_HEAVY_BIT = 1 << 62


@dataclass(frozen=True)
class Alphabet:
    """What the elements are. size: elements of a window; gram: of an anchor."""

    words: bool
    size: int
    gram: int

    def __post_init__(self):
        if not 0 < self.gram <= self.size < 1 << 12:
            raise ValueError(f"windows of {self.size} elements with grams of {self.gram}: they must be 1 to 4095, and no shorter than grams")

    def line(self, text: bytes | None) -> Line:
        if not self.words:
            return Line(text or b"", None, None, len(text or b""))
        buf = _single_spaced(np.frombuffer(text or b"", np.uint8))
        gap = np.flatnonzero(buf == 32)
        some = int(len(buf) > 0)
        return Line(buf.tobytes(), np.concatenate((np.zeros(some, np.int64), gap + 1)), np.append(gap, [len(buf)] * some), len(gap) + some)

    def grams(self, line: Line, at: int, n: int) -> np.ndarray:
        """Hashes of the ``n`` grams from element ``at`` on; equal grams have equal hashes anywhere."""
        end = at + n + self.gram - 1
        if not self.words:
            i = np.arange(n)
            return range_hash(prefix_hash(np.frombuffer(line.data, np.uint8, end - at, at)), i, i + self.gram)
        h = _word_hashes(line.data, line.start[at:end], line.end[at:end])
        power, inverse = _power_table(len(h) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * power[: len(h)])))
        return mixed((sums[self.gram :] - sums[: -self.gram]) * inverse[:n])


def _single_spaced(buf: np.ndarray) -> np.ndarray:
    """The bytes with every run of white space made one space, and none at the ends."""
    word = SPACES[buf]
    stays = word.copy()
    stays[1:] |= word[:-1]
    out = np.where(word, buf, np.uint8(32))[stays]
    return out[:-1] if len(out) and out[-1] == 32 else out


def _word_hashes(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), np.uint64)
    long = np.flatnonzero(end - start > LONG_WORD)
    for i in long.tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]])
    for a, stop in zip(np.append(0, long + 1).tolist(), np.append(long, len(start)).tolist(), strict=True):
        while a < stop:
            b = min(stop, max(a + 1, int(np.searchsorted(end, start[a] + PIECE))))
            s, e = start[a:b] - start[a], end[a:b] - start[a]
            out[a:b] = range_hash(prefix_hash(np.frombuffer(data, np.uint8, int(e[-1]), int(start[a]))), s, e)
            a = b
    return out


@dataclass(frozen=True)
class Line:
    data: bytes
    start: np.ndarray | None
    end: np.ndarray | None
    n: int

    def cut(self, i: int, j: int) -> bytes:
        """Elements i to j - 1."""
        return self.data[i:j] if self.start is None else self.data[self.start[i] : self.end[j - 1]]


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    full = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[: len(x)] = x
    block = full.reshape(-1, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def units(alphabet: Alphabet, line: Line) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last window, anchor and gram hash of each unit of a text."""
    count, width = line.n - alphabet.size + 1, alphabet.size - alphabet.gram + 1
    if count <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    parts = []
    for at in range(0, count, CHUNK):
        n = min(CHUNK, count - at)
        own = alphabet.grams(line, at, n + width - 1)
        # The high bits rank the grams; among equals the later one wins.
        key = (own & np.uint64(~_LOW & (2**64 - 1))) | np.uint64(_LOW) - np.arange(len(own), dtype=np.uint64)
        anchor = _LOW - (_sliding_least(key, width) & np.uint64(_LOW)).astype(np.int64)
        first = np.flatnonzero(np.diff(anchor, prepend=-1))
        last = np.append(first[1:], n) - 1
        parts.append((first + at, last + at, anchor[first] + at, own[anchor[first]]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def runs_cover(runs: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """Merged element ranges [start, end) covered by runs of windows (first, last)."""
    out: list[list[int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + size)
        else:
            out.append([first, last + size])
    return [tuple(x) for x in out]


def kept_bytes(alphabet: Alphabet, line: Line, removed: list[tuple[int, int]]) -> bytes:
    """What stays of a text: its words joined by one space, or its bytes."""
    parts, at = [], 0
    for s, e in [*removed, (line.n, line.n)]:
        if s > at:
            parts.append(line.cut(at, s))
        at = e
    return (b" " if alphabet.words else b"").join(parts)


_LONGS = T.ArrayType(T.LongType())
_ROW = ["k1", "k2"]
_CONTENT = ["c1", "c2"]


def _list(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))


def _digests(line: Line, first: list[int], end: list[int]) -> np.ndarray:
    """Two columns: the 128-bit digests of the element ranges [first, end)."""
    found = b"".join(hashlib.blake2b(line.cut(i, j), digest_size=16).digest() for i, j in zip(first, end, strict=True))
    return np.frombuffer(found, np.int64).reshape(-1, 2)


def _unpack(at: int) -> tuple[int, int, int]:
    """First window, last window and anchor of a unit."""
    at &= _HEAVY_BIT - 1
    return at >> 24, (at >> 24) + ((at >> 12) & 0xFFF), (at >> 24) + (at & 0xFFF)


def _arrow(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def row_keys(doc_id: Column, text: Column) -> list[Column]:
    """k1 and k2: 128 bits that tell rows with different ids or texts apart."""
    ids, body = F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))
    return [F.xxhash64(ids, body).alias("k1"), F.xxhash64(body, ids).alias("k2")]


def remove_repeats(docs: DataFrame, alphabet: Alphabet, resolve: Callable, keep: list[str], with_text: bool) -> DataFrame:
    """The columns ``keep``, n, n_removed, n_spans, kept_sha256, and kept_text if asked for.

    ``resolve`` gets (key, lo, hi, body) arrays of a batch of whole groups, sorted by key, and
    returns for each row a boolean array over the distances lo..hi from window to anchor.
    ``docs`` needs doc_id and text. Equal rows are different rows: their windows repeat each
    other. Null and empty texts have no elements. Empty input gives empty output.
    """
    size = alphabet.size
    known = F.struct(*[F.col(c) for c in keep]).alias("kept")
    named = docs.select(*row_keys(F.col("doc_id"), F.col("text")), known, F.col("text").cast("binary").alias("text"))
    kept_field = named.schema["kept"]

    # Rows equal in id and text: one of them is looked into, and counts twice.
    copies = written(named.groupBy(*_ROW).count().where("count > 1").select(*_ROW), "equal-rows")
    have_copies = not copies.isEmpty()
    once = named.withColumn("times", F.lit(1))
    if have_copies:
        twice = named.join(copies, _ROW, "left_semi").dropDuplicates(_ROW).withColumn("times", F.lit(2))
        once = once.join(copies, _ROW, "left_anti").unionByName(twice)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4, HELD):
            at, keys, c1, c2, n, digests = [], [], [], [], [], []
            for text in b.column(4).to_pylist():
                line = alphabet.line(text)
                first, last, anchor, g = units(alphabet, line)
                heavy = line.end[last + size - 1] - line.start[first] > HEAVY if line.start is not None else np.zeros(len(first), bool)
                at.append((first << 24) | ((last - first) << 12) | (anchor - first) | np.where(heavy, _HEAVY_BIT, 0))
                keys.append(g.astype(np.int64))
                c = _digests(line, first.tolist(), (last + size).tolist())
                c1.append(c[:, 0])
                c2.append(c[:, 1])
                n.append(line.n)
                digests.append(hashlib.sha256(line.data).digest())
            cols = [*b.columns[:4], pa.array(n, pa.int64()), pa.array(digests, pa.binary()), *(_list(x) for x in (at, keys, c1, c2))]
            yield pa.RecordBatch.from_arrays(cols, names=["k1", "k2", "kept", "times", "n", "digest", "at", "key", "c1", "c2"])

    longs = [T.StructField(c, T.LongType()) for c in _ROW]
    schema = T.StructType([*longs, kept_field, T.StructField("times", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), *[T.StructField(c, _LONGS) for c in ("at", "key", "c1", "c2")]])
    found = written(once.select(*_ROW, "kept", "times", "text").mapInArrow(find, schema), "units")

    each = found.select(*_ROW, "times", F.explode(F.arrays_zip("at", "key", "c1", "c2")).alias("u")).select(*_ROW, "times", "u.*")
    again = each.groupBy("key").agg(F.sum("times").alias("n")).where("n > 1").select("key")
    # Each small table below is stored before it is joined: both sides of the join are then
    # dealt out for it alone, and Spark can split the tasks of a gram that very many units share.
    again = written(again, "repeated-grams")
    shared = written(each.join(again, "key"), "shared-units")
    # The units of all texts are read no more.
    rows = written(found.drop("at", "key", *_CONTENT), "rows")
    released(found)
    by_content = shared.groupBy("key", *_CONTENT).agg(F.sum("times").alias("n"), F.min(F.struct(*_ROW, "at")).alias("one"))
    by_content = written(by_content, "unit-contents")
    contested = by_content.groupBy("key").agg(F.count(F.lit(1)).alias("contents"), F.max(F.col("one.at") >= _HEAVY_BIT).alias("heavy")).where("contents > 1")
    contested = written(contested, "contested-grams")
    # "full" units are repeated as a whole; one of each content around a contested gram is looked into.
    state = by_content.join(contested, "key", "left").where("n > 1 OR contents > 1")
    state = written(state, "unit-states")
    is_one = (F.col("one.k1") == F.col("k1")) & (F.col("one.k2") == F.col("k2")) & (F.col("one.at") == F.col("at"))
    marked = shared.join(state, ["key", *_CONTENT]).select(
        *_ROW, "times", "at", "key", (F.col("n") > 1).alias("full"),
        F.when(is_one & F.col("contents").isNotNull(), F.when((F.col("contents") > GROUP_LIMIT) | F.col("heavy"), F.lit(2)).otherwise(F.lit(1))).otherwise(F.lit(0)).alias("look"),
    )
    # What all windows of a doubled row are is known; it is only looked into for the others' sake.
    marked = marked.where("times = 1 OR look > 0")
    per_doc = marked.groupBy(*_ROW).agg(F.collect_list(F.struct("at", "key", "full", "look")).alias("marks"))
    per_doc = written(per_doc, "marks")
    involved = written(once.join(per_doc, _ROW), "involved-documents")
    released(again, shared, by_content, contested, state)

    body_fields = [("key", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("full", pa.bool_()), ("anchor", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("body", pa.binary())]
    body_names = [n for n, _ in body_fields]

    def looked_into(what: int):
        """(k1, k2, line, mark) of the units of state ``what``, with the size of the texts so far."""
        def each_mark(b: pa.RecordBatch):
            for k1, k2, text, marks in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                line = None
                for m in marks:
                    if m["look"] == what:
                        line = line or alphabet.line(text)
                        yield k1, k2, line, m

        return each_mark

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for b in slices(batches, 2, HELD):
            for k1, k2, line, m in looked_into(1)(b):
                first, last, anchor = _unpack(m["at"])
                out.append((m["key"], k1, k2, m["full"], anchor, anchor - last, anchor - first, line.cut(first, last + size)))
                held += len(out[-1][-1])
                if held > HELD:
                    yield _arrow(out, body_fields)
                    out, held = [], 0
        yield _arrow(out, body_fields)

    body_schema = "key long, k1 long, k2 long, full boolean, anchor long, lo long, hi long, body binary"
    looked = involved.where(F.exists("marks", lambda m: m["look"] > 0)).select(*_ROW, "text", "marks")
    groups = looked.mapInArrow(bodies, body_schema).repartition("key").sortWithinPartitions("key")
    run_schema = T.StructType([*longs, T.StructField("firsts", _LONGS), T.StructField("lasts", _LONGS)])

    def resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(t: pa.Table) -> pa.RecordBatch:
            col = {c: t[c].combine_chunks().to_numpy(zero_copy_only=False) for c in body_names[:-1]}
            repeated = resolve(col["key"], col["lo"], col["hi"], t["body"].to_pylist())
            out: dict[tuple, list[list[int]]] = {}
            for i, hit in enumerate(repeated):
                if not col["full"][i] and hit.any():
                    # Distances run against window starts.
                    edge = np.flatnonzero(np.diff(hit.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
                    own = out.setdefault((int(col["k1"][i]), int(col["k2"][i])), [[], []])
                    own[0] += (col["anchor"][i] - col["lo"][i] - (edge[1::2] - 1)).tolist()
                    own[1] += (col["anchor"][i] - col["lo"][i] - edge[::2]).tolist()
            lists = pa.list_(pa.int64())
            return _arrow([(*k, *v) for k, v in out.items()], [("k1", pa.int64()), ("k2", pa.int64()), ("firsts", lists), ("lasts", lists)])

        held, rows, size_of = [], 0, 0
        for b in slices(batches, len(body_names) - 1, HELD):
            held.append(b)
            rows += b.num_rows
            size_of += b.column(len(body_names) - 1).nbytes
            if rows >= BATCH or size_of >= RESOLVED_BYTES:
                t = pa.Table.from_batches(held)
                keys = t["key"].to_numpy()
                # Whole groups only: the last one may go on in the next batch.
                whole = int(np.searchsorted(keys, keys[-1]))
                if whole:
                    yield settle(t.slice(0, whole))
                held, rows = t.slice(whole).to_batches(), len(keys) - whole
                size_of = sum(x.column(len(body_names) - 1).nbytes for x in held)
        if rows:
            yield settle(pa.Table.from_batches(held))

    settled = groups.mapInArrow(resolved, run_schema)

    window_fields = [("h1", pa.int64()), ("h2", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("w", pa.int64()), ("full", pa.bool_())]

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2, HELD >> 3):
            out: list[tuple] = []
            for k1, k2, line, m in looked_into(2)(b):
                first, last, _ = _unpack(m["at"])
                at = range(first, last + 1)
                d = _digests(line, list(at), [w + size for w in at]).tolist()
                out += [(h1, h2, k1, k2, w, m["full"]) for w, (h1, h2) in zip(at, d, strict=True)]
                if len(out) > HELD >> 6:
                    yield _arrow(out, window_fields)
                    out = []
            yield _arrow(out, window_fields)

    hot = involved.where(F.exists("marks", lambda m: m["look"] == 2)).select(*_ROW, "text", "marks")
    hot = written(hot.mapInArrow(single, "h1 long, h2 long, k1 long, k2 long, w long, full boolean"), "hot-windows")
    # A window of a unit that is full stands for at least two.
    many = hot.groupBy("h1", "h2").agg(F.sum(F.when(F.col("full"), 2).otherwise(1)).alias("n")).where("n > 1").select("h1", "h2")
    hot = hot.where(~F.col("full")).join(many, ["h1", "h2"]).select(*_ROW, F.array("w").alias("firsts"), F.array("w").alias("lasts"))
    edges = settled.unionAll(hot).groupBy(*_ROW).agg(F.flatten(F.collect_list("firsts")).alias("firsts"), F.flatten(F.collect_list("lasts")).alias("lasts"))

    fulls = F.transform(F.filter("marks", lambda m: m["full"]), lambda m: m["at"])
    last_step = involved.where("times = 1").select(*_ROW, "kept", "text", fulls.alias("fulls")).join(edges, _ROW, "left").select("kept", "text", "fulls", "firsts", "lasts")
    tail = [("n", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType())] + [("kept_text", T.StringType())] * with_text
    kinds = {T.LongType(): pa.int64(), T.StringType(): pa.string()}

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, HELD):
            rows: list[tuple] = []
            for text, fulls_, firsts, lasts in zip(*(b.column(i).to_pylist() for i in range(1, 5)), strict=True):
                line = alphabet.line(text)
                runs = [_unpack(a)[:2] for a in fulls_] + list(zip(firsts or (), lasts or (), strict=True))
                removed = runs_cover(runs, size)
                left = kept_bytes(alphabet, line, removed)
                rows.append((line.n, sum(e - s for s, e in removed), len(removed), hashlib.sha256(left).hexdigest(), *[(text if not removed else left).decode("utf-8", "ignore") if text is not None else None] * with_text))
            done = _arrow(rows, [(c, kinds[k]) for c, k in tail])
            yield pa.RecordBatch.from_arrays([b.column(0), *done.columns], names=["kept", *done.schema.names])

    done = last_step.mapInArrow(finish, T.StructType([kept_field, *[T.StructField(c, k) for c, k in tail]]))

    def as_result(rows: DataFrame, gone: Column) -> DataFrame:
        """Rows that stay whole, or go whole where ``gone`` is true."""
        none, spans = F.lit(0).cast("long"), gone.cast("long")
        left = F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.lower(F.hex("digest")))
        text = [F.when(gone, F.lit("")).otherwise(F.col("text").cast("string")).alias("kept_text")] * with_text
        return rows.select("kept", "n", F.when(gone, F.col("n")).otherwise(none).alias("n_removed"), spans.alias("n_spans"), left.alias("kept_sha256"), *text)

    plain = rows.where("times = 1").join(per_doc.select(*_ROW), _ROW, "left_anti")
    if with_text:
        plain = plain.select(*_ROW, "n", "digest").join(named, _ROW)
    out = done.unionAll(as_result(plain, F.lit(False)))
    if have_copies:
        doubled = rows.where("times = 2").select(*_ROW, "n", "digest").join(named, _ROW)
        out = out.unionAll(as_result(doubled, F.col("n") >= size))
    return out.select(*[F.col(f"kept.{c}").alias(c) for c in keep], *[c for c, _ in tail])
