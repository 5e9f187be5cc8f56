"""Target-distribution importance resampling by batch concatenation.

The texts of a batch are joined into one buffer with a separator that no word can hold, one
pass of a regular expression finds all words of the buffer, the documents' offsets are looked up
by binary search, and n-grams whose words lie in different documents are masked out before
their buckets are counted. A bucket is a CRC-32, which is linear: that of a longer n-gram is made
from those of its parts, for all n-grams of the buffer at once.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslake.llm.common import finished, slices, table, text_of, written

SEPARATOR = b"\x00"
#: Runs of digits, small letters and everything beyond ASCII, in bytes; or the separator of two texts.
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+|\x00")
#: A-Z become small; a zero byte of a text becomes a space, so that it separates words only.
LOWER = bytes(range(256)).lower().replace(SEPARATOR, b" ")
INSIDE = frozenset(b for b in range(1, 256) if WORDS.fullmatch(LOWER[b : b + 1]))
BUCKETS = 10000
LONGEST = 3
#: Bytes of texts that are joined at a time. A longer text is taken in parts.
BATCH_BYTES = 1 << 20
#: Rows that one task of the final sort takes.
SORTED_ROWS = 200_000


def _after_zeros() -> np.ndarray:
    """``[k, j, b]``: byte j with value b of a CRC after 2^k zero bytes more."""
    first = np.zeros(256, np.uint32)
    for n in range(256):
        c = n
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        first[n] = c
    x = np.arange(256, dtype=np.uint32)
    out = np.zeros((32, 4, 256), np.uint32)
    for j in range(4):
        v = x << np.uint32(8 * j)
        out[0, j] = first[v & 255] ^ (v >> np.uint32(8))
    for k in range(1, 32):
        for j in range(4):
            out[k, j] = _apply(out[k - 1], out[k - 1, j])
    return out


def _apply(operator: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return operator[0][crc & 255] ^ operator[1][(crc >> np.uint32(8)) & 255] ^ operator[2][(crc >> np.uint32(16)) & 255] ^ operator[3][crc >> np.uint32(24)]


POWERS = _after_zeros()


def _by_length(most: int = 64) -> np.ndarray:
    out = np.zeros((most, 4, 256), np.uint32)
    for j in range(4):
        out[0, j] = np.arange(256, dtype=np.uint32) << np.uint32(8 * j)
    for n in range(1, most):
        for j in range(4):
            out[n, j] = _apply(POWERS[0], out[n - 1, j])
    return out


SHORT = _by_length()


def crc_shifted(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """The part of a CRC-32 that remains of ``crc`` when ``zeros`` bytes follow: that of the whole is
    this, exclusive or the CRC-32 of what follows."""
    at = np.minimum(zeros, len(SHORT) - 1) * 1024
    flat = SHORT.reshape(-1)
    out = flat[at + (crc & 255)] ^ flat[at + (256 + ((crc >> np.uint32(8)) & 255))] ^ flat[at + (512 + ((crc >> np.uint32(16)) & 255))] ^ flat[at + (768 + (crc >> np.uint32(24)))]
    for i in np.flatnonzero(zeros >= len(SHORT)):
        c, left = crc[i : i + 1], int(zeros[i])
        for k in range(left.bit_length()):
            if left >> k & 1:
                c = _apply(POWERS[k], c)
        out[i] = c[0]
    return out


class Grams:
    """Buckets of the n-grams of a run of texts, given in parts."""

    def __init__(self, buckets: int = BUCKETS, longest: int = LONGEST):
        self.buckets, self.longest = buckets, longest
        self.space, self.end = np.uint32(zlib.crc32(b" ")), np.uint32(zlib.crc32(SEPARATOR))
        self.forget()

    def forget(self) -> None:
        #: Last words of the part before, as far as its last text goes on: CRCs of the n-grams that end with the last of them.
        self.ends = [np.zeros(0, np.uint32)] * self.longest

    def __call__(self, parts: list[bytes], goes_on: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(buckets, which part each is of, words of each part). With ``goes_on`` the first part
        continues the last one of the call before."""
        words = WORDS.findall(SEPARATOR.join([p.translate(LOWER) for p in parts]))
        size = np.fromiter(map(len, words), np.int64, len(words))
        crc = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
        offsets = np.flatnonzero((crc == self.end) & (size == 1))
        doc = np.searchsorted(offsets, np.arange(len(words)))
        kept = np.ones(len(words), bool)
        kept[offsets] = False
        size, crc, doc, n = size[kept], crc[kept], doc[kept], len(words) - len(offsets)
        led = crc_shifted(np.full(n, self.space, np.uint32), size) ^ crc  # a space, then the word
        count = np.bincount(doc, minlength=len(parts))
        if not goes_on:
            self.forget()
        # grams[k]: CRCs of the (k+1)-grams that end at each word; known[k]: whether all its words are of one text.
        grams, known, ends = crc, np.ones(n, bool), []
        out, of = [crc % np.uint32(self.buckets)], [doc]
        held = self.ends
        for k in range(1, self.longest):
            before = np.concatenate([held[k - 1] if len(held[k - 1]) else np.zeros(1, np.uint32), grams[:-1]]) if n else grams
            there = np.concatenate([[bool(len(held[k - 1])) and (n > 0 and doc[0] == 0)], known[:-1] & (doc[1:] == doc[:-1])]) if n else known
            ends.append((grams, known))
            grams, known = crc_shifted(before, size + 1) ^ led, there
            out.append(grams[known] % np.uint32(self.buckets))
            of.append(doc[known])
        ends.append((grams, known))
        if n and doc[-1] == len(parts) - 1:
            self.ends = [g[-1:] if k[-1] else np.zeros(0, np.uint32) for g, k in ends]
        elif len(parts) > 1:
            self.forget()
        return np.concatenate(out), np.concatenate(of), count


def _parts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes], bool, bool]]:
    """(rows, their texts' bytes, whether the first goes on from before, whether the last is finished).
    A text of more than BATCH_BYTES comes alone, in parts cut after a byte that is of no word."""
    for b in slices(batches, column, BATCH_BYTES):
        texts = b.column(column).to_pylist()
        if len(texts) > 1 or len(texts[0]) <= BATCH_BYTES:
            yield b, texts, False, True
            continue
        text, at = texts[0], 0
        while at < len(text):
            end = at + BATCH_BYTES
            while end < len(text) and text[end - 1] in INSIDE:
                end += 1
            end = min(end, len(text))
            yield b, [text[at:end]], at > 0, end == len(text)
            at = end


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(bucket, n) over all n-grams of the ``text`` of ``texts``; a task sends a row for each bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, total = Grams(buckets, longest), np.zeros(buckets, np.int64)
        for _, parts, goes_on, _ in _parts(batches, 0):
            total += np.bincount(grams(parts, goes_on)[0], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    rows = texts.select(text_of(F.col("text")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """1000 times the log ratio of a bucket's smoothed share in ``target`` to that in ``docs``, floored."""
    def counts(texts: DataFrame) -> np.ndarray:
        out = np.zeros(buckets)
        for r in bucket_counts(texts, buckets, longest).collect():  # one row for each bucket
            out[r["bucket"]] = r["n"]
        return out

    s, t = counts(docs), counts(target)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weighed(docs: DataFrame, gains: np.ndarray, keep=("doc_id",), longest: int = LONGEST) -> DataFrame:
    """The columns ``keep`` of every row, n_words, n_features and weight (the sum of its n-grams' gains)."""
    rows = docs.select(F.struct(*[F.col(c) for c in keep]).alias("kept"), text_of(F.col("text")).cast("binary").alias("text"))
    schema = T.StructType([rows.schema["kept"], *[T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, long = Grams(len(gains), longest), np.zeros(3, np.int64)
        for b, parts, goes_on, over in _parts(batches, 1):
            found, of, words = grams(parts, goes_on)
            # Sums of whole numbers in doubles are exact below 2^53.
            made = np.array([words, np.bincount(of, minlength=len(parts)), np.bincount(of, weights=gains[found], minlength=len(parts))]).astype(np.int64)
            if goes_on or not over:
                long = long * goes_on + made[:, 0]
                made = long[:, None]
            if over:
                yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, made)], names=["kept", "n_words", "n_features", "weight"])

    return rows.mapInArrow(run, schema).select("kept.*", "n_words", "n_features", "weight")


def noise(doc_id, seed: int = 42):
    """1000 times a Gumbel variate that the id decides; a null id counts as empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, score: str, tie: str, draw: int) -> DataFrame:
    """``rank`` for the ``draw`` rows of the highest score, ties to the smaller ``tie`` (null last), null for
    the others. ``rows`` must be a stored table.

    Rows that are surely below the cut are set apart by a quantile; the others are range-sorted on
    score and tie together, so equal scores don't meet in one task, and each range counts on from
    the rows of those before it. Rows equal in both take ranks in any order.
    """
    spark = rows.sparkSession
    total = rows.count()
    if not draw:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    accuracy = 10000
    share = 1 - draw / total - 3 / accuracy
    cut = rows.agg(F.percentile_approx(score, share, accuracy)).first()[0] if share > 0 else None
    high = rows.where(F.col(score) >= cut) if cut is not None else rows
    if cut is not None and (n := high.count()) < draw:
        high, cut = rows, None
    n = total if cut is None else n
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // SORTED_ROWS))
    order = [F.col(score).desc(), F.col(tie).asc_nulls_last()]
    numbered = high.withColumn("__copy", F.rand(7)).repartitionByRange(parts, *order, F.col("__copy")).withColumn("__range", F.spark_partition_id())
    high = written(numbered, "ranges")
    sizes = high.groupBy(F.col("__range").alias("__of")).agg(F.count(F.lit(1)).alias("__n"))
    # One row for each range.
    ahead = sizes.select("__of", (F.sum("__n").over(Window.orderBy("__of")) - F.col("__n")).alias("__ahead"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order, F.col("__copy")))
    high = high.withColumn("__place", place).join(F.broadcast(ahead), F.col("__range") == F.col("__of"))
    rank = F.col("__place") + F.col("__ahead")
    high = high.withColumn("rank", F.when(rank <= draw, rank).cast("long")).select(*rows.columns, "rank")
    if cut is None:
        return high
    return high.unionByName(rows.where(F.col(score) < cut).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = 42, keep=("doc_id",)) -> DataFrame:
    """Draw ``percent`` of the rows of ``docs`` whose texts have ``least_words`` words, without replacement,
    as if weighed by how likely their n-grams are in ``target`` against ``docs`` (the Gumbel top-k trick).

    Returns the columns ``keep`` (with doc_id) of every row, n_features, weight, score and rank
    (null: not drawn). A null or empty text has no features and weight 0; equal rows have equal
    scores and are ranked one after the other; a null id is drawn like any other and loses ties.
    Empty ``docs`` give empty output, an empty ``target`` gives gains by smoothing alone.
    Other columns are ignored.
    """
    names = list(dict.fromkeys([*keep, "doc_id"]))
    gains = bucket_gains(docs, target, buckets, longest)
    rows = weighed(docs, gains, names, longest)
    scored = written(rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "resampling")
    enough = scored.where(F.col("n_words") >= least_words)
    out = ranked(enough, "score", "doc_id", percent * enough.count() // 100)
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return out.unionByName(rest).select(*names, "n_words", "n_features", "weight", "score", "rank")


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    found = finished("resampled", lambda: resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


ORACLE = r"""
WITH entries AS (
  SELECT i, list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c FROM range(256) t(i)),
steps AS (SELECT list(c ORDER BY i) AS step FROM entries),
worded AS (
  SELECT 0 AS side, rowid AS row, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT row_number() OVER () AS rowid, text FROM documents)
  UNION ALL
  SELECT 1, 0, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
grams AS (
  SELECT side, row, unnest(list_concat(w,
    list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS gram
  FROM worded),
counted AS (SELECT side, row, gram, count(*) AS n FROM grams GROUP BY ALL),
hexed AS (SELECT gram, hex(encode(gram)) AS h FROM (SELECT DISTINCT gram FROM counted)),
bucketed AS (
  SELECT gram, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::UBIGINT)),
                               lambda c, b: xor(step[((xor(c, b) & 255) + 1)::BIGINT], c >> 8)), 4294967295::UBIGINT) % 10000 AS bucket
  FROM hexed, steps),
tally AS (
  SELECT bucket, sum(n) FILTER (side = 0)::DOUBLE AS s, sum(n) FILTER (side = 1)::DOUBLE AS t FROM counted JOIN bucketed USING (gram) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM tally) + 10000)
                                 / ((coalesce(s, 0) + 1) * ((SELECT coalesce(sum(t), 0) FROM tally) + 10000))))::BIGINT AS gain FROM tally),
weights AS (
  SELECT row, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM counted JOIN bucketed USING (gram) JOIN gains USING (bucket) WHERE side = 0 GROUP BY row),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(len(w), 0) >= 20 AS enough,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::UBIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM (SELECT row_number() OVER () AS row, doc_id FROM documents) JOIN worded USING (row) LEFT JOIN weights USING (row) WHERE side = 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY enough ORDER BY score DESC, doc_id) AS place, count(*) FILTER (enough) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN enough AND place <= 5 * n // 100 THEN place END AS rank FROM placed
"""
