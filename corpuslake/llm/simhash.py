"""SimHash near-duplicates with the generalised pigeonhole principle.

Fingerprints are made from whole texts. Distinct fingerprints are then linked at up to
``radius`` differing bits. The 64 bits are grouped into partitions, correlated bits together,
and partition i gets a threshold T_i >= -1 with sum(T_i) = radius - m + 1: two fingerprints
within the radius differ in at most T_i bits in some partition. Partitions and thresholds are
chosen by dynamic programming on candidate counts estimated from a bounded sample; the choice
moves work about and never changes the result. Probes hit exact-match buckets and each pair is
verified on all 64 bits.

A bucket with many members (near copies by the thousand, correlated bits) would make pairs
with the square of its size. Its members go an exact linear way instead: two fingerprints are
within two bits of each other just if they share a fingerprint that is within one bit of
both, so each emits itself and its 64 one-bit variants, and all that share a variant are
linked to the least of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslake.llm.common import finished, table, written
from corpuslake.llm.graph import components

#: Distinct fingerprints that the cost estimates look at.
SAMPLE = 4096
#: Members of a bucket beyond which it goes the linear way.
PAIR_LIMIT = 64
BLOCK = 1 << 16


def fingerprint(text: bytes | None, words_per_shingle: int = 3) -> int:
    """Majority bits of the shingles' XXH64 (seed 42); 0 where there is no word."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - words_per_shingle + 1)
    last = ends[min(words_per_shingle, len(words)) - 1 :].tolist()
    first, digest = starts[:n].tolist(), xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        h = np.array([digest(line[s:e], 42) for s, e in zip(first[at : at + BLOCK], last[at : at + BLOCK], strict=True)], dtype=">u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = [fingerprint(t) for t in b.column(b.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps, pa.int64())], names=[*b.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for each row; fp is a signed 64-bit number. Null and empty texts have fp 0."""
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprints, T.StructType([rows.schema["doc_id"], T.StructField("fp", T.LongType())]))


def bit_groups(sample: np.ndarray, m: int) -> list[list[int]]:
    """Deal the 64 bits into ``m`` partitions of about equal entropy, correlated bits together."""
    bits = ((sample[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    spread = bits - bits.mean(axis=0)
    size = np.sqrt((spread**2).mean(axis=0)) + 1e-9
    close = np.abs(spread.T @ spread / len(bits) / size[:, None] / size[None, :])
    left, groups = set(range(64)), []
    for i in range(m):
        room = len(left) // (m - i)
        group = [max(left, key=lambda b: (size[b], -b))]
        left.discard(group[0])
        while len(group) < room:
            nxt = max(left, key=lambda b: (close[b, group].mean(), -b))
            group.append(nxt)
            left.discard(nxt)
        groups.append(sorted(group))
    return groups


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def thresholds(sample: np.ndarray, groups: list[list[int]], radius: int, rows: int) -> tuple[float, list[int]]:
    """The cheapest thresholds for these partitions and their estimated cost, in rows made."""
    m, scale = len(groups), rows / max(1, len(sample))
    costs = []
    for bits in groups:
        part = sample & np.uint64(_mask(bits))
        near = np.bitwise_count(part[:512, None] ^ part[None, :])
        cost = {-1: 0.0}
        probes = 1
        for t in range(radius + 1):
            if t:
                probes = probes + (len(bits) if t == 1 else len(bits) * (len(bits) - 1) // 2)
            # Candidates of one fingerprint: those of the sample, scaled, itself left out, and a uniform floor.
            hit = max(0.0, float((near <= t).sum(axis=1).mean()) - 1) * scale
            cost[t] = rows * (probes + max(hit, probes * rows / 2.0 ** len(bits)))
        costs.append(cost)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (spent, chosen) in best.items():
            for t, c in cost.items():
                if total + t not in step or spent + c < step[total + t][0]:
                    step[total + t] = (spent + c, [*chosen, t])
        best = step
    return best[radius - m + 1]


def plan(sample: np.ndarray, radius: int, rows: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition that is probed."""
    options = []
    for m in range(2, radius + 3):
        groups = bit_groups(sample, m)
        cost, chosen = thresholds(sample, groups, radius, rows)
        options.append((cost, [(g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0]))
    return min(options, key=lambda o: o[0])[1]


def _variants(fp: Column, bits: list[int], radius: int) -> Column:
    flips = [0]
    ones = [1 << b for b in bits]
    if radius >= 1:
        flips += ones
    if radius >= 2:
        flips += [x | y for i, x in enumerate(ones) for y in ones[i + 1 :]]
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in flips]
    return F.transform(F.array(*[F.lit(f).cast("long") for f in signed]), lambda f: fp.bitwiseXOR(f))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(fps: DataFrame, radius: int = 2, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """(a, b) edges between distinct fingerprints ``fp`` whose components are those of all
    pairs within ``radius`` (1 or 2) bits."""
    if radius not in (1, 2):
        raise ValueError("radius must be 1 or 2")
    rows = fps.count()
    sample = np.array([r[0] for r in fps.limit(SAMPLE).collect()], dtype=np.int64).astype(np.uint64)
    if rows < 2:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    probes = index = None
    for i, (bits, t) in enumerate(plan(sample, radius, rows)):
        mask = F.lit(_signed(_mask(bits))).cast("long")
        exact = fps.select(F.lit(i).alias("part"), F.col("fp").bitwiseAND(mask).alias("key"), "fp")
        near = fps.select(F.lit(i).alias("part"), F.explode(_variants(F.col("fp").bitwiseAND(mask), bits, t)).alias("key"), "fp") if t else exact
        probes, index = (near, exact) if probes is None else (probes.unionAll(near), index.unionAll(exact))
    heavy = index.groupBy("part", "key").count().where(F.col("count") > pair_limit).select("part", "key", F.lit(True).alias("heavy"))
    heavy = written(heavy, "heavy-buckets")
    index = index.join(heavy, ["part", "key"], "left_anti")
    pairs = probes.alias("x").join(index.alias("y"), ["part", "key"])
    distance = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp")))
    pairs = pairs.where((F.col("x.fp") != F.col("y.fp")) & (distance <= radius)).select(F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b")).distinct()
    crowded = probes.join(heavy, ["part", "key"], "left_semi").select("fp").distinct()
    if radius == 1:
        # Within one bit: equal after the bit is set, for some bit.
        one = [_signed(1 << b) for b in range(64)]
        variant = F.transform(F.array(*[F.lit(f).cast("long") for f in one]), lambda f: F.struct(f.alias("bit"), F.col("fp").bitwiseOR(f).alias("v")))
    else:
        variant = F.transform(_variants(F.col("fp"), list(range(64)), 1), lambda v: F.struct(F.lit(0).cast("long").alias("bit"), v.alias("v")))
    ball = crowded.select("fp", F.explode(variant).alias("v")).select("fp", "v.*")
    least = ball.groupBy("bit", "v").agg(F.min("fp").alias("a"), F.max("fp").alias("most")).where("a < most").select("bit", "v", "a")
    stars = ball.join(least, ["bit", "v"]).where("fp <> a").select("a", F.col("fp").alias("b")).distinct()
    return pairs.unionAll(stars)


def simhash_components(docs: DataFrame, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs`` (doc_id, text).

    component_id is the least doc_id reachable over links, the row's own included. Texts that
    are null, empty or without a word have fingerprint 0 and are linked like any other. Equal
    rows stay as they are; null ids take part and never are the least unless all are null.
    Empty input gives empty output; other columns are ignored.
    """
    rows = written(fingerprints(docs), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "fingerprint-classes")
    nodes = components(links(classes.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = classes.join(nodes, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    known = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return rows.join(known, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, radius: int = 2) -> DataFrame:
    """``docs`` without near-duplicates: of each component the row with the least doc_id stays.

    Among rows of one id the least text hash decides, and of equal rows one stays. A null id
    loses to any other. Edge cases as in ``simhash_components``.
    """
    digest = row_digest()
    rows = docs.select(F.struct("doc_id", digest.alias("digest")).alias("doc_id"), "text")
    rows = written(fingerprints(rows), "fingerprints").distinct()
    classes = written(rows.groupBy("fp").agg(least_row("doc_id")), "fingerprint-classes")
    nodes = components(links(classes.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = classes.join(nodes, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return keep_rows(docs, rooted.groupBy("root").agg(least_row("doc_id")).select("doc_id.*"))


def row_digest() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull())


def row_key(doc_id: Column, digest: Column) -> list[Column]:
    """Keys without nulls: the join and the choice among equal rows then share one exchange."""
    return [F.coalesce(doc_id.cast("string"), F.lit("")).alias("__id"), F.xxhash64(digest, doc_id.isNull()).alias("__row")]


def keep_rows(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """The rows of ``docs`` named by ``keep`` (doc_id, digest); of equal rows one."""
    keep = written(keep.select(*row_key(F.col("doc_id"), F.col("digest"))), "kept-rows")
    named = docs.select(*docs.columns, *row_key(F.col("doc_id"), row_digest()))
    return named.join(keep, ["__id", "__row"], "left_semi").dropDuplicates(["__id", "__row"]).select(*docs.columns)


def least_row(name: str) -> Column:
    """The least (doc_id, digest), null ids last."""
    return F.min_by(name, F.struct(F.col(name)["doc_id"].isNull(), F.col(name)["doc_id"], F.col(name)["digest"])).alias(name)


def op9_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    found = finished("simhash", lambda: simhash_components(table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
