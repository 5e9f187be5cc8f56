"""Nearest neighbours by largest inner product, as a block matrix join.

Queries and candidates are packed into blocks; each query block meets each candidate block
once, in a tile. The tiles are dealt into tasks by ranges of query blocks and groups of
candidate blocks: a task holds the query blocks of its range, a bounded number of bytes, and
reads the candidate blocks of its group one after the other. A tile multiplies int8 codes (exactly,
as small whole numbers in a float matrix product), bounds every product's quantisation error,
and keeps a pair only if its upper bound reaches the k-th best that the query has seen in the
task so far. Surviving pairs are recomputed from the original vectors in double precision and
merged in a heap of k for each query; the tasks' lists are merged by a final rank.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.llm.common import finished, table, written

QUERY_BLOCK = 512
ROW_BLOCK = 4096
#: Bytes of query vectors that a task holds.
QUERY_BYTES = 32 << 20


def usable(vector: Column) -> Column:
    """True for vectors that take part: no null, no NaN or infinity, not all zero, not empty."""
    fine = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _quantised(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale of each row and the L1 norm of each decoded row."""
    scale = np.abs(v).max(axis=1) / 127.0
    scale[scale == 0] = np.finfo(np.float64).tiny
    codes = np.rint(v / scale[:, None]).astype(np.int8)
    return codes, scale, np.abs(codes.astype(np.float64)).sum(axis=1) * scale


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added from the first component to the last."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def _survivors(q: np.ndarray, qi: np.ndarray, v: np.ndarray, vi: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a tile's pairs whose upper bound reaches the query's k-th best:
    the k-th lower bound in the tile, or ``floor`` if that is more."""
    qc, qs, ql = _quantised(q)
    vc, vs, vl = _quantised(v)
    dim = q.shape[1]
    # Whole numbers below 2**24 for up to 1040 components at a time: exact in float32.
    tile = sum(qc[:, j : j + 1024].astype(np.float32) @ vc[:, j : j + 1024].astype(np.float32).T for j in range(0, dim, 1024)).astype(np.float64)
    mid = tile * qs[:, None] * vs[None, :]
    bound = 0.5 * (ql[:, None] * vs[None, :] + qs[:, None] * vl[None, :]) + 0.25 * dim * qs[:, None] * vs[None, :]
    bound = bound * (1 + 1e-9) + 1e-300
    other = qi[:, None] != vi[None, :]
    if len(v) >= k:
        low = np.where(other, mid - bound, -np.inf)
        floor = np.maximum(floor, np.partition(low, len(v) - k, axis=1)[:, len(v) - k])
    return np.nonzero(other & (mid + bound >= floor[:, None]))


class Heaps:
    """The k best (score, vec_id) of each of some queries: the worst on top, of ties the larger vec_id."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in ids]
        self.floor = np.full(len(ids), -np.inf)

    def add(self, row: np.ndarray, vec_id: np.ndarray, score: np.ndarray) -> None:
        for i, v, s in zip(row.tolist(), vec_id.tolist(), score.tolist(), strict=True):
            heap = self.heaps[i]
            if len(heap) < self.k:
                heapq.heappush(heap, (s, -v))
            else:
                heapq.heappushpop(heap, (s, -v))
        for i in np.unique(row).tolist():
            if len(self.heaps[i]) == self.k:
                self.floor[i] = self.heaps[i][0][0]

    def rows(self) -> pd.DataFrame:
        found = [(q, -v, s) for q, heap in zip(self.ids.tolist(), self.heaps, strict=True) for s, v in heap]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def _tiles(k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, Heaps]] = []
        for f in frames:
            for r in f.itertuples(index=False):
                ids, vecs = np.frombuffer(r.ids, np.int64), np.frombuffer(r.vecs, np.float64).reshape(-1, r.dim)
                if r.kind == 0:
                    held.append((vecs, Heaps(ids, k)))
                    continue
                for q, heaps in held:
                    if q.shape[1] == r.dim:
                        i, j = _survivors(q, heaps.ids, vecs, ids, heaps.floor, k)
                        heaps.add(i, ids[j], _exact(q[i], vecs[j]))
        for _, heaps in held:
            yield heaps.rows()

    return run


def _packed(rows: int):
    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for dim, same in f.groupby(f["vec"].map(len)):
                for at in range(0, len(same), rows):
                    part = same.iloc[at : at + rows]
                    yield pd.DataFrame({"dim": [dim], "ids": [part["vec_id"].to_numpy(np.int64).tobytes()], "vecs": [np.stack(part["vec"].to_numpy()).astype(np.float64).tobytes()]})

    return pack


def _blocks(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, int, int]:
    """The stored blocks of ``rows``, numbered from 0 without gaps; how many there are and their largest size in bytes."""
    packed = written(rows.mapInPandas(_packed(size), "dim int, ids binary, vecs binary").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), name)
    sizes = packed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("vecs")).alias("bytes")).orderBy("part").collect()
    # One row for each stored part: where its blocks begin.
    starts = np.cumsum([0] + [r["n"] for r in sizes]).tolist()
    begins = rows.sparkSession.createDataFrame([(r["part"], s) for r, s in zip(sizes, starts, strict=False)], "part int, start long")
    nth = F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return packed.join(begins, "part").select("dim", "ids", "vecs", nth.alias("nth")), starts[-1], max((r["bytes"] for r in sizes), default=0)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vec_id of ``queries`` (vec_id, embedding) the
    ``k`` rows of ``vectors`` with the largest inner product, ties to the smaller vec_id.

    A row never meets itself (equal vec_id); if there are fewer than ``k`` candidates all are
    returned. Null, zero or non-finite vectors, and null ids, take no part. Vectors of
    different lengths never meet. Repeated rows of one vec_id all compete as candidates; of
    repeated query ids the one with the least vector asks. Empty tables give empty output; other
    columns are ignored.
    """
    def clean(df):
        vec = F.transform("embedding", lambda x: x.cast("double"))
        return df.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec"))

    asked = clean(queries).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    q, n_q, q_bytes = _blocks(asked, QUERY_BLOCK, "query-blocks")
    v, n_v, _ = _blocks(clean(vectors), ROW_BLOCK, "row-blocks")
    # Query blocks by ranges that a task can hold; groups of row blocks for as many tasks as keep
    # the cluster busy, or of 16 blocks where there are more.
    held = max(1, QUERY_BYTES // max(1, q_bytes))
    ranges = max(1, -(-n_q // held))
    groups = max(1, min(n_v, max(-(-vectors.sparkSession.sparkContext.defaultParallelism * 2 // ranges), n_v // 16)))
    one = F.floor(F.col("nth") / held).cast("int")
    q = q.select(F.lit(0).alias("kind"), "dim", "ids", "vecs", F.explode(F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: g * ranges + one)).alias("task"))
    g = F.pmod("nth", F.lit(groups)).cast("int")
    v = v.select(F.lit(1).alias("kind"), "dim", "ids", "vecs", F.explode(F.transform(F.sequence(F.lit(0), F.lit(ranges - 1)), lambda r: g * ranges + r)).alias("task"))
    tiles = q.unionAll(v).repartitionById(groups * ranges, "task").sortWithinPartitions("kind").select("kind", "dim", "ids", "vecs")
    local = tiles.mapInPandas(_tiles(k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_block_matrix_knn(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return finished("nearest", lambda: nearest(rows, rows.where("vec_id % 20 = 0")))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
