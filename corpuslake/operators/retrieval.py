"""Batch retrieval: query sets against chunk tables.

Frames: queries (query_id, text or vector), chunks (chunk_id, text or vector, labels), hits
(query_id, chunk_id, score, rank). Ranks run from 1, ties go to the smaller chunk_id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.functions.text import terms
from corpuslake.sources.batches import BATCH_ITEMS, bounded
from corpuslake.sources.stored import written


def matching(chunks: DataFrame, tag: str | None = None, **filters: str | None) -> DataFrame:
    """Chunks that equal every given value; None is no condition. ``tag`` asks for membership in tags."""
    for name, value in filters.items():
        if value is not None:
            chunks = chunks.where(F.col(name) == value)
    return chunks.where(F.array_contains("tags", tag)) if tag is not None else chunks


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def manhattan(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def ranked(hits: DataFrame, k: int, *parts: str) -> DataFrame:
    """The ``k`` best of each query (and part) with rank."""
    w = Window.partitionBy("query_id", *parts).orderBy(F.desc("score"), "chunk_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Queries, and chunks, that are multiplied at a time, about.
QUERY_BLOCK, CHUNK_BLOCK = 512, 8192
#: Query blocks that a task gets, numbers in the vectors of its chunks, and tasks below which chunks are dealt into smaller groups.
TASK_BLOCKS, TASK_FLOATS, LEAST_TASKS = 16, 1 << 22, 64


def _unit(v: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return v / np.linalg.norm(v, axis=1, keepdims=True)


def block_hits(queries: DataFrame, chunks: DataFrame, k: int, threshold: float, part: str | None = None) -> DataFrame:
    """Cosine hits of queries (cell, query_id, vector) among the chunks (cell, chunk_id, vector) of
    their cell: of each group of chunks the ``k`` best of at least ``threshold``, with ``part`` those of each of its
    values.

    Each cell's queries are dealt into blocks and its chunks into groups of bounded size, as many as that cell
    needs, so that no task gets a whole side; each block meets each group of its cell once, in matrix
    products of bounded size, and hands on the best of the group alone. Chunks of cells that no query asks
    for are not moved. There must be few cells: their sizes come to the driver.
    """
    dtype = lambda df, c: df.schema[c].dataType.simpleString()
    found = [("query_id", queries), ("chunk_id", chunks), *[(part, chunks)] * bool(part)]
    names = [c for c, _ in found]
    schema = ", ".join([f"{c} {dtype(df, c)}" for c, df in found] + ["score double"])
    some = lambda df: df.where(F.col("vector").isNotNull() & (F.size("vector") > 0))
    queries, chunks = some(queries), some(chunks)
    count = lambda df: {r["cell"]: (r["n"], r["wide"]) for r in df.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("wide")).collect()}
    asked, held = count(queries), count(chunks)

    def dealt(cell) -> tuple[int, int, int]:
        (n, wide), blocks = held[cell], -(-asked[cell][0] // (QUERY_BLOCK * TASK_BLOCKS))
        return int(cell), blocks, max(-(-n * wide // TASK_FLOATS), min(-(-n // CHUNK_BLOCK), -(-LEAST_TASKS // blocks)))

    met = [dealt(c) for c in sorted(asked.keys() & held.keys())]
    cells = F.broadcast(queries.sparkSession.createDataFrame(met, "cell int, blocks int, groups int"))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # Columns get names of their own: queries may be rows of the chunks.
    own = lambda *names: [F.col(n).alias(n) for n in names]
    q = queries.join(cells, "cell").select(*own("cell"), deal("query_id", "blocks").alias("s"), every("groups").alias("g"), *own("query_id", "vector"))
    c = chunks.join(cells, "cell").select("cell", every("blocks").alias("s"), deal("chunk_id", "groups").alias("g"), "chunk_id", "vector", *[part] * bool(part))

    def best(s: np.ndarray) -> np.ndarray:
        return np.where(s >= np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k][:, None], s, -np.inf) if s.shape[1] > k else s

    def score(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(cs):
            return pd.DataFrame({n: [] for n in (*names, "score")})
        if part:
            cs = cs.sort_values(part)
        of = pd.factorize(cs[part], use_na_sentinel=False)[0] if part else np.zeros(len(cs), np.int64)
        qv, cv, out = (*(_unit(np.array([np.asarray(x, np.float64) for x in f["vector"]])) for f in (qs, cs)), [])
        for first in range(0, len(qs), QUERY_BLOCK):
            found = [tile(qv[first : first + QUERY_BLOCK], cv[at : at + CHUNK_BLOCK], of[at : at + CHUNK_BLOCK], at) for at in range(0, len(cs), CHUNK_BLOCK)]
            h = pd.DataFrame({"i": np.concatenate([f[0] for f in found]) + first, "j": np.concatenate([f[1] for f in found]), "score": np.concatenate([f[2] for f in found])})
            if len(found) > 1:
                h["of"] = of[h["j"]]
                h = h[h.groupby(["i", "of"] if part else "i")["score"].rank(method="min", ascending=False) <= k]
            out.append(h)
        h = pd.concat(out)
        got = {c: qs[c].to_numpy()[h["i"]] if c == "query_id" else cs[c].to_numpy()[h["j"]] for c in names}
        return pd.DataFrame(got | {"score": h["score"].to_numpy()})

    def tile(qv: np.ndarray, cv: np.ndarray, of: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, places from ``at`` and scores of the best of one matrix product."""
        s = qv @ cv.T
        s = np.where(np.isfinite(s) & (s >= threshold), s, -np.inf)
        place, firsts = np.arange(at, at + len(cv)), np.flatnonzero(np.diff(of, prepend=-1))
        for low, high in zip(firsts, [*firsts[1:], len(of)], strict=True) if part else [(0, s.shape[1])]:
            s[:, low:high] = best(s[:, low:high])
        i, j = np.nonzero(np.isfinite(s))
        return i, place[j], s[i, j]

    return q.groupBy("cell", "s", "g").cogroup(c.groupBy("cell", "s", "g")).applyInPandas(score, schema)


def dense_topk(queries: DataFrame, chunks: DataFrame, k: int, threshold: float = 0.35, part: str | None = None) -> DataFrame:
    """Cosine top-k of every query (query_id, vector) over ``chunks`` (chunk_id, vector), scores of at
    least ``threshold``, by a block join. With ``part`` the k best of each value of that column are kept."""
    one = F.lit(0).alias("cell")
    hits = block_hits(queries.select(one, "query_id", "vector"), chunks.select(one, "chunk_id", "vector", *[part] * bool(part)), k, threshold, part)
    return ranked(hits, k, *[part] * bool(part))


def _matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows."""
    wide = pc.unique(pc.list_value_length(vectors))
    if len(wide) > 1:
        raise ValueError(f"vectors of several lengths: {wide.to_pylist()}")
    return np.asarray(pc.list_flatten(vectors)).astype(np.float64).reshape(len(vectors), -1)


#: Numbers in the vectors of the queries that all tasks get at a time, chunks by which the driver finds first bounds, and tasks for each core.
ASKED_FLOATS, BOUND_CHUNKS, CORE_TASKS = 1 << 22, 1 << 14, 8
#: Queries and chunks in one product of ``Best``, hits of a query in it beyond which it is looked through once more, and
#: pairs whose exact scores are made at a time.
TILES, MANY, EXACT_PAIRS = (1024, 1024), 64, 1 << 16


class Best:
    """The ``k`` best values of each query, each value at its best chunk, ties to the smaller value.

    A query's bound is the score of its ``k``-th value so far. Products are of single precision; only where one comes
    to the bound less what rounding can amount to, the score is made in double precision. So the result is that of
    all pairs, and nearly all of them cost one product and one comparison. What is held does not grow with the chunks.
    """

    def __init__(self, queries: np.ndarray, k: int, threshold: float, bound: np.ndarray | None = None, tiles: tuple[int, int] = TILES):
        self.exact = _unit(queries)
        self.rough = self.exact.astype(np.float32)
        self.k, self.threshold, self.tiles = k, threshold, tiles
        self.bound = np.full(len(queries), threshold, np.float64) if bound is None else bound.copy()
        self.slack = (queries.shape[1] + 8) * 2.0**-23
        self.best = pd.DataFrame({"i": np.zeros(0, np.int64), "value": [], "score": np.zeros(0)})
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.pending = 0
        self.space = np.empty(tiles[0] * tiles[1], np.float32)

    def add(self, vectors: np.ndarray, values: np.ndarray) -> None:
        """Chunks, and the value of each."""
        many, wide = self.tiles
        vectors = _unit(vectors)
        some = np.isfinite(vectors).all(axis=1)
        vectors, values = (vectors, values) if some.all() else (vectors[some], values[some])
        for at in range(0, len(vectors), wide):
            of = pd.factorize(values[at : at + wide], use_na_sentinel=False)[0]
            order = np.argsort(of, kind="stable")
            c, of, own = vectors[at : at + wide][order], of[order], values[at : at + wide][order]
            firsts, columns = np.flatnonzero(np.diff(of, prepend=-1)), c.astype(np.float32).T
            for first in range(0, len(self.exact), many):
                rough = self.rough[first : first + many]
                s = np.matmul(rough, columns, out=self.space[: len(rough) * len(c)].reshape(len(rough), len(c)))
                low = (self.bound[first : first + many] - self.slack).astype(np.float32)
                rows = np.flatnonzero(s.max(axis=1) >= low)
                if not len(rows):
                    continue
                s = s[rows]
                hit = s >= low[rows, None]
                if np.count_nonzero(hit) > MANY * len(rows):
                    hit &= s >= self._least(np.where(hit, s, -np.inf), firsts)[:, None]
                i, j = np.divmod(np.flatnonzero(hit), len(c))
                self._hits(first + rows[i], c, j, own)

    def _least(self, s: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """The ``k``-th score of the values of a product, less what rounding can amount to."""
        s = np.maximum.reduceat(s, firsts, axis=1)
        return np.partition(s, -self.k, axis=1)[:, -self.k] - np.float32(2 * self.slack) if s.shape[1] > self.k else np.full(len(s), -np.inf, np.float32)

    def _hits(self, i: np.ndarray, c: np.ndarray, j: np.ndarray, values: np.ndarray) -> None:
        for at in range(0, len(i), EXACT_PAIRS):
            x, y = i[at : at + EXACT_PAIRS], j[at : at + EXACT_PAIRS]
            score = np.einsum("ij,ij->i", self.exact[x], c[y])
            keep = score >= self.threshold
            self.found.append((x[keep], values[y[keep]], score[keep]))
            self.pending += int(keep.sum())
        if self.pending > max(1 << 18, 4 * self.k * len(self.exact)):
            self.settled()

    def settled(self) -> pd.DataFrame:
        """(i, value, score) of the best so far, by which the bounds are raised."""
        if self.pending:
            i, value, score = (np.concatenate(x) for x in zip(*self.found, strict=True))
            h = pd.DataFrame({"i": i, "value": value, "score": score})
            h = pd.concat([self.best, h]) if len(self.best) else h
            h = h.sort_values(["i", "score", "value"], ascending=[True, False, True], na_position="first").drop_duplicates(["i", "value"])
            place = h.groupby("i").cumcount().to_numpy()
            last = place == self.k - 1
            self.bound[h["i"].to_numpy()[last]] = h["score"].to_numpy()[last]
            self.best, self.found, self.pending = h[place < self.k], [], 0
        return self.best


def dense_topk_of(queries: DataFrame, chunks: DataFrame, k: int, per: str, threshold: float = -1.0) -> DataFrame:
    """The ``k`` best values of column ``per`` (query_id, ``per``, score, rank) for every query, each value at its best
    chunk, ties to the smaller value: as many as there are, however many chunks one of them has.

    Chunks, best a stored table, are read where they lie, once for each ASKED_FLOATS numbers in the vectors of queries;
    those are sent to all tasks, with bounds that BOUND_CHUNKS chunks have given, and a task hands on its best alone.
    """
    spark = queries.sparkSession
    some = lambda df: df.where(F.col("vector").isNotNull() & (F.size("vector") > 0))
    asked, held = written(some(queries).select("query_id", "vector"), "asked"), some(chunks).select(per, "vector")
    n, wide = asked.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    parts = max(1, -(-n * (wide or 1) // ASKED_FLOATS))
    kinds = f"query_id {asked.schema['query_id'].dataType.simpleString()}, {per} {held.schema[per].dataType.simpleString()}, score double"
    early, tiles, lots = held.limit(BOUND_CHUNKS).toArrow(), TILES, 1 << 16
    column = lambda c: c.to_pandas(integer_object_nulls=True).to_numpy()

    def of(part: DataFrame) -> DataFrame | None:
        table = part.toArrow()
        if not len(table):
            return None
        first = Best(_matrix(table["vector"]), k, threshold, tiles=tiles)
        if len(early):
            first.add(_matrix(early["vector"]), column(early[per]))
            first.settled()
        names = pa.schema([("query_id", table.schema.field("query_id").type), (per, early.schema.field(per).type), ("score", pa.float64())])
        sent = spark.sparkContext.broadcast((table["query_id"].combine_chunks(), _matrix(table["vector"]), first.bound))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, vectors, bound = sent.value
            best = Best(vectors, k, threshold, bound, tiles)
            for b in batches:
                if len(b):
                    best.add(_matrix(b.column("vector")), column(b.column(per)))
            h = best.settled()
            for at in range(0, len(h), lots):
                x = h.iloc[at : at + lots]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(x["i"].to_numpy())), pa.array(x["value"].to_list(), names.field(per).type), pa.array(x["score"].to_numpy())], schema=names)

        return held.coalesce(CORE_TASKS * spark.sparkContext.defaultParallelism).mapInArrow(run, kinds)

    dealt = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)))
    found = [h for i in range(parts) if (h := of(dealt.where(F.col("part") == i).drop("part"))) is not None]
    hits = found[0] if found else spark.createDataFrame([], kinds)
    for h in found[1:]:
        hits = hits.unionAll(h)
    best = hits.groupBy("query_id", per).agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), per)
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def postings(chunks: DataFrame, text: str = "text") -> DataFrame:
    """(chunk_id, term, tf, length) of every term of every chunk."""
    t = terms(F.col(text))
    each = chunks.select("chunk_id", t.alias("t")).select("chunk_id", F.size("t").alias("length"), F.explode("t").alias("term"))
    return each.groupBy("chunk_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))


#: Different terms that a set of queries may ask for at a time: they and their weights are sent to all tasks.
ASKED_TERMS = 1 << 20
#: Chunks whose scores for a block of queries stand in memory at a time.
SCORED_CHUNKS = 2048


def sparse_topk(queries: DataFrame, chunks: DataFrame, k: int, text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Okapi BM25 top-k of queries (query_id, text) over ``chunks`` (chunk_id, text).

    The terms of every chunk are found once, counted inside the row and stored, those only that some query asks for; their
    document frequencies are summed from that table. Then each block of chunks is scored against each block of queries
    where it lies, and only the ``k`` best of a block (and those equal to the last of them) are moved. Queries that ask
    for more than ASKED_TERMS terms together are dealt into parts.
    """
    spark = queries.sparkSession
    asked = written(queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")), "asked")
    parts = -(-asked.select("term").distinct().count() // ASKED_TERMS)
    if parts <= 1:
        return ranked(_sparse_hits(spark, asked, chunks, k, text, k1, b), k)
    # All terms of a query in one part: a part may ask for some more terms than it should, by those of its queries.
    dealt = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(2 * parts)))
    found = [_sparse_hits(spark, dealt.where(F.col("part") == i).drop("part"), chunks, k, text, k1, b) for i in range(2 * parts)]
    whole = found[0]
    for f in found[1:]:
        whole = whole.unionByName(f)
    return ranked(whole, k)


def _sparse_hits(spark, asked: DataFrame, chunks: DataFrame, k: int, text: str, k1: float, b: float) -> DataFrame:
    table = asked.toArrow()
    vocabulary = pc.unique(table["term"])
    names = pc.unique(table["query_id"])
    number, which = (pc.index_in(table[c], value_set=v).to_numpy() for c, v in (("term", vocabulary), ("query_id", names)))
    known = spark.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1, BATCH_ITEMS):
            lists = batch.column(1)
            # A null text has no length, and no terms.
            sizes = np.diff(lists.offsets.to_numpy()) * np.asarray(lists.is_valid())
            flat = pc.index_in(lists.flatten(), value_set=known.value)
            row = np.repeat(np.arange(batch.num_rows), sizes)
            hit = np.asarray(flat.is_valid())
            pair, tf = np.unique(row[hit] * len(known.value) + flat.filter(flat.is_valid()).to_numpy().astype(np.int64), return_counts=True)
            ends = np.concatenate([[0], np.cumsum(np.bincount(pair // len(known.value), minlength=batch.num_rows))]).astype(np.int32)
            made = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (pair % len(known.value), tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64(), mask=~np.asarray(lists.is_valid())), *made], names=["chunk_id", "length", "terms", "tfs"])

    kind = chunks.schema["chunk_id"].dataType.simpleString()
    found = chunks.select("chunk_id", terms(F.col(text)).alias("t")) if len(vocabulary) else chunks.select("chunk_id", F.lit(None).cast("array<string>").alias("t"))
    held = written(found.mapInArrow(count, f"chunk_id {kind}, length long, terms array<int>, tfs array<int>"), "term-counts")
    n, avgdl = held.agg(F.count(F.lit(1)), F.avg("length")).first()
    frequency = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toArrow()
    df = np.zeros(len(vocabulary))
    df[frequency["term"].to_numpy()] = frequency["df"].to_numpy()
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    # For each term the queries that ask for it.
    order = np.argsort(number, kind="stable")
    weights = spark.sparkContext.broadcast((idf, which[order], np.searchsorted(number[order], np.arange(len(vocabulary) + 1)), names))
    query_kind = asked.schema["query_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, askers, first, names = weights.value
        for whole in batches:
            for at in range(0, whole.num_rows, SCORED_CHUNKS):
                batch = whole.slice(at, SCORED_CHUNKS)
                sizes = np.diff(batch.column(2).offsets.to_numpy())
                row = np.repeat(np.arange(batch.num_rows), sizes)
                term, tf = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in (2, 3))
                length = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)[row]
                weight = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / (avgdl or 1.0)))
                by_term = np.argsort(term, kind="stable")
                row, term, weight = row[by_term], term[by_term], weight[by_term]
                edges = np.flatnonzero(np.diff(term, prepend=-1))
                for block in range(0, len(names), QUERY_BLOCK):
                    scores = np.zeros((min(QUERY_BLOCK, len(names) - block), batch.num_rows))
                    for e, end in zip(edges.tolist(), [*edges[1:].tolist(), len(term)], strict=True):
                        qs = askers[first[term[e]] : first[term[e] + 1]] - block
                        qs = qs[(qs >= 0) & (qs < len(scores))]
                        if len(qs):
                            scores[qs[:, None], row[e:end]] += weight[e:end]
                    scores = np.round(scores, 9)
                    if scores.shape[1] > k:
                        last = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
                        scores[scores < last[:, None]] = 0
                    q, c = np.nonzero(scores)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(q + block)), batch.column(0).take(pa.array(c)), pa.array(scores[q, c])], names=["query_id", "chunk_id", "score"])

    return held.where(F.size("terms") > 0).mapInArrow(score, f"query_id {query_kind}, chunk_id {kind}, score double")


def rrf_fuse(dense: DataFrame, sparse: DataFrame, k: int, w_dense: float = 0.7, w_sparse: float = 0.3, constant: int = 60) -> DataFrame:
    """Weighted reciprocal rank fusion of two hit lists."""
    part = lambda df, w: df.select("query_id", "chunk_id", (F.lit(w) / (constant + F.col("rank"))).alias("score"))
    both = part(dense, w_dense).unionByName(part(sparse, w_sparse)).groupBy("query_id", "chunk_id").agg(F.sum("score").alias("score"))
    return ranked(both, k).withColumn("fusion", F.lit("rrf"))


def hybrid(queries: DataFrame, chunks: DataFrame, k: int, w_dense: float = 0.7, w_sparse: float = 0.3, threshold: float = 0.35) -> DataFrame:
    """Both searches over-fetch min(4k, 50), are fused and cut to ``k``; queries and chunks have text and vector."""
    more = min(4 * k, 50)
    return rrf_fuse(dense_topk(queries, chunks, more, threshold), sparse_topk(queries, chunks, more), k, w_dense, w_sparse)


@dataclass(frozen=True)
class SearchOptions:
    """What a search is asked for. collections: names to search and merge; empty for one list."""

    k: int = 5
    threshold: float = 0.35
    hybrid: bool = False
    rerank: bool = False
    collections: tuple[str, ...] = ()
    filters: dict = field(default_factory=dict)


def search(queries: DataFrame, chunks: DataFrame, options: SearchOptions, scorer: Callable[[str, str], float] | None = None) -> tuple[DataFrame, DataFrame]:
    """Hits (query_id, chunk_id, score, rank) and one log row (query_id, path, result_count,
    max_score) for every query, those without a hit included.

    Several collections are searched densely and merged by rank; else the search is hybrid or
    dense as asked, and reranked if asked. Unknown collections are an error. queries and chunks
    have vector, and text where the path needs it.
    """
    found = matching(chunks, **options.filters)
    if options.collections:
        unknown = sorted(set(options.collections) - {r[0] for r in chunks.where(F.col("collection").isin(*options.collections)).select("collection").distinct().collect()})
        if unknown:
            raise ValueError(f"unknown collections: {', '.join(unknown)}")
        path, found = "multi", found.where(F.col("collection").isin(*options.collections))
        hits = merge_collections(dense_topk(queries, found, options.k, options.threshold, part="collection"), options.k)
    else:
        path = "hybrid" if options.hybrid else "dense"
        more = min(4 * options.k, 50) if options.rerank else options.k
        hits = hybrid(queries, found, more, threshold=options.threshold) if options.hybrid else dense_topk(queries, found, more, options.threshold)
        if options.rerank:
            path += "+rerank"
            texts = hits.select("query_id", "chunk_id", "rank", "score").join(found.select("chunk_id", "text"), "chunk_id").join(queries.select("query_id", F.col("text").alias("query_text")), "query_id")
            hits = rerank(texts, options.k, scorer or overlap_scorer)
    hits = hits.select("query_id", "chunk_id", "score", "rank")
    counts = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("result_count"), F.max("score").alias("max_score"))
    log = queries.select("query_id").join(counts, "query_id", "left")
    return hits, log.select("query_id", F.lit(path).alias("path"), F.coalesce("result_count", F.lit(0)).alias("result_count"), "max_score")


def min_max(hits: DataFrame, *parts: str) -> DataFrame:
    """Scores of each list brought to 0..1; 1 where all are alike."""
    w = Window.partitionBy("query_id", *parts)
    low, span = F.min("score").over(w), F.max("score").over(w) - F.min("score").over(w)
    return hits.withColumn("score", F.when(span < 1e-9, 1.0).otherwise((F.col("score") - low) / span))


def merge_collections(hits: DataFrame, k: int, constant: int = 60) -> DataFrame:
    """One list of each query from ranked lists of several collections: sums of 1 / (60 + rank)."""
    return ranked(hits.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 12).alias("score")), k)


def unknown_collections(wanted: DataFrame, chunks: DataFrame) -> DataFrame:
    return wanted.join(chunks.select("collection").distinct(), "collection", "left_anti")


def overlap_scorer(query: str, text: str) -> float:
    """F1 of the two sets of words: a stand-in for a cross-encoder."""
    a, b = set(query.lower().split()), set(text.lower().split())
    both = len(a & b)
    return 2 * both / (len(a) + len(b)) if both else 0.0


#: Pairs that a scorer gets at a time: one that it fails on spoils no more than these.
SCORER_BATCH = 20


def scored(hits: DataFrame, scorer: Callable[[str, str], float] = overlap_scorer, batch: int = SCORER_BATCH) -> DataFrame:
    """``hits`` with again, the scorer's value for query_text and text, and outcome: ``ok``, or what it raised. Pairs go to it
    in batches; those of a batch in which it raises have no value."""
    @F.pandas_udf("again double, outcome string")
    def run(q: pd.Series, t: pd.Series) -> pd.DataFrame:
        out: list[tuple[float | None, str]] = []
        pairs = [(a or "", b or "") for a, b in zip(q, t, strict=True)]
        for at in range(0, len(pairs), batch):
            part = pairs[at : at + batch]
            try:
                out += [(float(scorer(a, b)), "ok") for a, b in part]
            except Exception as e:  # a model's own failures
                out = out[:at] + [(None, f"{type(e).__name__}: {e}"[:200])] * len(part)
        return pd.DataFrame(out, columns=["again", "outcome"])

    return hits.withColumn("__s", run("query_text", "text")).select(*hits.columns, "__s.again", "__s.outcome")


def rerank(hits: DataFrame, k: int, scorer: Callable[[str, str], float] = overlap_scorer, batch: int = SCORER_BATCH) -> DataFrame:
    """The first ``k`` of each query by a scorer of query_text and text: query_id, chunk_id, score, rank and outcome.

    A query's hits go to the scorer together, in batches in their old order (rank if there is one, else chunk_id). If it
    raises on one of them, that query keeps the first ``k`` of its old order with their old scores, its outcome says why,
    and no other query is touched.
    """
    old = [F.col(c) if c in hits.columns else F.lit(None).cast(t).alias(c) for c, t in (("rank", "long"), ("score", "double"))]
    kind = lambda c: hits.schema[c].dataType.simpleString()
    schema = f"query_id {kind('query_id')}, chunk_id {kind('chunk_id')}, score double, rank int, outcome string"

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["rank", "chunk_id"])
        outcome, again = "ok", []
        pairs = [(a or "", b or "") for a, b in zip(f["query_text"], f["text"], strict=True)]
        try:
            for at in range(0, len(pairs), batch):
                again += [float(scorer(a, b)) for a, b in pairs[at : at + batch]]
            f = f.assign(score=again).sort_values(["score", "chunk_id"], ascending=[False, True])
        except Exception as e:  # a model's own failures
            outcome = f"{type(e).__name__}: {e}"[:200]
        f = f.head(k)
        return pd.DataFrame({"query_id": f["query_id"], "chunk_id": f["chunk_id"], "score": f["score"].astype(float), "rank": np.arange(1, len(f) + 1), "outcome": outcome})

    # A group is one query's hits, which searches bound.
    return hits.select("query_id", "chunk_id", *old, "query_text", "text").groupBy("query_id").applyInPandas(run, schema)


def context(chunks: DataFrame, targets: DataFrame, width: int) -> DataFrame:
    """Each target chunk (document, chunk_index) and its neighbours up to ``width`` on either side."""
    near = targets.select("document", F.col("chunk_index").alias("target"), F.explode(F.sequence(F.col("chunk_index") - width, F.col("chunk_index") + width)).alias("chunk_index"))
    return chunks.join(near, ["document", "chunk_index"])


def value_counts(chunks: DataFrame, field: str, n: int) -> DataFrame:
    """Values of a field that are not blank, most frequent first."""
    some = chunks.where(F.trim(F.coalesce(F.col(field), F.lit(""))) != "")
    return some.groupBy(F.col(field).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(n)


def filter_terms(chunks: DataFrame, fields: Sequence[str], most: int) -> DataFrame:
    """One line of each field: its values with counts, and how many more there are."""
    each = chunks.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("p")).select("p.*")
    counts = each.where(F.trim(F.coalesce("value", F.lit(""))) != "").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    r = counts.withColumn("r", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "value")))
    shown = F.collect_list(F.when(F.col("r") <= most, F.struct("r", F.concat("value", F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("t"))))
    g = r.groupBy("field").agg(F.array_sort(shown).alias("s"), F.count(F.lit(1)).alias("all"))
    line = F.array_join(F.transform("s", lambda x: x["t"]), ", ")
    return g.select("field", F.when(F.col("all") > most, F.concat(line, F.lit(" (+"), (F.col("all") - most).cast("string"), F.lit(" more)"))).otherwise(line).alias("line"))


def request_key(*parts: Column) -> Column:
    """Hash of a request's inputs."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"), 256)


def highlight(text: Column, word: str) -> Column:
    """HTML-escaped text with each occurrence of ``word`` marked, whatever its case."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    quoted = "".join("\\" + c if not c.isalnum() else c for c in word)
    return F.regexp_replace(text, f"(?i)({quoted})", "<mark>$1</mark>") if word else text


def assemble_prompts(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, prompt): the question and its chunks in order of rank."""
    block = F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "text"))), lambda x: F.concat(F.lit("["), x["chunk_id"].cast("string"), F.lit("] "), x["text"]))
    found = hits.groupBy("query_id").agg(F.array_join(block, "\n").alias("chunks"))
    both = questions.join(found, "query_id", "left")
    return both.select("query_id", F.concat(F.lit("Answer from these passages only.\n\n"), F.coalesce("chunks", F.lit("")), F.lit("\n\nQuestion: "), "text").alias("prompt"))


def l2_normalised(vector: Column) -> Column:
    n = norm(vector)
    return F.transform(vector, lambda x: F.try_divide(x.cast("double"), n))


# Fixed formats: the patterns of ``parse_report`` are those in which such reports are printed.


def parse_report(report: Column) -> Column:
    """Hits in a markdown report as an array of structs: source_file, score, chunk_id, product, text."""
    field = lambda s, p: F.trim(F.regexp_extract(s, p, 1))
    head = r"^(.+?)\s+\(relevance:\s+([\d.]+)%\)"
    one = lambda s: F.struct(
        F.coalesce(F.nullif(F.regexp_extract(s, head, 1), F.lit("")), F.substring_index(s, "\n", 1)).alias("source_file"),
        F.coalesce(F.nullif(F.regexp_extract(s, head, 2), F.lit("")).cast("double") / 100, F.lit(0.0)).alias("score"),
        field(s, r"(?m)^\*\*ID:\*\*.*?`([^`]+)`").alias("chunk_id"), field(s, r"(?m)^\*\*Product:\*\*(.*)$").alias("product"),
        F.coalesce(F.get(F.split(s, "\n\n"), F.lit(1)), F.lit("")).alias("text"),
    )
    sections = F.split(report, r"\n###\s*\[\d+\]\s+")
    return F.transform(F.slice(sections, 2, F.greatest(F.size(sections) - 1, F.lit(0))), lambda s: one(F.trim(s)))
