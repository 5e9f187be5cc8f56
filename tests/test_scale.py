"""What must not grow faster than the input, on small tables."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpuslake.operators import chunks, embedding, experiments, retrieval
from corpuslake.sources import batches, extract


def test_expected_by_label_is_not_written_out_as_pairs(spark):
    """Labels give the metrics that their pairs give, and are looked up for hits only."""
    chunks = spark.createDataFrame([(i, i % 3 if i % 7 else None) for i in range(60)], "chunk_id long, label int")
    asked = spark.createDataFrame([(0, 0), (1, 1), (4, 1), (5, 2), (7, None), (99, 2), (98, 9)], "query_id long, label int")
    hits = [(v, q, (q * 5 + 3 * r * (v == "a") + r) % 60, r) for v in "ab" for q in (0, 1, 4, 7, 99) for r in range(1, 7)]
    hits = spark.createDataFrame(hits, "variant string, query_id long, chunk_id long, rank int")
    names = spark.createDataFrame([("a",), ("b",), ("none",)], "variant string")
    pairs = asked.join(chunks, "label").where("query_id <> chunk_id").select("query_id", "chunk_id")
    labels = experiments.SameLabel(asked, chunks)
    rows = lambda e: sorted(map(tuple, experiments.metrics_of(hits, e, 5, names).collect()))
    assert rows(labels) == rows(pairs) and rows(labels)[-1] == ("none", 0.0, 0.0, 0.0)
    assert {tuple(r) for r in labels.counts().collect()} == {tuple(r) for r in experiments.Pairs(pairs).counts().collect()}


def test_batches_are_bounded_by_bytes():
    """A batch of few large texts, or files with many sections, is not held whole as Python objects."""
    texts = ["x" * 10, None, "y" * 90, "z" * 500, "", "w" * 40, "v" * 40]
    b = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], names=["i", "t"])
    parts = list(batches.bounded([b, b.slice(2, 3)], 1, 100))
    assert [p.num_rows for p in parts] == [3, 1, 3, 1, 1, 1] and [t for p in parts for t in p["t"].to_pylist()] == texts + texts[2:5]
    assert list(batches.cuts(pa.array([[1, 2], None, [3, 4], [5]]), 3)) == [(0, 2), (2, 4)]
    schema = pa.schema([("i", pa.int32()), ("t", pa.string())])
    rows = [(i, t) for i, t in enumerate(texts) if t]
    out = list(batches.gathered(iter(rows), schema, lambda r: len(r[1]), 100))
    assert [r for p in out for r in zip(*(c.to_pylist() for c in p.columns))] == rows and [p.num_rows for p in out] == [2, 1, 2]
    assert list(batches.gathered(iter([]), schema, len)) == []


def test_sections_of_files_in_lots(spark, monkeypatch):
    """Files and sections come out whole and in order when a task holds very little at a time."""
    monkeypatch.setattr(batches.bounded, "__defaults__", (64,))
    monkeypatch.setattr(batches.gathered, "__defaults__", (64,))
    files = [(f"{i}.txt", ("line\n" * i).encode()) for i in range(60)] + [("a.txt", None), ("b.exe", b"x")]
    df = spark.createDataFrame(files, "path string, content binary").coalesce(1)
    got = {r.path: r.text for r in extract.extract_sections(df).collect()}
    assert got == {p: (c or b"").decode() for p, c in files if p != "b.exe"}


def test_vectors_and_chunks_keep_their_rows(spark, monkeypatch):
    """Vectors and chunks that are handed on in lots within a batch stand beside their own texts; a task gets few texts at a time."""
    def provider(texts):
        if any(t == "bad" for t in texts):
            raise ValueError("no")
        return np.array([[float(len(t or ""))] for t in texts])

    monkeypatch.setattr(embedding, "HANDED_ON", 8)
    df = spark.createDataFrame([(i, "bad" if i == 50 else None if i % 9 == 0 else "x" * i) for i in range(90)], "i int, text string").coalesce(1)
    for r in embedding.embed(df, "text", provider, batch=4).collect():
        assert (r.vector is None and r.error == "no") if 48 <= r.i < 52 else r.vector == [float(len(r.text or ""))]
    monkeypatch.setattr(chunks, "BATCH_BYTES", 200)
    made = chunks.chunk_with(df, chunks.create_strategy("fixed", chunk_size=40, overlap=5)).groupBy("i").agg(F.count(F.lit(1)).alias("n")).collect()
    want = {r.i: len([c for c in chunks.create_strategy("fixed", chunk_size=40, overlap=5)(r.text or "", "txt") if len(c) >= 30]) for r in df.collect()}
    assert {r.i: r.n for r in made} == {i: n for i, n in want.items() if n}


def test_terms_are_counted_in_lots(spark, monkeypatch):
    """Sparse scores are the same when a task counts few terms at a time."""
    texts = [(i, " ".join(f"word{(i * j) % 11}" for j in range(1, i % 17))) for i in range(80)]
    held = spark.createDataFrame([*texts, (99, None)], "chunk_id long, text string").coalesce(1)
    asked = spark.createDataFrame([(1, "word1 word7"), (2, "word3"), (3, "none")], "query_id long, text string")
    rows = lambda: sorted(map(tuple, retrieval.sparse_topk(asked, held, 6).collect()))
    whole = rows()
    monkeypatch.setattr(retrieval, "BATCH_ITEMS", 12)
    assert rows() == whole and len(whole) == 12


def test_blocks_hand_on_the_best_of_each_part(spark, monkeypatch):
    """Of many chunks above the threshold a task hands on few, whatever the tiles; the result is that of all pairs."""
    rng = np.random.default_rng(8)
    v = rng.normal(size=(400, 6)) + 2
    held = spark.createDataFrame([(i, x.tolist(), f"p{i % 3}" if i % 13 else None, i // 7) for i, x in enumerate(v)], "chunk_id long, vector array<double>, part string, doc int")
    asked = held.where("chunk_id < 40").withColumnRenamed("chunk_id", "query_id")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u[:40] @ u.T
    part = lambda i: f"p{i % 3}" if i % 13 else None
    want = {(q, c) for q in range(40) for p in ("p0", "p1", "p2", None) for c in sorted((i for i in range(400) if part(i) == p), key=lambda i: -s[q, i])[:4]}
    docs = {(q, d) for q in range(40) for d in np.argsort([-max(s[q, i] for i in range(400) if i // 7 == d) for d in range(58)], kind="stable")[:4].tolist()}
    for tiles in ((512, 8192, 64), (7, 50, 1)):
        for name, n in zip(("QUERY_BLOCK", "CHUNK_BLOCK", "LEAST_TASKS"), tiles):
            monkeypatch.setattr(retrieval, name, n)
        one = F.lit(0).alias("cell")
        hits = retrieval.block_hits(asked.select(one, "query_id", "vector"), held.select(one, "chunk_id", "vector", "part"), 4, -1.0, "part")
        assert hits.count() <= 40 * 4 * 4
        assert {(r.query_id, r.chunk_id) for r in retrieval.dense_topk(asked, held, 4, -1.0, "part").collect()} == want
        assert {(r.query_id, r.doc) for r in retrieval.dense_topk_of(asked, held, 4, "doc").collect()} == docs


def test_best_values_are_those_of_all_pairs(spark, monkeypatch):
    """Bounds and single precision leave nothing out: copies tie to the smaller value, vectors without a direction have no
    score, queries come in several parts; a task hands on its best alone, and chunks are not shuffled."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(600, 6)) + 1
    v[100:160] = v[7]  # exact copies, in many values
    v[20] = 0
    doc = rng.permutation(600) // 4
    q = np.vstack([v[:30], v[:30] * 3])
    u = v / np.maximum(1e-300, np.linalg.norm(v, axis=1, keepdims=True))
    held = spark.createDataFrame([(i, v[i].tolist(), int(doc[i])) for i in range(600)] + [(600, None, 1), (601, [], 2), (602, [float("nan")] * 6, 3)], "chunk_id long, vector array<double>, doc int").repartition(3)
    asked = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id long, vector array<double>")
    want = {}
    for i in range(60):
        each = {}
        for j in range(600):
            if i % 30 != 20 and j != 20:
                each[doc[j]] = max(each.get(doc[j], -2), round(float(u[i % 30] @ u[j]), 9))
        want[i] = sorted(each, key=lambda d: (-each[d], d))[:7]
    for tiles, floats, first in (((1024, 1024), 1 << 22, 1 << 14), ((7, 50), 100, 10), ((1, 3), 1, 1)):
        for name, n in (("TILES", tiles), ("ASKED_FLOATS", max(60, floats)), ("BOUND_CHUNKS", first), ("CORE_TASKS", 1), ("MANY", 2)):
            monkeypatch.setattr(retrieval, name, n)
        found = retrieval.dense_topk_of(asked, held, 7, "doc")
        got = {}
        for r in found.withColumn("s", F.round("score", 9)).collect():
            got.setdefault(r.query_id, []).append((-r.s, r.doc))
        assert {i: [d for _, d in sorted(x)] for i, x in got.items()} == {i: w for i, w in want.items() if i % 30 != 20}
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "FlatMapCoGroups" not in plan and "Join" not in plan


def test_few_pairs_get_exact_scores(monkeypatch):
    """With bounds nearly all pairs cost a comparison, and what is held stays small."""
    rng = np.random.default_rng(6)
    v, q = rng.normal(size=(20000, 16)), rng.normal(size=(50, 16))
    best, pairs = retrieval.Best(q, 5, -1.0, tiles=(64, 256)), []
    hits = best._hits
    best._hits = lambda i, c, j, values: (pairs.append(len(i)), hits(i, c, j, values))
    for at in range(0, 20000, 1000):
        best.add(v[at : at + 1000], np.arange(at, at + 1000) // 3)
        best.settled()
    h = best.settled()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ u.T
    top = np.maximum.reduceat(s, np.arange(0, 20000, 3), axis=1)
    assert {(r.i, r.value) for r in h.itertuples()} == {(i, d) for i in range(50) for d in np.argsort(-top[i])[:5].tolist()}
    assert sum(pairs) < 50 * 20000 / 20 and len(h) == 250


def test_hashed_words(monkeypatch):
    """The vectors are those of one word after another."""
    import zlib

    texts = ["One two  two\tTHREE\n", None, "", " ", "Stra\u00dfe \u0130x \u039f\u03a3 a\u00a0b\u2003c\x1cd \u00e9", "x" * 500 + " y", "\U0001f600 z\x85w"]
    want = np.zeros((len(texts), 64))
    for i, t in enumerate(texts):
        for w in (t or "").lower().split():
            h = zlib.crc32(w.encode())
            want[i, h % 64] += 1 if h & 0x80000000 else -1
    want /= np.maximum(1e-12, np.linalg.norm(want, axis=1, keepdims=True))
    assert np.array_equal(embedding.hash_provider(texts), want) and embedding.hash_provider([]).shape == (0, 64)
