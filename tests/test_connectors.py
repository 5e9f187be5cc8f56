import json

import pytest

from corpuslake.operators import chunks, embedding, evaluation, ingest, retrieval
from corpuslake.sources import connectors, extract, loaders


def test_document_trees():
    text = lambda t, *marks: {"type": "text", "text": t, "marks": list(marks)}
    tree = {"type": "doc", "content": [
        {"type": "paragraph", "content": [text("see "), text("here", {"type": "link", "attrs": {"href": "u"}}), text("x", {"type": "code"}, {"type": "strong"}), {"type": "hardBreak"}, text("new")]},
        {"type": "bulletList", "content": [{"type": "listItem", "content": [{"type": "paragraph", "content": [text("a")]}]}, {"type": "listItem"}]},
        {"type": "orderedList", "content": [{"type": "listItem", "content": [text("b")]}]},
        {"type": "codeBlock", "content": [text("f()")]},
        {"type": "table", "content": [{"type": "tableRow", "content": [{"type": "tableHeader", "content": [text("h")]}, {"type": "tableCell", "content": [text("c", {"type": "strike"})]}]}]},
        {"type": "panel", "content": [text("in", {"type": "em"})]}, {"type": "rule"}, text("  "),
    ]}
    assert connectors.tree_text(json.dumps(tree)).split("\n") == ["see [here](u)**`x`**", "new", "- a", "-", "1. b", "```", "f()", "```", "h | ~~c~~ | *in*"]
    assert [connectors.tree_text(t) for t in (None, "", "no json", "[1]", "{}")] == [""] * 5


def test_remote_documents(spark):
    rows = [('{"id": "7", "version": {"when": "2024-01-02T00:00:00Z"}, "body": {"storage": {"value": "<p>a</p>"}}}',), ("nonsense",), (None,), ('{"id": "8", "version": {"when": "soon"}, "_links": {"webui": "/p"}}',)]
    raw = spark.createDataFrame(rows, "value string")
    got = {r.remote_id: r for r in connectors.fetch_documents("wiki", raw, "w", "http://b").collect()}
    assert set(got) == {"7", "8"} and got["7"].content == "a" and got["7"].remote_url is None and got["7"].remote_mtime == 1704153600 and got["7"].title == "Untitled" and got["7"].metadata["version"] == "1"
    assert got["8"].remote_mtime is None and got["8"].remote_url == "http://b/p"
    later = connectors.fetch_documents("wiki", raw, "w", "http://b", since=1704153601).collect()
    assert [r.remote_id for r in later] == ["8"]
    issue = spark.createDataFrame([('{"key": "K-1", "fields": {"summary": "s", "updated": "2024-01-02T00:00:00.000+0100", "assignee": null, "labels": ["a", "b"], "description": null}}',), ('{"key": "K-2"}',)], "value string")
    got = {r.remote_id: r for r in connectors.fetch_documents("issues", issue, "i", "http://b").collect()}
    assert got["K-1"].metadata["labels"] == "a,b" and got["K-1"].remote_mtime == 1704150000 and got["K-1"].content == "" and got["K-2"].title == "Untitled" and got["K-2"].metadata["status"] == ""
    files = spark.createDataFrame([("a/b.MD", "x", "c", None), ("a/Dockerfile", "x", "c", None), ("z.go", None, "c", 5.0), ("n.exe", "x", "c", None)], "path string, content string, commit string, mtime double")
    assert sorted((r.remote_id, r.content_type) for r in connectors.fetch_documents("repo", files, "r", "b").collect()) == [("a/b.MD", "text/markdown"), ("z.go", "text/plain")]
    with pytest.raises(ValueError):
        connectors.fetch_documents("ftp", raw, "x", "b")
    connectors.register("same", lambda raw, key, base: connectors.remote_pages(raw, key, base))
    try:
        assert connectors.fetch_documents("same", raw, "x", "b").count() == 2
    finally:
        del connectors.CONNECTORS["same"]


def test_golden_files(spark, tmp_path):
    assert loaders.load_golden_json(spark, str(tmp_path / "none.json")).count() == 0
    golden = loaders.load_golden_json(spark, str(tmp_path / "none.json"))
    more = loaders.add_examples(golden, spark.createDataFrame([("q", "a")], "query string, expected_answer string"))
    loaders.save_golden(more, str(tmp_path / "g"))
    again = spark.read.schema(loaders.GOLDEN).json(str(tmp_path / "g")).collect()
    assert [(r["query"], r.expected_answer, r.expected_docs) for r in again] == [("q", "a", None)]


def test_properties_and_scan_order(spark, tmp_path):
    assert extract.properties_of("a.docx", b"broken") == ("", "", "", "") == extract.properties_of("a.pdf", None)
    for name in ("b.txt", "a.txt", "c.md"):
        (tmp_path / name).write_text(name)
    found = extract.scan_ordered(spark, str(tmp_path)).collect()
    assert [r.path.rpartition("/")[2] for r in found] == ["c.md", "a.txt", "b.txt"]
    assert extract.scan_ordered(spark, str(tmp_path / "a.txt")).count() == 1


def test_written_chunks_replace_their_collections(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(r, "chunk_id string, collection string, text string")
    path = str(tmp_path / "chunks")
    ingest.write_chunks(rows(("1", "a", "x"), ("2", "b", "y")), path)
    for _ in range(2):
        ingest.write_chunks(rows(("3", "a", "z")), path, files=2)
    assert sorted((r.chunk_id, r.collection) for r in spark.read.parquet(path).collect()) == [("2", "b"), ("3", "a")]


def test_strategies(spark):
    text = "one two three. " * 30 + "\n" + "four five " * 40
    docs = spark.createDataFrame([(1, text), (2, None), (3, "short")], "item long, text string")
    for name, options in (("overlap", {"chunk_size": 100, "overlap": 20}), ("recursive", {"chunk_size": 100}), ("semantic", {"max_tokens": 30})):
        split = chunks.create_strategy(name, **options)
        got = [r.chunk for r in chunks.chunk_with(docs, split).orderBy("pos").collect()]
        assert got == [c for c in split(text, "txt") if len(c.strip()) >= 30] and got
    want = chunks.chunk_semantic(docs.where("item = 1"), "item", 30).orderBy("pos").collect()
    assert [r.chunk for r in want] == chunks.split_semantic(text, 30)
    with pytest.raises(ValueError):
        chunks.create_strategy("magic")


def test_chunking_experiment_finds_its_documents(spark):
    import zlib

    # Words that the stand-in model keeps apart: one dimension each.
    words = list({zlib.crc32(f"w{i}".encode()) % embedding.DIM: f"w{i}" for i in range(40)}.values())[:12]
    docs = spark.createDataFrame([(i, (w + " ") * 60) for i, w in enumerate(words)], "item long, text string")
    queries = docs.selectExpr("item AS query_id", "substring(text, 1, 60) AS text")
    row = evaluation.chunking_experiment(docs, queries, queries.selectExpr("query_id", "query_id AS item"), "fixed", 3, chunk_size=150).first()
    count = sum(len([c for c in chunks.create_strategy("fixed", chunk_size=150)(r.text, "txt") if len(c.strip()) >= 30]) for r in docs.collect())
    assert row.chunk_count == count and (row.recall, row.mrr, row.ndcg) == (1.0, 1.0, 1.0)


def test_embedding_adds_up(spark):
    import zlib

    got = embedding.embed(spark.createDataFrame([("b a b",), (None,)], "text string"), "text").collect()
    want = [0.0] * embedding.DIM
    for w in (b"b", b"a", b"b"):
        want[zlib.crc32(w) % embedding.DIM] += 1 if zlib.crc32(w) & 0x80000000 else -1
    size = sum(x * x for x in want) ** 0.5
    assert max(abs(x / size - y) for x, y in zip(want, got[0].vector)) < 1e-6 and not any(got[1].vector)


def test_search_paths(spark):
    vec = lambda i: [1.0, i / 10, (i % 3) / 5]
    c = spark.createDataFrame([(i, vec(i), f"word{i} common text", f"kb{i % 2}") for i in range(20)], "chunk_id long, vector array<double>, text string, collection string")
    q = spark.createDataFrame([(1, vec(4), "word4 common"), (2, None, "nothing here")], "query_id long, vector array<double>, text string")
    for options, path in (({}, "dense"), ({"hybrid": True}, "hybrid"), ({"rerank": True}, "dense+rerank"), ({"hybrid": True, "rerank": True}, "hybrid+rerank"), ({"collections": ("kb0", "kb1"), "rerank": True}, "multi")):
        hits, log = retrieval.search(q, c, retrieval.SearchOptions(k=3, **options))
        rows = log.orderBy("query_id").collect()
        assert [r.path for r in rows] == [path] * 2 and rows[0].result_count == 3 and rows[1].result_count == 0
        assert hits.where("query_id = 1").count() == 3
        if "hybrid" in path or "rerank" in path:
            assert hits.where("rank = 1").first().chunk_id == 4
    with pytest.raises(ValueError):
        retrieval.search(q, c, retrieval.SearchOptions(collections=("kb9",)))


def test_ann_recall(spark):
    """At least 0.9 of the ten nearest, on vectors with and without clusters, many queries and groups."""
    import numpy as np

    rng = np.random.default_rng(3)
    flat = rng.normal(size=(1500, 24))
    near = rng.normal(size=(30, 24))[rng.integers(0, 30, 1500)] + rng.normal(size=(1500, 24)) * 0.3
    for v in (flat, near):
        c = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(9999, None)], "chunk_id long, vector array<double>")
        q = c.where("chunk_id % 30 = 0").withColumnRenamed("chunk_id", "query_id")
        got = {(r.query_id, r.chunk_id) for r in embedding.ann_topk(q, c, 10).collect()}
        u = v / np.linalg.norm(v, axis=1, keepdims=True)
        want = {(i, int(j)) for i in range(0, 1500, 30) for j in np.argsort(-(u @ u[i]), kind="stable")[:10]}
        assert len(got & want) >= 0.9 * len(want)
    retrieval.QUERY_BLOCK, retrieval.CHUNK_BLOCK, kept = 7, 100, (retrieval.QUERY_BLOCK, retrieval.CHUNK_BLOCK)
    try:
        exact = {(r.query_id, r.chunk_id) for r in retrieval.dense_topk(q, c, 10, -1.0).collect()}
    finally:
        retrieval.QUERY_BLOCK, retrieval.CHUNK_BLOCK = kept
    assert exact == want
    assert embedding.ann_topk(q, c.where("false"), 10).count() == 0
