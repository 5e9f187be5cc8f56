"""Small hand-computed cases."""

import pytest
from pyspark.sql import functions as F

from corpuslake.functions import paths
from corpuslake.functions import text as tx
from corpuslake.operators import chunks, embedding, evaluation, logs, metrics, retrieval, tables, validation
from corpuslake.sources import exports, staging


@pytest.mark.parametrize(
    "path,label,want",
    [
        ("docs/Server-Admin-Guide.pdf", "doc_type", "admin_guide"),
        ("x/ISO-9001-Standard.pdf", "doc_type", "standard"),
        ("x/Release-Notes-23.4.pdf", "doc_type", "release_notes"),
        ("x/README.txt", "doc_type", "document"),
        ("x/some-package.zip", "doc_type", "release_artifact"),
        ("appserver/admin.pdf", "product", "AppServer"),
        ("data-sync-config.pdf", "product", "DataSync"),
        ("varios/misc.pdf", "product", "geral"),
        ("CustomProduct/file.pdf", "product", "CustomProduct"),
        ("AppServer_32.0_Admin_Guide.pdf", "version", "32.0"),
        ("Manual_16.2.1.pdf", "version", "16.2.1"),
        ("DataSync/32.0/manual.pdf", "version", "32.0"),
        ("general/readme.pdf", "version", None),
        ("a/B/Designer/x.pdf", "subsystem", "B"),
        (".hidden", "doc_type", "document"),
    ],
)
def test_labels_of_paths(spark, path, label, want):
    df = spark.createDataFrame([(path,)], "path string")
    assert df.select(paths.classify(F.col("path"))[label]).first()[0] == want


def test_override_wins(spark):
    df = spark.createDataFrame([("appserver/a.pdf", "Mine"), ("appserver/a.pdf", "")], "path string, o string")
    assert [r[0] for r in df.select(paths.product_of(F.col("path"), F.col("o"))).collect()] == ["Mine", "AppServer"]


def test_fixed_chunks(spark):
    df = spark.createDataFrame([(1, "a" * 100), (2, "short"), (3, ""), (4, None)], "id int, text string")
    got = [(r.id, r.pos, len(r.chunk)) for r in chunks.chunk_fixed(df, 30, 10).orderBy("id", "pos").collect()]
    assert got == [(1, 0, 30), (1, 1, 30), (1, 2, 30), (1, 3, 30), (1, 4, 20)][:4]


def test_recursive_chunks():
    text = "\n\n".join([" ".join(["A sentence here."] * 10)] * 2)
    cut = chunks.split_recursive(text, 100, 10)
    assert len(cut) >= 2 and max(map(len, cut)) <= 100
    assert chunks.split_recursive("", 10, 2) == [] and chunks.split_recursive("abc", 10, 2) == ["abc"]


def test_top_terms_ties_by_first(spark):
    df = spark.createDataFrame([(1, "beta alpha database Database the the")], "id int, text string")
    assert chunks.top_terms(df, "id", "text").first()["terms"] == ["database", "beta", "alpha"]


def test_topics_and_graph_id(spark):
    df = spark.createDataFrame([("P", "REST", "API", "user_guide", "V")], "p string, m string, s string, d string, v string")
    row = df.select(tx.topics(*[F.col(c) for c in "pmsdv"]), tx.graph_id(F.lit("a"), F.col("p"))).first()
    assert row[0] == ["P", "REST", "User Guide", "V"] and len(row[1]) == 16


def test_html(spark):
    df = spark.createDataFrame([("<p>a &amp;lt; b</p><ul><li>x</li></ul>  <br/>y",)], "h string")
    assert df.select(tx.html_to_markdown(F.col("h"))).first()[0] == "a &lt; b\nx\ny"


def test_validation_fail_fast(spark):
    df = spark.createDataFrame([("a/b", 0, ""), ("a/b.txt", 900, "one two three four five six")], "path string, length long, text string")
    checks = [validation.check_exists(F.col("path"), F.col("length")), validation.check_extension(F.col("path")), validation.check_text(F.col("path"), F.col("text"))]
    out = validation.validate(df, checks)
    assert {r.path: (len(r.results), r.valid) for r in out.collect()} == {"a/b": (2, False), "a/b.txt": (3, True)}
    assert validation.failure_reasons(out, "path").count() == 2


def test_staged_header_round_trip(spark):
    df = spark.createDataFrame([("wiki", "7", "http://a/b:c", 5, "body: x")], "source_key string, remote_id string, remote_url string, remote_mtime long, html string")
    row = staging.stage_documents(df).select("file_name", staging.parse_header(F.col("staged"))).first()
    assert row[0] == "wiki__http___a_b_c__7.md" and row[1] == {"source": "wiki", "url": "http://a/b:c", "mtime": "5"}


def test_export_filters(spark, tmp_path):
    df = spark.createDataFrame([("a", "ok"), ("b", "error")], "path string, status string")
    exports.export_registry(df, str(tmp_path / "csv"), "csv", status="ok")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()[0]["path"] == "a"
    with pytest.raises(ValueError):
        exports.select_registry(df, version="1")


def test_rrf_orders(spark):
    hit = lambda xs: spark.createDataFrame([("q", c, r + 1) for r, c in enumerate(xs)], "query_id string, chunk_id string, rank int")
    both = retrieval.rrf_fuse(hit(["both", "dense"]), hit(["both", "sparse"]), 3)
    assert both.orderBy("rank").first()["chunk_id"] == "both"
    alone = retrieval.rrf_fuse(hit(["a", "b", "c"]), hit([]), 3)
    assert [r["chunk_id"] for r in alone.orderBy("rank").collect()] == ["a", "b", "c"]


def test_metrics(spark):
    hits = spark.createDataFrame([("q", "a", 1), ("q", "x", 2), ("q", "b", 3)], "query_id string, item string, rank int")
    want = spark.createDataFrame([("q", "a"), ("q", "c")], "query_id string, item string")
    assert evaluation.recall_at_k(hits, want, 3).first()["recall"] == 0.5
    marked = evaluation.mark_relevant(hits, want)
    assert evaluation.reciprocal_rank(marked).first()["rr"] == 1.0
    none = evaluation.mark_relevant(hits, want.where("false"))
    assert evaluation.ndcg_at_k(none, 3).first()["ndcg"] == 0.0 and evaluation.ir_metrics(none, want.where("false"), 3).first()["mrr"] == 0.0


@pytest.mark.parametrize("text,want", [("0.85", 0.85), ("85%", 0.85), ("Yes it is", 1.0), ("no", 0.0), ("8", 0.8), ("80", 0.8), ("1", 1.0), ("words", 0.5), (".5", 0.5)])
def test_parse_score(spark, text, want):
    assert spark.range(1).select(evaluation.parse_score(F.lit(text))).first()[0] == want


def test_latency_percentiles(spark):
    one = spark.createDataFrame([("a", i, i, float(v)) for i, v in enumerate((10, 20, 30))], "operation string, ts int, id int, latency_ms double")
    row = logs.operation_percentiles(one).first()
    assert (row["p50"], row["p99"]) == (20.0, 29.8)
    assert logs.latency_percentiles(one.where("false")).first()["p50"] == 0.0


def test_tags(spark):
    df = spark.createDataFrame([([" A", "a", "b", ""],), (["x y"],), ([str(i) for i in range(30)],)], "t array<string>")
    clean, error = tables.valid_tags(F.col("t"))
    got = df.select(clean.alias("c"), error.alias("e")).collect()
    assert got[0]["c"] == ["a", "b"] and [r["e"] for r in got] == [None, "tag with white space", "too many tags"]


def test_upsert_and_rollback(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, v string")
    new = spark.createDataFrame([("b", "3"), ("c", "4")], "path string, v string")
    assert sorted(map(tuple, tables.upsert(old, new, "path").collect())) == [("a", "1"), ("b", "3"), ("c", "4")]
    backups = spark.createDataFrame([("a", "v", "s1", "0"), ("a", "v", "s2", "9")], "path string, field_name string, session_timestamp string, old_value string")
    assert dict(map(tuple, tables.restore(old, backups, "path", ["v"]).collect())) == {"a": "9", "b": "2"}
    with pytest.raises(ValueError):
        tables.parse_filter("a=1,b")


def test_quota_order(spark):
    use = spark.createDataFrame([(11, 5, 5), (1, 5, 5)], "files_count long, bytes_total long, total_chunks long")
    got = [r["message"] for r in metrics.check_quota(use, {"max_files_per_upload": 10, "max_chunks_per_index": 5}).collect()]
    assert got == ["Upload would exceed max files per upload: 11 > 10", "Index at capacity: 5 >= 5 max chunks"]


def test_embedding_falls_back(spark):
    def broken(texts):
        raise RuntimeError("down")

    df = spark.createDataFrame([("a b",), ("a b",), (None,)], "text string")
    out = embedding.embed_distinct(df, "text", broken, embedding.hash_provider).collect()
    assert len(out) == 3 and all(r["error"] is None and len(r["vector"]) == embedding.DIM for r in out)
    assert embedding.embed(df, "text", broken).first()["error"] == "down"


def test_dense_topk_edges(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "query_id int, vector array<double>")
    c = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "chunk_id int, vector array<double>")
    assert [(r.query_id, r.chunk_id, r["rank"]) for r in retrieval.dense_topk(q, c, 5).collect()] == [(1, 1, 1), (1, 2, 2)]
    assert retrieval.dense_topk(q.where("false"), c, 5).count() == 0


def test_related_classes_lose_no_link(spark):
    # Label "all" is on more than 60 documents; "x" is on three of them.
    labels = {f"d{i:02}": ["all"] + (["x"] if i < 3 else []) for i in range(70)} | {"e": ["y"], "f": ["y", "x"], "none": []}
    df = spark.createDataFrame(list(labels.items()), "path string, hints array<string>")
    members, classes = (d.collect() for d in chunks.related_classes(df, "path", "hints"))
    want = {(a, b): len(set(labels[a]) & set(labels[b])) for a in labels for b in labels if a < b and set(labels[a]) & set(labels[b])}
    of = {r.path: r.class_id for r in members}
    shared = {frozenset((r.a, r.b)): r.shared for r in classes}
    assert {(a, b): shared[frozenset((of[a], of[b]))] for a in of for b in of if a < b and frozenset((of[a], of[b])) in shared} == want
    assert {r.path: r.links for r in members} == {p: sum(p in pair for pair in want) for p in labels}
    assert sum(r.links for r in classes) == len(want)


def test_context_of_every_turn(spark, tmp_path):
    from corpuslake.plans.registry import queries

    turns = [(c, t, "user", "x") for c, n in ((1, 4), (2, 1), (3, 2)) for t in range(n)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = [tuple(r) for r in queries()["h16_every_chunk_context"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted((a[0], a[1], b[1]) for a in turns for b in turns if a[0] == b[0] and abs(a[1] - b[1]) <= 1)
