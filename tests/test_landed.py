"""Python data sources, experiments with their run store, and scorers and judges that fail."""

import json
import os

import pytest
from pyspark.sql import functions as F

from corpuslake.operators import chunks, evaluation, experiments, retrieval
from corpuslake.sources import connectors, extract, landed, loaders

PAGE = '{{"id": "{}", "version": {{"when": "{}"}}, "body": {{"storage": {{"value": "<p>{}</p>"}}}}}}'


def _land(spark, path, batch, days):
    rows = [(PAGE.format(f"p{batch}-{d}-{i}", f"2024-01-{d:02d}T0{i}:00:00Z", "x" * 40), d, i) for d in days for i in range(5)]
    df = spark.createDataFrame(rows, "value string, d int, i int").withColumn("modified", F.unix_timestamp(F.make_timestamp(F.lit(2024), F.lit(1), "d", "i", F.lit(0), F.lit(0))))
    landed.land(df, path, batch)


def test_landed_texts_by_range_and_since(spark, tmp_path):
    path = f"{tmp_path}/landed"
    _land(spark, path, 0, [1, 2])
    _land(spark, path, 1, [2, 9])
    whole = landed.scan_landed(spark, path)
    assert whole.count() == 20 and whole.select("value").distinct().count() == 20
    # Ranges of 64 bytes: every line once, wherever ranges begin and end.
    small = spark.read.format("landed").option("range_bytes", 64).load(path)
    assert small.rdd.getNumPartitions() > 20 and sorted(r.value for r in small.collect()) == sorted(r.value for r in whole.collect())
    found = landed.scan_landed(spark, path, "2024-01-02T03:00:00Z")
    assert {str(r.until) for r in found.collect()} == {"2024-01-02", "2024-01-09"}
    ranges = lambda since: landed.Landings({"path": path, "since": since}).ranges()
    assert len(ranges("2024-01-05")) < len(ranges(None)) and {r.until.day for r in ranges("2024-01-05")} == {9}
    docs = connectors.fetch_documents("wiki", found, "wiki", "b", 1704164400.0 + 3600 * 0)
    assert docs.count() == len([1 for d in (2, 2, 9) for i in range(5) if d == 9 or i >= 3])
    # A filter on the day is pushed down as well.
    assert whole.where(F.col("until") >= F.lit("2024-01-09").cast("date")).count() == 5
    reader = landed.LandedReader({"path": path})
    assert len(list(reader.pushFilters([landed.GreaterThanOrEqual(("until",), __import__("datetime").date(2024, 1, 9))]))) == 1
    assert {p.until.day for p in reader.partitions()} == {9}
    assert landed.scan_landed(spark, f"{tmp_path}/none").count() == 0


def test_landed_stream_takes_up_where_it_ended(spark, tmp_path):
    path, out = f"{tmp_path}/landed", f"{tmp_path}/out"

    def run():
        docs = connectors.remote_pages(landed.scan_landed(spark, path, stream=True), "wiki", "b").select("remote_id")
        q = docs.writeStream.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}")).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination(120)

    _land(spark, path, 0, [1])
    run()
    _land(spark, path, 1, [1, 3])
    os.makedirs(f"{path}/batch=000000000002/until=2024-01-04")  # not whole yet
    run()
    got = [r.remote_id for r in spark.read.parquet(out).collect()]
    assert len(got) == 15 and len(set(got)) == 15
    with open(f"{path}/batch=000000000002/until=2024-01-04/part-0.txt", "w") as f:
        f.write(PAGE.format("late", "2024-01-04T00:00:00Z", "y") + "\n")
    open(f"{path}/batch=000000000002/_SUCCESS", "w").close()
    run()
    assert spark.read.parquet(out).where("remote_id = 'late'").count() == 1 and spark.read.parquet(out).count() == 16


def test_override_files(spark, tmp_path):
    root = str(tmp_path / "tree")
    rows = [("", {"defaults": {"doc_type": "howto"}}), ("a", {"defaults": {"product": "P"}}), ("a/b/c", {"files": {"x.txt": {"vendor": "V"}}}), ("d", "no json")]
    landed.write_overrides(spark.createDataFrame([(f, v if isinstance(v, str) else json.dumps(v)) for f, v in rows], "folder string, value string"), root)
    with open(f"{root}/a/other.json", "w") as f:
        f.write("{}")
    found = landed.scan_overrides(spark, root)
    assert {r.folder for r in found.collect()} == {"", "a", "a/b/c", "d"}
    folders, files, rejects = loaders.parse_overrides(found, ("howto",))
    assert {r.folder for r in folders.collect()} == {"", "a"} and [r.path for r in files.collect()] == ["a/b/c/x.txt"] and [r.path for r in rejects.collect()] == ["d"]


def _texts(spark):
    chunks_ = spark.createDataFrame([(i, f"word{i % 5} shared text number{i}", [float(i % 3), 1.0, float(i)]) for i in range(30)], "chunk_id long, text string, vector array<float>")
    queries = spark.createDataFrame([(0, "word1 number6", [0.0, 1.0, 6.0]), (1, "nothing", [2.0, 1.0, 2.0])], "query_id long, text string, vector array<float>")
    return queries, chunks_


def test_variants_share_one_stage_of_searches(spark, monkeypatch):
    queries, chunks_ = _texts(spark)
    calls = []
    for name in ("dense_topk", "sparse_topk"):
        own = getattr(retrieval, name)
        monkeypatch.setattr(retrieval, name, lambda *a, own=own, name=name: calls.append(name) or own(*a))
    found = experiments.candidates(queries, chunks_, 10, -1.0)
    experiments.register_variant("first_only", lambda c, k: retrieval.ranked(c.where("dense_rank = 1").withColumn("score", F.lit(1.0)), k).select("query_id", "chunk_id", "score", "rank"))
    try:
        out = experiments.variant_experiment(found, spark.createDataFrame([(0, 6), (1, 2)], "query_id long, chunk_id long"), 3)
        assert sorted(calls) == ["dense_topk", "sparse_topk"]
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapCoGroups" not in plan and "word" not in plan
        got = {r.variant: r.recall for r in out.collect()}
        assert set(got) == set(evaluation.SCORING_VARIANTS) | {"first_only"} and got["dense_only"] == 1.0
    finally:
        del experiments.VARIANTS["first_only"]
    hits = experiments.search_variant("dense_only", queries, chunks_, 2)
    assert {(r.query_id, r.rank) for r in hits.collect()} == {(0, 1), (0, 2), (1, 1), (1, 2)}
    with pytest.raises(ValueError, match="unknown variant"):
        experiments.search_variant("none", queries, chunks_, 2)


def test_sweeps_are_bounded(spark):
    lists = {"dense_weight": [1.0, 0.5], "sparse_weight": [0.0], "k": [1, 2, 3], "rerank": [False, True]}
    assert experiments.combinations(spark, lists).count() == 12
    with pytest.raises(ValueError, match="combinations"):
        experiments.combinations(spark, {"k": range(200), "n": range(200)})


def test_first_run_becomes_the_baseline_once(spark, tmp_path):
    store = experiments.run_store(spark, str(tmp_path / "runs"), buckets=4)
    runs = lambda *r: spark.createDataFrame([(i, t, "{}", m, v) for i, t, m, v in r], "run_id string, t string, params string, metric string, value double").select("run_id", F.to_timestamp("t").alias("ts"), "params", "metric", "value")
    experiments.save_run(store, runs(("a", "2024-01-02 00:00:00", "mrr", 0.5), ("a", "2024-01-02 00:00:00", "recall", 0.7)))
    experiments.save_run(store, runs(("b", "2024-01-01 00:00:00", "mrr", 0.9)))
    found = [(r.run_id, r.metrics) for r in experiments.load_runs(store).collect()]
    assert found == [("a", {"mrr": 0.5, "recall": 0.7}), ("baseline", {"mrr": 0.5, "recall": 0.7}), ("b", {"mrr": 0.9})]
    experiments.save_run(store, runs(("b", "2024-01-03 00:00:00", "mrr", 0.8)))
    assert [r.run_id for r in experiments.load_runs(store, 2).collect()] == ["b", "a"] and experiments.load_run(store, "b").first().value == 0.8
    experiments.delete_run(store, "a")
    assert {r.run_id for r in experiments.load_runs(store).collect()} == {"b", "baseline"}
    assert evaluation.baseline_of(store.read("runs")).first()[0] == "baseline"


def test_a_failing_scorer_keeps_the_old_order_of_its_query(spark):
    def _breaks(query, text):
        if "bad" in text:
            raise RuntimeError("model lost")
        return float(len(text))

    rows = [(q, c, c + 1, 1.0 - c / 100, "q", "bad" if q == 1 and c == 25 else "x" * (c % 7)) for q in (0, 1, 2) for c in range(30)]
    hits = spark.createDataFrame(rows, "query_id long, chunk_id long, rank int, score double, query_text string, text string")
    got = {}
    for r in retrieval.rerank(hits, 3, _breaks).collect():
        got.setdefault((r.query_id, r.outcome), []).append((r.rank, r.chunk_id))
    assert sorted(got[1, "RuntimeError: model lost"]) == [(1, 0), (2, 1), (3, 2)]
    assert sorted(got[0, "ok"]) == sorted(got[2, "ok"]) == [(1, 6), (2, 13), (3, 20)]
    outcome = [r.outcome for r in retrieval.scored(hits.where("query_id = 1").coalesce(1), _breaks).collect()]
    assert outcome.count("ok") == 20 and outcome.count("RuntimeError: model lost") == 10
    assert retrieval.rerank(hits.where("false"), 3, _breaks).count() == 0


def test_judges_fail_by_prompt(spark):
    def _reply(prompt):
        if "bad" in prompt:
            raise RuntimeError("refused")
        return f"one {prompt}"

    def _replies(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("whole batch refused")
        return [f"all {p}" for p in prompts]

    prompts = spark.createDataFrame([(i, "bad" if i == 25 else f"p{i}") for i in range(50)], "i int, prompt string").coalesce(1)
    got = {r.i: (r.reply, r.error) for r in evaluation.judge(prompts, _reply, _replies, 20).collect()}
    assert got[3] == ("all p3", None) and got[22] == ("one p22", None) and got[25] == (None, "RuntimeError: refused") and got[45] == ("all p45", None)


def test_chunk_table_function(spark):
    chunks.register_functions(spark)
    docs = spark.createDataFrame([(1, "a" * 100), (2, None), (3, "")], "doc_id long, text string")
    got = spark.sql("SELECT doc_id, c.pos, length(c.chunk) AS n FROM {docs}, LATERAL chunk(text, 'fixed', 60, 20) c", docs=docs).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 60), (1, 1, 60)]


def test_document_trees_of_any_shape():
    deep = {"type": "text", "text": "deep"}
    for _ in range(900):
        deep = {"type": "paragraph", "content": [deep]}
    assert connectors.tree_text(json.dumps(deep)) == "deep"
    odd = {"type": "doc", "content": ["a string", 7, None, {"type": "bulletList", "content": ["x", {"content": "y"}, {"content": [{"type": "text", "text": "kept"}]}]}, {"type": "text", "text": 5}, {"content": {"type": "text"}}]}
    assert connectors.tree_text(json.dumps(odd)) == "-\n-\n- kept"
    assert connectors.tree_text("[" * 100_000) == "" and connectors.tree_text(json.dumps([1])) == ""


def test_golden_csv_with_line_breaks(spark, tmp_path):
    path = str(tmp_path / "g.csv")
    with open(path, "w") as f:
        f.write('query;"expected, answer;x";expected_answer;metadata\n " q1 ";"a, b";"line one\nline ""two"" ";\n"q2";z; fine ;"{""k"": ""v""}"\nq3;;x;raw text\n')
    rows = loaders.load_golden_csv(spark, path).collect()
    assert [(r["query"], r.expected_answer, r.expected_docs, r.metadata) for r in rows][1:] == [("q2", "fine", [], {"k": "v"}), ("q3", "x", [], {"raw": "raw text"})]
    assert rows[0].expected_answer == 'line one\nline "two"' and rows[0].metadata == {}
    assert loaders.delimiter_of('"a;b;c",d,e') == "," and loaders.delimiter_of("a\tb") == "\t" and loaders.delimiter_of("x") == ","


def test_sparse_sheets():
    from corpuslake.plans.sources import _made, _zipped

    sheet = '<s><dimension ref="A1:D9"/><row><c r="A1"><v>4</v></c><c r="C1"><v>6</v></c></row><row><c><v>1e3</v></c><c r="B2" t="e"><v>#N/A</v></c></row></s>'
    book = _zipped({"xl/workbook.xml": '<w><sheet name="S"/></w>', "xl/worksheets/sheet1.xml": sheet})
    assert extract.xlsx(book) == [("S", "[Planilha: S]\n4\t\t6\t\n1000.0\t#N/A\t\t")]
    assert extract.docx(_made(["a b", "", "c"], "docx")) == [("", "a\tb\nc")]
    assert extract.open_document(_made(["x"], "odt")) == [("", "x\nin a table\tcell")]
    assert extract.sections_of("a.xlsx", b"broken") == []
