import json
import os

import pytest
from pyspark.sql import functions as F

from corpuslake.streaming import events as ev
from corpuslake.streaming.store import BucketStore, Manifest, by_day, by_hash

SCHEMA = "path string, event_type string, ts timestamp"


def _stream(spark, tmp_path, rows):
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "path string, event_type string, t string").select("path", "event_type", F.to_timestamp("t").alias("ts")).write.parquet(src)
    return spark.readStream.schema(SCHEMA).parquet(src)


def test_debounce_streams_as_in_batch(spark, tmp_path):
    rows = [("a.pdf", "created", "2024-01-01 00:00:00"), ("a.pdf", "modified", "2024-01-01 00:00:20"), ("b.pdf", "created", "2024-01-01 00:00:05"), ("z.pdf", "created", "2024-01-02 00:00:00")]
    stream = _stream(spark, tmp_path, rows)
    q = ev.debounce(stream, "path", late="1 minute").writeStream.format("memory").queryName("debounced").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(r.path, r.n, tuple(r.kinds)) for r in spark.table("debounced").collect()}
    assert {("a.pdf", 2, ("created", "modified")), ("b.pdf", 1, ("created",))} <= got


def test_each_batch_can_be_repeated(spark, tmp_path):
    stream = _stream(spark, tmp_path, [("a.pdf", "created", "2024-01-01 00:00:00"), ("a.tmp", "created", "2024-01-01 00:00:01")])
    out = str(tmp_path / "out")
    q = ev.each_batch(stream.where(ev.watched(F.col("path"))), lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}"), str(tmp_path / "c"))
    q.awaitTermination(60)
    assert [r.path for r in spark.read.parquet(out).collect()] == ["a.pdf"]


def test_distinct_in_stream(spark, tmp_path):
    stream = _stream(spark, tmp_path, [("a.pdf", "created", "2024-01-01 00:00:00"), ("a.pdf", "modified", "2024-01-01 00:00:01")])
    q = ev.distinct(stream, ["path"], "1 minute").writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("once").count() == 1


def _land(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


CHUNKS = "chunk_id string, source_file string, chunk_index int, text string, product string, doc_type string, vendor string, subsystem string, module string, version string, doc_graph_id string, graph_topics array<string>, graph_related array<string>, vector array<float>"
REGISTRY = "path string, sha256 string, status string, chunks long, error_msg string"


def test_ingest_and_delete_jobs_survive_restarts(spark, tmp_path):
    state = ev.corpus_store(spark, str(tmp_path / "state"), CHUNKS, REGISTRY, buckets=8)
    files, src = "path string, text string, length long", str(tmp_path / "files")
    body = lambda w: (w + " ") * 60
    for texts in ({"a.txt": "one", "b.txt": "two"}, {"a.txt": "three", "c.exe": "no"}):
        _land(spark, src, [(p, body(t), 240) for p, t in texts.items()], files)
        # A new query over the same checkpoint takes up where the last one ended.
        ev.ingest_job(spark.readStream.schema(files).parquet(src), state, str(tmp_path / "c1")).awaitTermination(120)
    found = {r.path: r.status for r in state.read("registry").collect()}
    assert found == {"a.txt": "ok", "b.txt": "ok", "c.exe": "error"}
    assert {r.source_file: "three" in r.text for r in state.read("chunks").collect()} == {"a.txt": True, "b.txt": False}
    gone = str(tmp_path / "events")
    _land(spark, gone, [("a.txt", "deleted", None), ("b.txt", "modified", None)], SCHEMA)
    ev.delete_job(spark.readStream.schema(SCHEMA).parquet(gone), state, str(tmp_path / "c2")).awaitTermination(120)
    assert {r.path: r.status for r in state.read("registry").collect()}["a.txt"] == "deleted"
    assert {r.source_file for r in state.read("chunks").collect()} == {"b.txt"}


def test_retention_job(spark, tmp_path):
    state = BucketStore(spark, str(tmp_path / "state"), log=("id long, ts timestamp", by_day("ts")))
    state.replace(log=spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-20 00:00:00"), (3, "2024-01-14 23:00:00"), (4, "2024-01-15 00:00:00"), (5, "2024-01-15 07:00:00"), (6, None)], "id long, t string").select("id", F.to_timestamp("t").alias("ts")))
    days = dict(state.current().manifest.tables["log"])
    ticks = str(tmp_path / "ticks")
    _land(spark, ticks, [("x", "tick", None)], SCHEMA)
    job = lambda: ev.retention_job(spark.readStream.schema(SCHEMA).parquet(ticks), state, 10, str(tmp_path / "c")).awaitTermination(60)
    job()
    assert state.read("log").count() == 6
    spark.createDataFrame([("x", "tick", "2024-01-25 06:00:00")], "path string, event_type string, t string").select("path", "event_type", F.to_timestamp("t").alias("ts")).write.mode("append").parquet(ticks)
    job()
    assert sorted(r.id for r in state.read("log").collect()) == [2, 5]
    # The day after the limit is the same file as before, the day of the limit a new one.
    left = state.current().manifest.tables["log"]
    assert set(left) == {"19737", "19742"} and left["19742"] == days["19742"] and left["19737"] != days["19737"]


def test_connector_job(spark, tmp_path):
    from corpuslake.sources import connectors

    state = BucketStore(spark, str(tmp_path / "state"), state=("source_key string, remote_id string, remote_url string, remote_mtime long", by_hash("source_key", "remote_id", buckets=8)), checkpoints=("source_key string, checkpoint string", by_hash("source_key", buckets=2)))
    raw, page = str(tmp_path / "raw"), '{{"id": "{}", "version": {{"when": "2024-01-0{}T00:00:00Z"}}}}'
    for rows in ([(page.format("p", 1),), (page.format("q", 2),)], [(page.format("p", 4),), (page.format("p", 3),)]):
        _land(spark, raw, rows, "value string")
        ev.connector_job(spark.readStream.schema("value string").parquet(raw), lambda df: connectors.remote_pages(df, "wiki", "b"), state, str(tmp_path / "c")).awaitTermination(60)
    assert sorted((r.remote_id, r.remote_mtime) for r in state.read("state").collect()) == [("p", 1704326400), ("q", 1704153600)]
    assert [r.checkpoint for r in state.read("checkpoints").collect()] == ["2024-01-04T00:00:00Z"]


def _run(stream, path, mode, checkpoint):
    q = stream.writeStream.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{path}/batch={i}")).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return q


def test_last_percentiles_in_stream_and_batch(spark, tmp_path):
    """Rows of a batch out of order and in many frames, more than are kept, over a restart."""
    import random

    from corpuslake.operators import logs

    src, schema = str(tmp_path / "in"), "operation string, ts long, value double, id long"
    rows = [("a", i // 3, float(i * 37 % 1009), i) for i in range(2500)] + [("b", 1, 5.0, 0)] + [("c", 9, float(i), i) for i in range(30)]
    parts = [rows[:1300], rows[1300:]]
    frames = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        for part in parts:
            random.Random(4).shuffle(part)
            _land(spark, src, part, schema)
            _run(ev.last_percentiles(spark.readStream.schema(schema).parquet(src), 1000), tmp_path / "out", "update", str(tmp_path / "c"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", frames)
    got = {r.operation: (r.n, r.p50, r.p95, r.p99) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("batch").collect()}
    batch = logs.last_n_percentiles(spark.createDataFrame(rows, schema), 1000).collect()
    assert got == {r.operation: (r.n, r.p50, r.p95, r.p99) for r in batch} and got["b"] == (1, 5.0, 5.0, 5.0) and got["a"][0] == 1000


@pytest.mark.parametrize("width", ["1 hour", "5 minutes"])
def test_counters_keep_their_last_value_over_batches(spark, tmp_path, width):
    """A reset on the border of two batches, and one inside a batch."""
    from corpuslake.operators import metrics

    src, schema = str(tmp_path / "in"), "label string, id long, value double, ts timestamp"
    at = lambda m: F.timestamp_seconds(F.lit(1704067200 + 60 * m))
    values = {"a": [5, 9, 9, 30, 2, 7, 8, 3, 4, 90], "b": [1, 1, 0, 8, 8, 8, 2, 3, 4, 5]}
    rows = [(k, i, float(v), 11 * i) for k, vs in values.items() for i, v in enumerate(vs)]
    whole = spark.createDataFrame(rows, "label string, id long, value double, m long").withColumn("ts", F.timestamp_seconds(1704067200 + 60 * F.col("m"))).drop("m")
    end = spark.range(1).select(F.lit("z").alias("label"), F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("value"), at(600).alias("ts"))
    for part in (whole.where("id < 4"), whole.where("id BETWEEN 4 AND 6"), whole.where("id > 6"), end, end):
        part.coalesce(1).write.mode("append").parquet(src)
        _run(ev.counter_rate(spark.readStream.schema(schema).parquet(src), width, "10 minutes"), tmp_path / "out", "append", str(tmp_path / "c"))
    got = sorted((r.label, str(r.start), round(r.rate, 9)) for r in spark.read.parquet(str(tmp_path / "out")).where("label <> 'z'").collect())
    want = sorted((r.label, str(r.start), round(r.rate, 9)) for r in metrics.counter_rate(whole, width).collect())
    assert got == want and any(r[2] > 0 for r in got)


def test_hit_ratio_in_stream_and_batch(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "event_type string, ts timestamp"
    whole = spark.range(200).select(F.when(F.col("id") % 3 == 0, "hit").otherwise("miss").alias("event_type"), F.timestamp_seconds(1704067200 + 17 * F.col("id")).alias("ts"))
    end = spark.range(1).select(F.lit("hit").alias("event_type"), F.timestamp_seconds(F.lit(1704067200 + 99999)).alias("ts"))
    ask = lambda df, late=None: ev.hit_ratio(df, F.col("event_type") == "hit", F.col("event_type") == "miss", "5 minutes", late)
    for part in (whole.where("ts < timestamp_seconds(1704068000)"), whole.where("ts >= timestamp_seconds(1704068000)"), end):
        part.coalesce(1).write.mode("append").parquet(src)
        _run(ask(spark.readStream.schema(schema).parquet(src), "1 minute"), tmp_path / "out", "append", str(tmp_path / "c"))
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).drop("batch").collect())) == sorted(map(str, ask(whole).collect()))


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    """More batches than a query keeps reports of; late rows among the first of them."""
    src = str(tmp_path / "in")
    rows = lambda *r: spark.createDataFrame(r, "path string, event_type string, t string").select("path", "event_type", F.to_timestamp("t").alias("ts"))
    parts = [rows(("a", "x", "2024-01-01 10:00:00")), rows(("b", "x", "2024-01-01 10:00:05")), rows(("c", "x", "2024-01-01 08:00:00"), ("d", "x", "2024-01-01 10:00:06"), ("e", "x", "2024-01-01 07:30:00"))]
    parts += [rows((f"f{i}", "x", f"2024-01-01 10:01:0{i}")) for i in range(4)]
    kept = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    counts = ev.RowCounts()
    spark.streams.addListener(counts)
    try:
        for df in parts:
            df.coalesce(1).write.mode("append").parquet(src)
        stream = counts.counted(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src))
        windows = ev.windowed(stream, [], "1 minute", F.count(F.lit(1)).alias("n"), late="10 minutes")
        q = windows.writeStream.format("noop").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        for _ in range(100):  # reports come after the batches
            if counts.arrived(q) == 9:
                break
            __import__("time").sleep(0.1)
        assert len(q.recentProgress) <= 2
        assert counts.arrived(q) == 9 and counts.dropped(q) == 2
    finally:
        spark.streams.removeListener(counts)
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", kept)
    all_ = spark.createDataFrame([(i, r.path, str(r.ts)) for i, df in enumerate(parts) for r in df.orderBy("path").collect()], "id long, path string, t string").select("id", "path", F.lit(1).alias("k"), F.to_timestamp("t").alias("ts"))
    assert sorted(r.path for r in ev.late_flags(all_, "k", "id", "10 MINUTES").where("late").collect()) == ["c", "e"]


def _corpus(spark, tmp_path, n, buckets):
    store = ev.corpus_store(spark, str(tmp_path / "state"), CHUNKS, REGISTRY, buckets)
    path = F.concat(F.lit("d/"), F.col("id").cast("string"), F.lit(".txt"))
    kinds = lambda schema: [c.strip().split(" ", 1) for c in schema.split(",")]
    fill = lambda schema, **known: [known.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds(schema)]
    store.replace(
        chunks=spark.range(n).select(*fill(CHUNKS, chunk_id=F.col("id").cast("string"), source_file=path, chunk_index=F.lit(0), text=F.lit("old"))),
        registry=spark.range(n).select(*fill(REGISTRY, path=path, sha256=F.lit("x"), status=F.lit("ok"), chunks=F.lit(1))),
    )
    return store


def _data_files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_a_small_batch_writes_few_buckets(spark, tmp_path):
    """One path of 10,000: the change writes one bucket of each table and shares all others."""
    store = _corpus(spark, tmp_path, 10_000, 64)
    before, files = store.current().manifest, _data_files(tmp_path / "state")
    assert {len(t) for t in before.tables.values()} == {64}
    src = str(tmp_path / "files")
    _land(spark, src, [("d/77.txt", "new words " * 30, 300)], "path string, text string, length long")
    ev.ingest_job(spark.readStream.schema("path string, text string, length long").parquet(src), store, str(tmp_path / "c")).awaitTermination(120)
    after = store.current().manifest
    for table in ("chunks", "registry"):
        changed = {b for b in before.tables[table] if before.tables[table][b] != after.tables[table][b]}
        assert len(changed) == 1 and set(after.tables[table]) == set(before.tables[table])
    new = _data_files(tmp_path / "state") - files
    assert 2 <= len(new) <= 4
    rows = store.read("chunks").where("source_file = 'd/77.txt'").collect()
    assert len(rows) == 1 and rows[0].text.startswith("new words") and store.read("chunks").count() == 10_000
    # What was replaced stays for one more change, then goes.
    assert files <= _data_files(tmp_path / "state")
    store.change(lambda view: {})
    assert len(files - _data_files(tmp_path / "state")) >= 2 and store.read("registry").count() == 10_000


def test_a_crash_between_two_tables_changes_nothing(spark, tmp_path):
    store = _corpus(spark, tmp_path, 50, 4)
    view, shown = store.current(), store.current().manifest.tables
    keys = spark.createDataFrame([("d/1.txt",)], "path string")
    touched = view.buckets_of("registry", keys)
    left, marked = ev.remove_paths(view.read("chunks", touched), view.read("registry", touched), keys)

    def fails(v):
        raise RuntimeError("lost")

    boom = F.udf(fails, "string")
    with pytest.raises(Exception, match="lost"):
        store.change(lambda v: {"chunks": (left.select(*v.read("chunks").columns), touched), "registry": (marked.withColumn("status", boom("path")), touched)})
    assert store.current().manifest.tables == shown and store.read("chunks").count() == 50
    assert store.vacuum() and store.read("chunks").count() == 50 and not store.vacuum()
    # A manifest that was cut short is passed over, and its number is not used again.
    number = store.current().manifest.number
    with open(f"{tmp_path}/state/manifests/{number + 1:012d}.json", "w") as f:
        f.write('{"tables": {"chu')
    assert store.current(patience=0.3).manifest.number == number
    store.change(lambda v: {"chunks": (left.select(*v.read("chunks").columns), touched), "registry": (marked, touched)})
    assert store.current().manifest.number == number + 2 and store.read("chunks").count() == 49


def test_changes_of_other_jobs_are_kept(spark, tmp_path):
    store = _corpus(spark, tmp_path, 40, 8)
    gone = {i: spark.createDataFrame([(f"d/{i}.txt",)], "path string") for i in range(40)}
    bucket = {i: store.current().buckets_of("registry", gone[i])[0] for i in range(8)}
    other = next(i for i in bucket if bucket[i] != bucket[0])
    same = next(i for i in range(1, 40) if store.current().buckets_of("registry", gone[i])[0] == bucket[0])
    calls = []

    def delete(i, meanwhile=None):
        def make(view):
            calls.append(i)
            touched = view.buckets_of("registry", gone[i])
            left, marked = ev.remove_paths(view.read("chunks", touched), view.read("registry", touched), gone[i])
            if meanwhile is not None and calls.count(i) == 1:
                delete(meanwhile)
            return {"chunks": (left.select(*view.read("chunks", []).columns), touched), "registry": (marked, touched)}

        store.change(make)

    delete(0, meanwhile=other)  # another bucket: brought onto the other's outcome
    assert calls == [0, other] and store.read("chunks").count() == 38
    calls.clear()
    delete(10, meanwhile=None)
    calls.clear()
    delete(same, meanwhile=0)  # the same bucket: made again
    assert calls == [same, 0, same] and store.read("registry").where("status = 'deleted'").count() == 4


def test_a_batch_that_comes_again_counts_once(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path / "s"), log=("id long, ts timestamp", by_hash("id", buckets=2)))
    add = lambda v: {"log": (v.read("log").unionAll(spark.range(3).select("id", F.lit(None).cast("timestamp"))), [0, 1])}
    assert store.change(add, "job", 0) and not store.change(add, "job", 0) and store.change(add, "job", 1) and store.change(add, "other", 0)
    assert store.read("log").count() == 9 and store.current().manifest.done == {"job": 1, "other": 0}
    with pytest.raises(ValueError, match="does not replace"):
        store.change(lambda v: {"log": (v.read("log"), [1])})
    assert Manifest(**json.loads(store.files.read(f"manifests/{store.current().manifest.number:012d}.json"))).done == {"job": 1, "other": 0}


def test_an_empty_store(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path / "s"), log=("id long, ts timestamp", by_day("ts")))
    assert store.read("log").count() == 0 and store.current().buckets("log") == [] and store.vacuum() == []
