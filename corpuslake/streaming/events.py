"""Structured Streaming over file events and request logs. Every function takes a batch or a
streaming DataFrame with an event time ``ts`` and gives the same rows for both."""

from __future__ import annotations

import heapq
import json
import threading
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from corpuslake.functions.paths import extension_of, name_of
from corpuslake.operators import ingest, metrics, tables
from corpuslake.sources.stored import scratch, written
from corpuslake.streaming.store import BucketStore, Change, Files, View, by_hash

# Names that are never watched, and suffixes that are.
IGNORED = (".tmp", ".swp", ".~", "~$", ".git", "__pycache__")
WATCHED = ("pdf", "docx", "xlsx", "pptx", "txt", "md")


def timed(events: DataFrame, late: str | None) -> DataFrame:
    """``ts`` as a timestamp, with a watermark where ``late`` (how long late rows count) is given."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late) if late else events


def watched(path: Column, suffixes=WATCHED) -> Column:
    hidden = F.lit(False)
    for part in IGNORED:
        hidden = hidden | F.contains(path, F.lit(part))
    return ~hidden & extension_of(path).isin(*suffixes) & (name_of(path) != "")


def debounce(events: DataFrame, key: str, gap: str = "30 seconds", late: str | None = None) -> DataFrame:
    """One trigger for each run of events of one key that follow each other within ``gap``."""
    w = F.session_window("ts", gap).alias("w")
    g = timed(events, late).groupBy(key, w).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("event_type")).alias("kinds"))
    return g.select(key, F.col("w.start").alias("start"), "n", "kinds")


def windowed(events: DataFrame, keys: list[str], width: str, *aggs: Column, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Aggregates in tumbling windows, or sliding ones."""
    g = timed(events, late).groupBy(*keys, F.window("ts", width, slide).alias("w")).agg(*aggs)
    return g.withColumn("start", F.col("w.start")).drop("w")


def distinct(events: DataFrame, keys: list[str], late: str | None = None) -> DataFrame:
    """The first row of each key; in a stream, among those within the watermark."""
    events = timed(events, late)
    return events.dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def each_batch(stream: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Hand micro-batches to ``act`` (ingest, deletion, retention or connector state). A batch can
    come again after a failure, so ``act`` must give the same tables when it does."""
    writer = stream.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def job_of(spark, checkpoint: str) -> str:
    """The query's own id, which a checkpoint keeps over restarts and a new one does not share."""
    return json.loads(Files(spark, checkpoint).read("metadata"))["id"]


def changing(stream: DataFrame, store: BucketStore, change: Callable[[DataFrame, View], Change], checkpoint: str) -> StreamingQuery:
    """Each micro-batch changes tables of ``store``, once even if it comes again."""
    def act(batch: DataFrame, number: int) -> None:
        with scratch():
            store.change(lambda view: change(batch, view), job_of(store.spark, checkpoint), number)

    return each_batch(stream, act, checkpoint)


def remove_paths(chunks: DataFrame, registry: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks without those of the ``deleted`` paths, and the registry with these marked deleted."""
    gone = deleted.select("path").distinct()
    left = chunks.join(gone.withColumnRenamed("path", "source_file"), "source_file", "left_anti")
    marked = registry.join(gone.withColumn("__gone", F.lit(True)), "path", "left")
    return left, marked.withColumn("status", F.when(F.col("__gone"), "deleted").otherwise(F.col("status"))).select(*registry.columns)


def corpus_store(spark, path: str, chunks: str, registry: str, buckets: int = 64) -> BucketStore:
    """Chunks and registry of these schemas, both dealt by the path of a document."""
    return BucketStore(spark, path, chunks=(chunks, by_hash("source_file", buckets=buckets)), registry=(registry, by_hash("path", buckets=buckets)))


def delete_job(events: DataFrame, store: BucketStore, checkpoint: str) -> StreamingQuery:
    """Delete events (path, event_type) take effect at once, without waiting for more."""
    def change(batch: DataFrame, view: View) -> Change:
        touched = view.buckets_of("registry", batch)
        left, marked = remove_paths(view.read("chunks", touched), view.read("registry", touched), batch)
        return {"chunks": (left.select(*view.read("chunks", []).columns), touched), "registry": (marked, touched)}

    return changing(events.where("event_type = 'deleted'").select("path"), store, change, checkpoint)


def ingest_job(files: DataFrame, store: BucketStore, checkpoint: str) -> StreamingQuery:
    """Triggered files (path, text, length) are ingested again, changed or not; of several versions of
    a path in one batch the longest counts, of equally long ones the greatest."""
    def change(batch: DataFrame, view: View) -> Change:
        once = written(batch.groupBy("path").agg(F.max(F.struct("length", "text")).alias("f")).select("path", "f.text", "f.length"), "triggered")
        touched = view.buckets_of("registry", once)
        chunks, registry = ingest.ingest_corpus(once, view.read("registry", touched), view.read("chunks", touched), force=True, store=lambda df: written(df, "ingested"))
        return {"chunks": (chunks, touched), "registry": (registry, touched)}

    return changing(files, store, change, checkpoint)


def retained(log: DataFrame, now: Column, days: int) -> DataFrame:
    """Rows of the last ``days`` before ``now``."""
    return log.where(F.col("ts").cast("timestamp") >= now - F.make_interval(days=F.lit(days)))


def retention_job(ticks: DataFrame, store: BucketStore, days: int, checkpoint: str) -> StreamingQuery:
    """Each batch of ``ticks`` (ts) purges the log of what is older than ``days`` at its latest tick. The log is
    dealt by day: whole days go without being read, and only the day of the limit is written again."""
    def change(batch: DataFrame, view: View) -> Change:
        at = F.max(F.col("ts").cast("timestamp"))
        now, limit = batch.agg(at, F.unix_date((at - F.make_interval(days=F.lit(days))).cast("date"))).first()
        if now is None:
            return {}
        old = [b for b in view.buckets("log") if b <= limit]
        # Rows without a time are older than any limit, as in a batch.
        return {"log": (retained(view.read("log", [b for b in old if b == limit]), F.lit(now), days), old)}

    return changing(ticks, store, change, checkpoint)


def connector_job(raw: DataFrame, parse: Callable[[DataFrame], DataFrame], store: BucketStore, checkpoint: str) -> StreamingQuery:
    """Landed JSON rows are parsed, the connector's state is upserted (the newest row of an id), and
    each source's checkpoint advances to the latest time of what has come, never back."""
    def change(batch: DataFrame, view: View) -> Change:
        docs = parse(batch).select("source_key", "remote_id", "remote_url", F.col("remote_mtime").cast("long").alias("remote_mtime"))
        new = docs.groupBy("source_key", "remote_id").agg(F.max_by(F.struct("remote_url", "remote_mtime"), F.struct(F.coalesce("remote_mtime", F.lit(0)), "remote_url")).alias("r")).select("source_key", "remote_id", "r.*")
        new = written(new, "landed")
        touched, sources = view.buckets_of("state", new), view.buckets_of("checkpoints", new)
        ahead = view.read("checkpoints", sources).unionByName(tables.next_checkpoints(new)).groupBy("source_key").agg(F.max("checkpoint").alias("checkpoint"))
        return {"state": (tables.upsert(view.read("state", touched), new, "source_key", "remote_id"), touched), "checkpoints": (ahead, sources)}

    return changing(raw, store, change, checkpoint)


PERCENTILES = "operation string, n long, p50 double, p95 double, p99 double"


def _stateful(stream: DataFrame) -> None:
    """State processors need a store that holds lists and values of their own."""
    conf = stream.sparkSession.conf
    if "RocksDB" not in (conf.get("spark.sql.streaming.stateStore.providerClass", None) or ""):
        conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class LastSamples(StatefulProcessor):
    """Keeps the last samples of an operation, by time and id, as a list; an operation that is ``idle`` for so many
    milliseconds is forgotten."""

    def __init__(self, last: int, idle: int | None):
        self.last, self.idle = last, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "ts long, id long, value double", self.idle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # A group may come in several frames in any order: what counts is the order of the samples.
        held = list(self.held.get()) if self.held.exists() else []
        for f in rows:
            held = heapq.nlargest(self.last, [*held, *zip(f["ts"].tolist(), f["id"].tolist(), f["value"].tolist(), strict=True)])
        self.held.put(held)
        x = np.sort(np.array([h[2] for h in held], float))
        at = [float(x[max(0, int(np.ceil(p * len(x))) - 1)]) for p in (0.5, 0.95, 0.99)]
        yield pd.DataFrame([(key[0], len(x), *at)], columns=["operation", "n", "p50", "p95", "p99"])

    def close(self) -> None:
        pass


def _micros(samples: DataFrame, column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp")) if samples.schema[column].dataType.typeName().startswith("timestamp") else F.col(column).cast("long")


def last_percentiles(samples: DataFrame, last: int = 1000, idle: int | None = 30 * 86_400_000) -> DataFrame:
    """Count and percentiles (the least value that at least that share of the values does not exceed)
    of the last ``last`` samples (operation, ts, value, and id to order those of one time) of each operation
    so far, with a row for each operation that a batch brings. State is bounded by ``last`` for each operation;
    one without samples for ``idle`` milliseconds is forgotten."""
    _stateful(samples)
    rows = samples.select("operation", _micros(samples, "ts").alias("ts"), (F.col("id") if "id" in samples.columns else F.lit(0)).cast("long").alias("id"), F.col("value").cast("double").alias("value"))
    return rows.groupBy("operation").transformWithStateInPandas(LastSamples(last, idle), PERCENTILES, "Update", "ProcessingTime")


class CounterSteps(StatefulProcessor):
    """Keeps a counter's last value over batches, so that the first sample of a batch is compared with the last one of
    the batch before; a fall is a restart from zero."""

    def __init__(self, kind: str):
        self.kind = kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.before = handle.getValueState("before", "value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["ts", "id"], kind="stable")
        before = self.before.get()[0] if self.before.exists() else None
        value = new["value"].to_numpy(float)
        last = np.concatenate([[value[0] if before is None else before], value[:-1]])
        self.before.update((float(value[-1]),))
        yield pd.DataFrame({"label": key[0], "ts": new["ts"], "step": np.where(value < last, value, value - last)})

    def close(self) -> None:
        pass


def counter_rate(samples: DataFrame, width: str, late: str, slide: str | None = None) -> DataFrame:
    """Increase a second of counters (label, ts, id, value) in windows, as ``metrics.counter_rate`` has it in a batch:
    counters keep their last value from batch to batch. A window comes out once it is ``late`` in the past. Samples of a
    label must come in order of ``ts`` from batch to batch; within a batch they are sorted."""
    _stateful(samples)
    kind = samples.schema["label"].dataType.simpleString()
    rows = timed(samples, late).select("label", "ts", F.col("id").cast("long").alias("id"), F.col("value").cast("double").alias("value"))
    steps = rows.groupBy("label").transformWithStateInPandas(CounterSteps(kind), f"label {kind}, ts timestamp, step double", "Append", "EventTime", eventTimeColumnName="ts")
    grown = steps.groupBy("label", F.window("ts", width, slide).alias("w")).agg(F.sum("step").alias("increase"))
    return grown.select("label", F.col("w.start").alias("start"), (F.col("increase") / (F.unix_timestamp("w.end") - F.unix_timestamp("w.start"))).alias("rate"))


def hit_ratio(events: DataFrame, hit: Column, miss: Column, width: str, late: str | None = None) -> DataFrame:
    """``metrics.hit_ratio`` of a stream or a batch."""
    return metrics.hit_ratio(timed(events, late), hit, miss, width)


def late_flags(events: DataFrame, key: str, order: str, delay: str) -> DataFrame:
    """``events`` with late: whether a row came (by ``order``) after one of its key that is more than
    ``delay`` younger. The batch twin of a watermark held for each key."""
    from pyspark.sql import Window

    ahead = F.max(F.col("ts").cast("timestamp")).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("late", F.coalesce(F.col("ts").cast("timestamp") < ahead - F.expr(f"INTERVAL {delay}"), F.lit(False)))


class RowCounts(StreamingQueryListener):
    """Rows that ``counted`` streams have brought in, and rows that their operators dropped as late, for as long as they
    run: every batch's report is added up as it comes, and not read from the few that a query keeps.

    What an aggregation drops are the rows that reach it, which Spark may have summed by key and window before. A batch
    that a restarted query runs again is reported again by the new run only.
    """

    def __init__(self, name: str = "arrived"):
        self.name, self._lock, self._batches = name, threading.Lock(), {}

    def counted(self, stream: DataFrame) -> DataFrame:
        """``stream``, observed."""
        return stream.observe(self.name, F.count(F.lit(1)).alias("rows"), F.max("ts").alias("latest"))

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = p.observedMetrics.get(self.name)
        dropped = sum(op.numRowsDroppedByWatermark for op in p.stateOperators)
        with self._lock:
            # A trigger without data reports the batch before once more.
            rows, before = self._batches.get((str(p.id), p.batchId), (0, 0))
            self._batches[str(p.id), p.batchId] = (max(rows, seen["rows"] if seen else 0), max(before, dropped))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def _sum(self, query: StreamingQuery | str, k: int) -> int:
        of = query if isinstance(query, str) else str(query.id)
        with self._lock:
            return sum(v[k] for (i, _), v in self._batches.items() if i == of)

    def arrived(self, query: StreamingQuery | str) -> int:
        return self._sum(query, 0)

    def dropped(self, query: StreamingQuery | str) -> int:
        return self._sum(query, 1)
