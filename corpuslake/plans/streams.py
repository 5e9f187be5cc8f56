"""Batch twins of the streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslake.operators import metrics
from corpuslake.plans.registry import query
from corpuslake.plans.views import view
from corpuslake.streaming import events as ev


_HIDDEN = " OR ".join(f"contains(path, '{part}')" for part in ev.IGNORED)


@query(f"""SELECT path FROM {{files}} WHERE NOT ({_HIDDEN}) AND lower(regexp_extract(string_split(path, '/')[-1], '^.+\\.([^.]+)$', 1)) IN {ev.WATCHED}""")
def n1_stream_file_events(spark, sf_dir):
    return view(spark, sf_dir, "files").where(ev.watched(F.col("path"))).select("path")


@query("""
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL '30 seconds' THEN 0 ELSE 1 END AS new FROM {events}),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT user_id AS key, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, run""")
def n2_debounce_events(spark, sf_dir):
    found = ev.debounce(view(spark, sf_dir, "events").withColumn("key", F.col("user_id")), "key")
    return found.select("key", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("SELECT event_type, strftime(time_bucket(INTERVAL '1 day', ts), '%Y-%m-%d') AS start, count(*) AS n, round(sum(value), 2) AS total FROM {events} GROUP BY 1, 2")
def n5_stream_query_metrics(spark, sf_dir):
    found = ev.windowed(view(spark, sf_dir, "events"), ["event_type"], "1 day", F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return found.withColumn("start", F.date_format("start", "yyyy-MM-dd"))


@query("""SELECT event_type, strftime(time_bucket(INTERVAL '10 seconds', ts) - to_seconds(10 * CAST(k AS INT)), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n
FROM {events}, (SELECT unnest(generate_series(0, 5)) AS k) GROUP BY 1, 2""")
def n6_stream_sliding_usage(spark, sf_dir):
    found = ev.windowed(view(spark, sf_dir, "events"), ["event_type"], "60 seconds", F.count(F.lit(1)).alias("n"), slide="10 seconds")
    return found.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT DISTINCT user_id, event_type FROM {events}")
def n7_stream_dedup(spark, sf_dir):
    return ev.distinct(view(spark, sf_dir, "events"), ["user_id", "event_type"]).select("user_id", "event_type")


@query("""
WITH s AS (SELECT user_id AS label, ts, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM {events})
SELECT label, strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M') AS start,
  round(sum(CASE WHEN before IS NULL THEN 0 WHEN value < before THEN value ELSE value - before END) / 3600, 6) AS rate FROM s GROUP BY 1, 2""")
def n5_counter_rate_hourly(spark, sf_dir):
    """Batch twin of ``events.counter_rate``."""
    samples = view(spark, sf_dir, "events").select(F.col("user_id").alias("label"), "ts", "value", F.col("event_id").alias("id"))
    return metrics.counter_rate(samples, "1 hour").select("label", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), F.round("rate", 6).alias("rate"))


@query("""SELECT strftime(time_bucket(INTERVAL '5 minutes', ts), '%Y-%m-%d %H:%M') AS start, count(*) FILTER (WHERE event_type = 'click') AS hits, count(*) FILTER (WHERE event_type = 'error') AS misses,
  count(*) FILTER (WHERE event_type = 'click') < 0.5 * count(*) FILTER (WHERE event_type IN ('click', 'error')) AS alert FROM {events} GROUP BY 1""")
def n5_hit_ratio_5_minutes(spark, sf_dir):
    found = ev.hit_ratio(view(spark, sf_dir, "events"), F.col("event_type") == "click", F.col("event_type") == "error", "5 minutes")
    return found.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "hits", "misses", F.coalesce("alert", F.lit(False)).alias("alert"))
