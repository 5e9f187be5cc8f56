"""Queries over the query log."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from corpuslake.operators import logs
from corpuslake.plans.registry import query
from corpuslake.plans.views import view

#: The moment that the queries take as the present.
NOW = dt.datetime(2024, 1, 31)


@query("""
WITH s AS (SELECT query_id, count(*) AS n, max(score) AS max_score, min(score) AS min_score, avg(score) AS avg_score FROM {retrieved} WHERE score > 0.95 GROUP BY 1)
SELECT vec_id AS query_id, label, coalesce(n, 0) AS result_count, max_score, min_score, round(avg_score, 6) AS avg_score FROM {embeddings} LEFT JOIN s ON vec_id = query_id""")
def l1_log_rows(spark, sf_dir):
    requests = view(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "label")
    found = logs.log_rows(requests, view(spark, sf_dir, "retrieved").where("score > 0.95"))
    return found.select("query_id", "label", "result_count", "max_score", "min_score", F.round("avg_score", 6).alias("avg_score"))


@query("SELECT id, query_text, latency_ms FROM {query_log} ORDER BY ts DESC, id DESC LIMIT 100")
def l2_recent_queries(spark, sf_dir):
    return logs.recent(view(spark, sf_dir, "query_log"), 100).select("id", "query_text", "latency_ms")


@query("""SELECT query_text, count(*) AS n FROM {query_log} WHERE ts >= TIMESTAMP '2024-01-24 00:00:00' GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, query_text LIMIT 10""")
def l3_most_common_queries(spark, sf_dir):
    return logs.repeated_texts(logs.within(view(spark, sf_dir, "query_log"), 7, NOW), 10)


@query("SELECT id, query_text, max_score FROM {query_log} WHERE max_score < 0.7 AND result_count > 0")
def l4_low_score_queries(spark, sf_dir):
    return logs.low_scores(view(spark, sf_dir, "query_log"), 0.7).select("id", "query_text", "max_score")


@query("SELECT query_text, count(*) AS n FROM {query_log} WHERE result_count = 0 GROUP BY 1")
def l5_zero_result_queries(spark, sf_dir):
    return logs.without_results(view(spark, sf_dir, "query_log"))


@query("""SELECT round(quantile_cont(latency_ms, 0.5), 1) AS p50, round(quantile_cont(latency_ms, 0.95), 1) AS p95, round(quantile_cont(latency_ms, 0.99), 1) AS p99
FROM {query_log} WHERE ts >= TIMESTAMP '2024-01-24 00:00:00'""")
def l6_latency_percentiles(spark, sf_dir):
    return logs.latency_percentiles(logs.within(view(spark, sf_dir, "query_log"), 7, NOW))


@query("SELECT count(*) AS n, round(avg(result_count), 4) AS avg_results, round(avg(latency_ms), 4) AS avg_latency, round(avg(max_score), 4) AS avg_top_score FROM {query_log}")
def l7_query_stats(spark, sf_dir):
    return logs.stats(view(spark, sf_dir, "query_log"))


@query("SELECT id, ts, query_text FROM {query_log} WHERE ts >= TIMESTAMP '2024-01-11 00:00:00'")
def l8_prune_query_log(spark, sf_dir):
    return logs.keep_since(view(spark, sf_dir, "query_log"), NOW - dt.timedelta(days=20)).select("id", "ts", "query_text")


@query("""SELECT CASE WHEN filters IS NOT NULL THEN 'with' ELSE 'without' END AS kind, round(avg(latency_ms), 4) AS avg_latency, max(latency_ms) AS max_latency, count(*) AS n
FROM {query_log} GROUP BY 1""")
def l9_latency_by_filtered(spark, sf_dir):
    return logs.by_presence(view(spark, sf_dir, "query_log"), "filters", F.round(F.avg("latency_ms"), 4).alias("avg_latency"), F.max("latency_ms").alias("max_latency"), F.count(F.lit(1)).alias("n"))


@query("SELECT id, query_text, latency_ms FROM {query_log} WHERE latency_ms > 1000")
def l10_slow_queries(spark, sf_dir):
    return view(spark, sf_dir, "query_log").where("latency_ms > 1000").orderBy(F.desc("latency_ms"), "id").select("id", "query_text", "latency_ms")


@query("SELECT json_extract_string(filters, '$.product') AS value, count(*) AS n FROM {query_log} WHERE filters IS NOT NULL GROUP BY 1")
def l11_filter_usage(spark, sf_dir):
    return logs.filter_usage(view(spark, sf_dir, "query_log"))


@query("SELECT version_filter, count(*) AS n, round(avg(result_count), 4) AS avg_results FROM {query_log} WHERE version_filter IS NOT NULL GROUP BY 1")
def l12_version_filter_usage(spark, sf_dir):
    log = view(spark, sf_dir, "query_log").where("version_filter IS NOT NULL")
    return log.groupBy("version_filter").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("result_count"), 4).alias("avg_results"))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, count(*) AS n, round(avg(latency_ms), 4) AS avg_latency FROM {query_log} GROUP BY 1")
def l13_queries_per_hour(spark, sf_dir):
    return logs.per_hour(view(spark, sf_dir, "query_log")).withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH:mm"))


@query("SELECT query_text, count(*) AS n FROM {query_log} WHERE result_count = 0 GROUP BY 1 HAVING count(*) > 2")
def l14_content_gaps(spark, sf_dir):
    return logs.without_results(view(spark, sf_dir, "query_log"), 2)


@query("SELECT query_text, round(avg(latency_ms), 4) AS avg_latency, count(*) AS n FROM {query_log} GROUP BY 1 HAVING avg(latency_ms) > 500")
def l15_consistently_slow(spark, sf_dir):
    log = view(spark, sf_dir, "query_log").groupBy("query_text").agg(F.avg("latency_ms").alias("a"), F.count(F.lit(1)).alias("n"))
    return log.where("a > 500").select("query_text", F.round("a", 4).alias("avg_latency"), "n")


@query("""SELECT CASE WHEN version_filter IS NOT NULL THEN 'with' ELSE 'without' END AS kind, round(avg(max_score), 4) AS avg_top_score, round(avg(result_count), 4) AS avg_results
FROM {query_log} GROUP BY 1""")
def l16_version_filter_effect(spark, sf_dir):
    return logs.by_presence(view(spark, sf_dir, "query_log"), "version_filter", F.round(F.avg("max_score"), 4).alias("avg_top_score"), F.round(F.avg("result_count"), 4).alias("avg_results"))


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(avg(latency_ms), 4) AS avg_latency, count(*) FILTER (WHERE result_count = 0) AS zero_results FROM {query_log} GROUP BY 1""")
def l17_daily_health(spark, sf_dir):
    return logs.daily_health(view(spark, sf_dir, "query_log")).withColumn("day", F.col("day").cast("string"))


@query("""
WITH r AS (SELECT event_type AS operation, value AS latency_ms, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM {events})
SELECT operation, round(quantile_cont(latency_ms, 0.5), 4) AS p50, round(quantile_cont(latency_ms, 0.95), 4) AS p95, round(quantile_cont(latency_ms, 0.99), 4) AS p99
FROM r WHERE r <= 1000 GROUP BY 1""")
def l18_operation_percentiles(spark, sf_dir):
    events = view(spark, sf_dir, "events").select(F.col("event_type").alias("operation"), "ts", F.col("event_id").alias("id"), F.col("value").alias("latency_ms"))
    return logs.operation_percentiles(events)


@query("""
WITH g AS (SELECT epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY query_text, coalesce(filters, '') ORDER BY ts, id)) AS gap FROM {query_log})
SELECT count(*) AS requests, count(*) FILTER (WHERE gap <= 300000000) AS repeats, round(avg(CASE WHEN gap <= 300000000 THEN 1 ELSE 0 END), 6) AS share FROM g""")
def l19_repeat_within_ttl(spark, sf_dir):
    log = view(spark, sf_dir, "query_log").withColumn("f", F.coalesce("filters", F.lit("")))
    return logs.repeats_within(log, 300, "query_text", "f")
