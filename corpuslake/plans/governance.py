"""Queries over jobs, quotas, metric samples and governance tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslake.operators import metrics, tables
from corpuslake.plans.registry import query
from corpuslake.plans.views import view

_STATUSES = ["pending", "running", "paused", "completed", "failed", "cancelled"]


@query("SELECT job_id, priority FROM {jobs} WHERE status = 'pending' ORDER BY priority DESC, created_at, job_id LIMIT 100")
def m1_list_jobs(spark, sf_dir):
    return metrics.list_jobs(view(spark, sf_dir, "jobs"), "pending").select("job_id", "priority")


@query(f"SELECT s.status, count(j.job_id) AS n FROM (SELECT unnest({_STATUSES}) AS status) s LEFT JOIN {{jobs}} j ON s.status = j.status AND j.priority = 5 GROUP BY 1")
def m2_queue_stats(spark, sf_dir):
    return tables.status_counts(view(spark, sf_dir, "jobs").where("priority = 5"), _STATUSES)


@query("""SELECT job_id, round(100 * processed_files / total_files::DOUBLE, 4) AS percent,
  CASE WHEN processed_files > 0 THEN round((total_files - processed_files) * (elapsed_s / processed_files), 4) END AS eta_s FROM {jobs}""")
def m3_job_progress(spark, sf_dir):
    return metrics.progress(view(spark, sf_dir, "jobs"))


@query("SELECT job_id, status FROM {jobs} WHERE NOT (status = 'completed' AND created_at < TIMESTAMP '1998-01-01 00:00:00')")
def m4_prune_jobs(spark, sf_dir):
    jobs = view(spark, sf_dir, "jobs")
    return jobs.where("NOT (status = 'completed' AND created_at < TIMESTAMP_NTZ '1998-01-01 00:00:00')").select("job_id", "status")


@query("SELECT count(*) AS jobs, count(*) FILTER (WHERE status IN ('pending', 'running', 'paused')) AS active, CAST(sum(total_files) AS BIGINT) AS files FROM {jobs}")
def m5_db_stats(spark, sf_dir):
    return view(spark, sf_dir, "jobs").agg(F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("status").isin("pending", "running", "paused")).alias("active"), F.sum("total_files").alias("files"))


@query("""SELECT product, CASE WHEN files > 100 THEN 'Upload would exceed max files per upload: ' || files || ' > 100' WHEN bytes > 250000 THEN 'Upload would exceed max bytes per upload: ' || bytes || ' > 250000'
  WHEN largest > 15000 THEN 'File exceeds max bytes per file: ' || largest || ' > 15000' WHEN chunks >= 400 THEN 'Index at capacity: ' || chunks || ' >= 400 max chunks' ELSE '' END AS message
FROM (SELECT product, count(*) AS files, CAST(sum(file_size) AS BIGINT) AS bytes, max(file_size) AS largest, CAST(sum(chunks) AS BIGINT) AS chunks FROM {registry} GROUP BY 1)""")
def m6_check_quota(spark, sf_dir):
    use = view(spark, sf_dir, "registry").groupBy("product").agg(
        F.count(F.lit(1)).alias("files_count"), F.sum("file_size").alias("bytes_total"), F.max("file_size").alias("file_bytes"), F.sum("chunks").alias("total_chunks"))
    limits = {"max_files_per_upload": 100, "max_bytes_per_upload": 250_000, "max_bytes_per_file": 15_000, "max_chunks_per_index": 400}
    return metrics.check_quota(use, limits).select("product", "message")


@query("""SELECT product, indexed_at, CAST(sum(files) OVER w AS BIGINT) AS total_files, CAST(sum(bytes) OVER w AS BIGINT) AS total_bytes
FROM (SELECT product, indexed_at, count(*) AS files, sum(file_size) AS bytes FROM {registry} GROUP BY 1, 2) WINDOW w AS (PARTITION BY product ORDER BY indexed_at ROWS UNBOUNDED PRECEDING)""")
def m7_quota_usage(spark, sf_dir):
    batches = view(spark, sf_dir, "registry").groupBy("product", "indexed_at").agg(F.count(F.lit(1)).alias("files"), F.sum("file_size").alias("bytes"))
    return metrics.running_usage(batches, "indexed_at", ["files", "bytes"], ["product"])


@query("""SELECT product, CASE WHEN b >= 1000000 THEN printf('%.1fM', round_even(b / 1000000.0::DOUBLE, 1)) WHEN b >= 1000 THEN printf('%.1fK', round_even(b / 1000.0::DOUBLE, 1)) ELSE CAST(b AS VARCHAR) END AS bytes
FROM (SELECT product, CAST(sum(file_size) AS BIGINT) AS b FROM {registry} GROUP BY 1)""")
def m8_quota_report(spark, sf_dir):
    use = view(spark, sf_dir, "registry").groupBy("product").agg(F.sum("file_size").alias("b"))
    return use.select("product", metrics.human(F.col("b")).alias("bytes"))


@query("""
WITH s AS (SELECT user_id AS label, ts, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM {events})
SELECT label, strftime(time_bucket(INTERVAL '30 minutes', ts), '%Y-%m-%d %H:%M') AS start,
  round(sum(CASE WHEN before IS NULL THEN 0 WHEN value < before THEN value ELSE value - before END) / 1800, 6) AS rate FROM s GROUP BY 1, 2""")
def m9_counter_rate(spark, sf_dir):
    samples = view(spark, sf_dir, "events").select(F.col("user_id").alias("label"), "ts", "value", F.col("event_id").alias("id"))
    return metrics.counter_rate(samples, "30 minutes").select("label", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), F.round("rate", 6).alias("rate"))


_BOUNDS = (5, 10, 25, 50, 100, 250)
_BUCKETS = "SELECT event_type AS label, le, (SELECT count(*) FROM {events} x WHERE x.event_type = e.event_type AND x.value <= le) AS n FROM (SELECT DISTINCT event_type FROM {events}) e, (SELECT unnest([5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 'inf'::DOUBLE]::DOUBLE[]) AS le)"


def _buckets(spark, sf_dir):
    return metrics.bucket_counts(view(spark, sf_dir, "events").withColumnRenamed("event_type", "label"), "label", "value", _BOUNDS)


@query(f"""
WITH b AS ({_BUCKETS}),
w AS (SELECT *, coalesce(lag(n) OVER (PARTITION BY label ORDER BY le), 0) AS before, coalesce(lag(le) OVER (PARTITION BY label ORDER BY le), 0.0) AS low, 0.95::DOUBLE * max(n) OVER (PARTITION BY label) AS rank FROM b)
SELECT label, round(CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (rank - before) / (n - before) END, 6) AS quantile FROM w WHERE n >= rank AND before < rank""")
def m10_histogram_quantile(spark, sf_dir):
    return metrics.histogram_quantile(_buckets(spark, sf_dir), "label", 0.95).select("label", F.round("quantile", 6).alias("quantile"))


@query(f"SELECT label, CASE WHEN isinf(le) THEN '+Inf' ELSE CAST(CAST(le AS INT) AS VARCHAR) END AS le, n FROM ({_BUCKETS})")
def m11_bucketize(spark, sf_dir):
    le = F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.col("le").cast("int").cast("string"))
    return _buckets(spark, sf_dir).select("label", le.alias("le"), "n")


@query("""SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M') AS start, count(*) FILTER (WHERE event_type = 'click') AS hits, count(*) FILTER (WHERE event_type = 'error') AS misses,
  count(*) FILTER (WHERE event_type = 'click') < 0.5 * count(*) FILTER (WHERE event_type IN ('click', 'error')) AS alert FROM {events} GROUP BY 1""")
def m12_hit_ratio(spark, sf_dir):
    found = metrics.hit_ratio(view(spark, sf_dir, "events"), F.col("event_type") == "click", F.col("event_type") == "error", "1 hour")
    return found.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "hits", "misses", F.coalesce("alert", F.lit(False)).alias("alert"))


_RUNS = """
WITH m AS (SELECT {key} AS key, ts, event_id, {flag} AS f, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS r FROM {{events}}),
g AS (SELECT *, r - row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS island FROM m WHERE f)
SELECT key, min(ts) AS first, max(ts) AS last, count(*) AS n FROM g GROUP BY key, island"""


@query(f"SELECT key, strftime(first, '%Y-%m-%d %H:%M:%S') AS since, n FROM ({_RUNS.format(key='user_id', flag='value > 60')}) WHERE last - first >= INTERVAL '10 minutes'")
def m13_sustained_alert(spark, sf_dir):
    runs = tables.runs_of(view(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("value") > 60)
    long = runs.where(F.col("last") - F.col("first") >= F.expr("INTERVAL 10 MINUTES"))
    return long.select(F.col("user_id").alias("key"), F.date_format("first", "yyyy-MM-dd HH:mm:ss").alias("since"), "n")


@query("""SELECT event_id, used, greatest(0, 6 - used) AS remaining, used / 6.0::DOUBLE AS ratio FROM (
  SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '60 seconds' PRECEDING AND CURRENT ROW) AS used FROM {events})""")
def m14_provider_usage(spark, sf_dir):
    return metrics.trailing(view(spark, sf_dir, "events"), "user_id", 60, 6).select("event_id", "used", "remaining", "ratio")


_ERROR_FLAG = "event_type = 'error'"


@query(f"SELECT key, n FROM ({_RUNS.format(key='user_id', flag=_ERROR_FLAG)}) WHERE n >= 3")
def m15_failure_runs(spark, sf_dir):
    runs = tables.runs_of(view(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")
    return runs.where("n >= 3").select(F.col("user_id").alias("key"), "n")


@query("SELECT event_id, event_type FROM {events} WHERE user_id = 8 AND ts >= TIMESTAMP '2024-01-10 00:00:00' ORDER BY ts DESC, event_id LIMIT 100")
def m16_audit_log_read(spark, sf_dir):
    log = view(spark, sf_dir, "events").where("ts >= TIMESTAMP_NTZ '2024-01-10 00:00:00' AND user_id = 8")
    return tables.newest(log, "ts", "event_id", 100).select("event_id", "event_type")


@query("SELECT event_id FROM {events} WHERE ts >= (SELECT max(ts) FROM {events}) - INTERVAL '5 days'")
def m16_audit_log_prune(spark, sf_dir):
    log = view(spark, sf_dir, "events")
    now = log.agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    return tables.prune_older(log, F.lit(now), 5).select("event_id")


@query("""SELECT u.user_id, u.username, count(k.key_id) AS keys, coalesce(string_agg(k.prefix || ':' || k.key_id, ',' ORDER BY k.key_id), '') AS key_list FROM {users} u LEFT JOIN {api_keys} k ON u.user_id = k.user_id GROUP BY 1, 2""")
def m17_export_user_data(spark, sf_dir):
    keys = view(spark, sf_dir, "api_keys").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("key_id", "prefix"))).alias("k"))
    text = F.array_join(F.transform("k", lambda x: F.concat(x["prefix"], F.lit(":"), x["key_id"].cast("string"))), ",")
    users = view(spark, sf_dir, "users").join(keys, "user_id", "left")
    return users.select("user_id", "username", F.coalesce(F.size("k"), F.lit(0)).cast("long").alias("keys"), F.coalesce(text, F.lit("")).alias("key_list"))


_APPROVED = "user_id IN (SELECT user_id FROM {erasure_requests} WHERE status = 'approved')"


@query(f"""SELECT u.user_id, CASE WHEN {_APPROVED.replace('user_id IN', 'u.user_id IN')} THEN 'deleted-user-' || substr(sha256(CAST(u.user_id AS VARCHAR)), 1, 8) ELSE username END AS username,
  is_active AND NOT ({_APPROVED.replace('user_id IN', 'u.user_id IN')}) AS is_active, count(k.key_id) AS keys
FROM {{users}} u LEFT JOIN (SELECT * FROM {{api_keys}} WHERE NOT {_APPROVED}) k ON u.user_id = k.user_id GROUP BY 1, 2, 3""")
def m18_apply_erasure(spark, sf_dir):
    users, keys, _ = metrics.erase(view(spark, sf_dir, "users"), view(spark, sf_dir, "api_keys"), view(spark, sf_dir, "erasure_requests"))
    n = keys.groupBy("user_id").agg(F.count(F.lit(1)).alias("keys"))
    return users.join(n, "user_id", "left").select("user_id", "username", "is_active", F.coalesce("keys", F.lit(0)).alias("keys"))


@query("SELECT request_id, status FROM {erasure_requests} WHERE user_id = 12")
def m19_erasure_requests_of(spark, sf_dir):
    mine = tables.matching(view(spark, sf_dir, "erasure_requests"), {"user_id": 12})
    return tables.newest(mine, "requested_at", "request_id").select("request_id", "status")


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'API_TOKEN=<REPLACE_ME>' WHEN 1 THEN '# secret=' || o_orderpriority ELSE 'REGION=' || o_orderpriority END AS line FROM {orders}")
def m20_redact_config(spark, sf_dir):
    orders = view(spark, sf_dir, "orders")
    n, value = F.col("o_orderkey") % 3, F.col("o_orderpriority")
    line = F.when(n == 0, F.concat(F.lit("API_TOKEN="), value)).when(n == 1, F.concat(F.lit("# secret="), value)).otherwise(F.concat(F.lit("REGION="), value))
    return orders.select("o_orderkey", metrics.redact(line).alias("line"))


@query("""SELECT path, CASE WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 2 = 0 THEN 'mismatch' ELSE 'ok' END AS state FROM {registry}
UNION ALL SELECT 'new/' || path, 'unexpected' FROM {registry} WHERE doc_id % 7 = 0""")
def m21_manifest_check(spark, sf_dir):
    reg = view(spark, sf_dir, "registry")
    path = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("new/"), "path")).otherwise(F.col("path"))
    actual = reg.select(path.alias("path"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("x"), "sha256")).otherwise(F.col("sha256")).alias("sha256"))
    return metrics.manifest_check(reg.select("path", "sha256"), actual)


@query("SELECT user_id, username FROM {users} WHERE NOT erased")
def m22_list_principals(spark, sf_dir):
    return tables.newest(view(spark, sf_dir, "users").where("NOT erased"), "created_at", "user_id").select("user_id", "username")
