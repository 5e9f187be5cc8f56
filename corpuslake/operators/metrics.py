"""Jobs, quotas, metric samples and governance tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def list_jobs(jobs: DataFrame, status: str | None = None, limit: int = 100) -> DataFrame:
    """Jobs of a status by priority and age, or all, newest first."""
    if status is None:
        return jobs.orderBy(F.desc("created_at"), "job_id").limit(limit)
    return jobs.where(F.col("status") == status).orderBy(F.desc("priority"), "created_at", "job_id").limit(limit)


def progress(jobs: DataFrame) -> DataFrame:
    """Percent done, seconds a file and seconds left of each job; null where nothing is done yet."""
    rate = F.try_divide(F.col("elapsed_s"), F.col("processed_files").cast("double"))
    percent = F.round(100 * F.col("processed_files") / F.col("total_files"), 4)
    return jobs.select("job_id", percent.alias("percent"), F.round((F.col("total_files") - F.col("processed_files")) * rate, 4).alias("eta_s"))


#: Limits in the order in which they are checked: name, what is compared, whether reaching it is too much, and the message.
LIMITS = (
    ("max_files_per_upload", "files_count", False, "Upload would exceed max files per upload: %s > %s"),
    ("max_bytes_per_upload", "bytes_total", False, "Upload would exceed max bytes per upload: %s > %s"),
    ("max_bytes_per_file", "file_bytes", False, "File exceeds max bytes per file: %s > %s"),
    ("max_documents_per_index", "total_documents", True, "Index at capacity: %s >= %s max documents"),
    ("max_chunks_per_index", "total_chunks", True, "Index at capacity: %s >= %s max chunks"),
    ("max_chars_per_index", "total_chars", True, "Index at capacity: %s >= %s max characters"),
)


def check_quota(requests: DataFrame, limits: dict[str, int | None]) -> DataFrame:
    """``requests`` with ok and message: the first limit that is violated. A limit that is None is none."""
    message = F.lit(None).cast("string")
    for name, value, reached, text in reversed(LIMITS):
        most = limits.get(name)
        if most is not None:
            over = F.col(value) >= most if reached else F.col(value) > most
            message = F.when(over, F.format_string(text.replace("%s", "%d"), F.col(value).cast("long"), F.lit(most).cast("long"))).otherwise(message)
    return requests.withColumn("message", F.coalesce(message, F.lit(""))).withColumn("ok", F.col("message") == "")


def running_usage(batches: DataFrame, order: str, values: Sequence[str], parts: Sequence[str]) -> DataFrame:
    """Totals of each part of ``batches`` up to and with each row in ``order``."""
    w = Window.partitionBy(*parts).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return batches.select(*parts, order, *[F.sum(v).over(w).alias(f"total_{v}") for v in values])


def human(n: Column) -> Column:
    """Counts with K and M beyond a thousand and a million."""
    text = lambda unit, by: F.concat(F.format_string("%.1f", F.bround(n / by, 1)), F.lit(unit))
    return F.when(n >= 1_000_000, text("M", 1_000_000.0)).when(n >= 1_000, text("K", 1_000.0)).otherwise(n.cast("string"))


def counter_rate(samples: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    """Increase a second of counters (ts, label, value) in windows; a fall is a restart from zero."""
    before = F.lag("value").over(Window.partitionBy("label").orderBy("ts", "id"))
    step = F.when(before.isNull(), 0.0).when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before)
    grown = samples.withColumn("step", step).groupBy("label", F.window(F.col("ts").cast("timestamp"), width, slide).alias("w")).agg(F.sum("step").alias("increase"))
    seconds = F.unix_timestamp("w.end") - F.unix_timestamp("w.start")
    return grown.select("label", F.col("w.start").alias("start"), (F.col("increase") / seconds).alias("rate"))


def bucket_counts(samples: DataFrame, label: str, value: str, bounds: Sequence[float]) -> DataFrame:
    """Cumulative histogram (label, le, n) of observations; the last bound is infinity."""
    le = None
    for b in bounds:
        le = F.when(F.col(value) <= b, F.lit(float(b))) if le is None else le.when(F.col(value) <= b, F.lit(float(b)))
    counts = samples.groupBy(label, le.otherwise(F.lit(float("inf"))).alias("le")).agg(F.count(F.lit(1)).alias("own"))
    edges = F.explode(F.array(*[F.lit(float(b)) for b in (*bounds, float("inf"))])).alias("le")
    full = samples.select(label).distinct().select(label, edges).join(counts, [label, "le"], "left")
    w = Window.partitionBy(label).orderBy("le").rowsBetween(Window.unboundedPreceding, 0)
    return full.select(label, "le", F.sum(F.coalesce("own", F.lit(0))).over(w).alias("n"))


def histogram_quantile(buckets: DataFrame, label: str, q: float) -> DataFrame:
    """Quantile of cumulative buckets by linear interpolation inside the bucket it falls in; in
    the last one its lower bound."""
    w = Window.partitionBy(label).orderBy("le")
    b = buckets.withColumn("before", F.coalesce(F.lag("n").over(w), F.lit(0))).withColumn("low", F.coalesce(F.lag("le").over(w), F.lit(0.0)))
    rank = q * F.max("n").over(Window.partitionBy(label))
    b = b.withColumn("rank", rank).where((F.col("n") >= F.col("rank")) & (F.col("before") < F.col("rank")))
    inside = F.col("low") + (F.col("le") - F.col("low")) * (F.col("rank") - F.col("before")) / (F.col("n") - F.col("before"))
    return b.select(label, F.when(F.col("le") == float("inf"), F.col("low")).otherwise(inside).alias("quantile"))


def hit_ratio(events: DataFrame, hit: Column, miss: Column, width: str) -> DataFrame:
    """Hits among hits and misses in each window, and whether that is under a half."""
    # A stream's watermark goes with the column itself, not with a cast of it.
    at = F.col("ts") if events.schema["ts"].dataType.typeName() == "timestamp" else F.col("ts").cast("timestamp")
    g = events.groupBy(F.window(at, width).alias("w")).agg(F.count_if(hit).alias("hits"), F.count_if(miss).alias("misses"))
    ratio = F.try_divide(F.col("hits"), F.col("hits") + F.col("misses"))
    return g.select(F.col("w.start").alias("start"), "hits", "misses", ratio.alias("ratio"), (ratio < 0.5).alias("alert"))


def trailing(events: DataFrame, key: str, seconds: int, limit: int) -> DataFrame:
    """Requests of each key in the ``seconds`` up to each request, what is left of ``limit``, and the share used."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy(key).orderBy("us").rangeBetween(-seconds * 1_000_000, 0)
    used = events.withColumn("us", at).withColumn("used", F.count(F.lit(1)).over(w))
    return used.withColumn("remaining", F.greatest(F.lit(0).cast("long"), limit - F.col("used"))).withColumn("ratio", F.col("used") / limit).drop("us")


def redact(lines: Column, extra: Sequence[str] = ()) -> Column:
    """``KEY=value`` lines whose key looks secret get a placeholder value; others stay."""
    key = F.trim(F.regexp_extract(lines, "^([^=]*)=", 1))
    secret = F.lower(key).rlike("password|secret|token|key") | key.isin(*extra, "")
    setting = lines.contains("=") & ~F.trim(lines).startswith("#")
    return F.when(setting & secret & (key != ""), F.concat(key, F.lit("=<REPLACE_ME>"))).otherwise(lines)


def manifest_check(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, state): ok, mismatch, missing, or unexpected."""
    both = expected.select("path", F.col("sha256").alias("want")).join(actual.select("path", F.col("sha256").alias("got")), "path", "full_outer")
    state = F.when(F.col("got").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when(F.col("want") == F.col("got"), "ok").otherwise("mismatch")
    return both.select("path", state.alias("state"))


def erase(users: DataFrame, keys: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Users, keys and requests after the approved erasure requests are carried out."""
    who = requests.where("status = 'approved'").select("user_id").distinct()
    gone = who.withColumn("gone", F.lit(True))
    marked = users.join(gone, "user_id", "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    anonymous = F.concat(F.lit("deleted-user-"), F.substring(F.sha2(F.col("user_id").cast("string"), 256), 1, 8))
    marked = marked.withColumn("username", F.when(F.col("gone"), anonymous).otherwise(F.col("username"))).withColumn("is_active", F.col("is_active") & ~F.col("gone")).drop("gone")
    done = requests.withColumn("status", F.when(F.col("status") == "approved", "completed").otherwise(F.col("status")))
    return marked, keys.join(who, "user_id", "left_anti"), done
