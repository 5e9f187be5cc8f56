"""Query-log analytics: frames of (id, ts, query_text, result_count, max_score, latency_ms,
filters, version_filter). Ties in every order are broken by the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def log_rows(requests: DataFrame, hits: DataFrame) -> DataFrame:
    """One log row for each request: hits counted, best, worst and mean score; null scores when none."""
    scores = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("max_score"), F.min("score").alias("min_score"), F.avg("score").alias("avg_score"))
    return requests.join(scores, "query_id", "left").withColumn("result_count", F.coalesce("n", F.lit(0)).cast("long")).drop("n")


def recent(log: DataFrame, limit: int) -> DataFrame:
    return log.orderBy(F.desc("ts"), F.desc("id")).limit(limit)


def within(log: DataFrame, days: int, now) -> DataFrame:
    """Rows of the last ``days`` days before ``now``; all rows if ``days`` is 0."""
    return log.where(F.col("ts") >= F.lit(now) - F.expr(f"INTERVAL {int(days)} DAYS")) if days else log


def repeated_texts(log: DataFrame, limit: int | None = None) -> DataFrame:
    """Texts asked more than once, most often first."""
    found = log.groupBy("query_text").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "query_text")
    return found.limit(limit) if limit else found


def low_scores(log: DataFrame, threshold: float) -> DataFrame:
    return log.where((F.col("max_score") < threshold) & (F.col("result_count") > 0)).orderBy("max_score", "id")


def without_results(log: DataFrame, more_than: int = 0) -> DataFrame:
    """Texts that found nothing, and how often, if more than ``more_than`` times."""
    return log.where("result_count = 0").groupBy("query_text").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > more_than)


def latency_percentiles(log: DataFrame) -> DataFrame:
    """Exact p50, p95 and p99 by linear interpolation, one decimal; zeros for an empty log."""
    p = F.percentile("latency_ms", F.array(*[F.lit(x) for x in (0.5, 0.95, 0.99)]))
    return log.agg(p.alias("p")).select(*[F.round(F.coalesce(F.get("p", F.lit(i)), F.lit(0.0)), 1).alias(c) for i, c in enumerate(("p50", "p95", "p99"))])


def stats(log: DataFrame) -> DataFrame:
    mean = lambda c, d: F.round(F.coalesce(F.avg(c), F.lit(0.0)), d)
    return log.agg(F.count(F.lit(1)).alias("n"), mean("result_count", 4).alias("avg_results"), mean("latency_ms", 4).alias("avg_latency"), mean("max_score", 4).alias("avg_top_score"))


def keep_since(log: DataFrame, cutoff) -> DataFrame:
    """Retention: rows at or after ``cutoff``."""
    return log.where(F.col("ts") >= F.lit(cutoff))


def by_presence(log: DataFrame, column: str, *aggs: Column) -> DataFrame:
    """Aggregates of rows with and without a value in ``column``."""
    return log.groupBy(F.when(F.col(column).isNotNull(), "with").otherwise("without").alias("kind")).agg(*aggs)


def filter_usage(log: DataFrame, path: str = "$.product") -> DataFrame:
    return log.where("filters IS NOT NULL").groupBy(F.get_json_object("filters", path).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def per_hour(log: DataFrame) -> DataFrame:
    return log.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("latency_ms"), 4).alias("avg_latency"))


def daily_health(log: DataFrame) -> DataFrame:
    return log.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("latency_ms"), 4).alias("avg_latency"), F.count_if(F.col("result_count") == 0).alias("zero_results"))


def operation_percentiles(samples: DataFrame, last: int = 1000) -> DataFrame:
    """p50, p95 and p99 of each operation's ``last`` samples by time (operation, ts, id, latency_ms).

    The latest samples are found by rank inside salted parts first, so an operation with most
    of the rows is not ranked in one task.
    """
    salt = Window.partitionBy("operation", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy(F.desc("ts"), F.desc("id"))
    order = Window.partitionBy("operation").orderBy(F.desc("ts"), F.desc("id"))
    part = samples.withColumn("r", F.row_number().over(salt)).where(F.col("r") <= last)
    top = part.withColumn("r", F.row_number().over(order)).where(F.col("r") <= last)
    p = F.percentile("latency_ms", F.array(*[F.lit(x) for x in (0.5, 0.95, 0.99)]))
    return top.groupBy("operation").agg(p.alias("p")).select("operation", *[F.round(F.get("p", F.lit(i)), 4).alias(c) for i, c in enumerate(("p50", "p95", "p99"))])


def repeats_within(log: DataFrame, seconds: int, *key: str) -> DataFrame:
    """Share of requests that repeat one of the last ``seconds`` seconds with the same key."""
    before = F.lag("ts").over(Window.partitionBy(*key).orderBy("ts", "id"))
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(before.cast("timestamp"))
    marked = log.select(F.coalesce(gap <= seconds * 1_000_000, F.lit(False)).alias("hit"))
    return marked.agg(F.count(F.lit(1)).alias("requests"), F.count_if("hit").alias("repeats"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("share"))


def last_n_percentiles(samples: DataFrame, last: int = 1000) -> DataFrame:
    """Count and p50, p95 and p99 (the least value that at least that share of the values does not
    exceed) of the last ``last`` samples (operation, ts, id, value) of each operation."""
    recent_ = samples.withColumn("r", F.row_number().over(Window.partitionBy("operation").orderBy(F.desc("ts"), F.desc("id")))).where(F.col("r") <= last)
    held = recent_.groupBy("operation").agg(F.array_sort(F.collect_list("value")).alias("held"))
    at = lambda p: F.element_at("held", F.ceil(F.lit(p) * F.size("held")).cast("int"))
    return held.select("operation", F.size("held").cast("long").alias("n"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))
