"""Mixing sources to target weights.

Each document gets a hash-random key. Within its source, documents stand in key order,
dealt into buckets by the leading digits of the key (a range partition whose cut points are
known beforehand because the keys are uniform). Prefix sums are taken in two steps, over the
buckets of a source and inside each bucket, so a source that holds a third of all rows is
spread over as many tasks as its rows need. Each source is cut at its exact budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.llm.common import WORD, finished, table, written

#: Rows that one bucket of a source holds on average.
BUCKET_ROWS = 8192


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, source_rows, target) from (source, source_size, source_rows).

    Sources in code-point order, null last, weigh ``weights`` in turn. ``share`` times all
    words are dealt by weight; no target exceeds ``cap`` times its source's size, and what is
    above is dealt again by weight among the others. One row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    w = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", F.lit(cap) * F.col("source_size"))
    w = w.withColumn("fills_at", F.col("cap") / F.col("weight"))
    # Sources fill in the order of cap / weight: levels rise until the first source
    # that stays below its cap and fall after it, so the right one is the largest that its source does not exceed.
    by_fill = Window.orderBy("fills_at", F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    from_here = by_fill.rowsBetween(0, Window.unboundedFollowing)
    everything = by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(from_here)
    w = w.withColumn("level", level)
    w = w.withColumn("level", F.max(F.when(F.col("level") <= F.col("fills_at"), F.col("level"))).over(everything))
    target = F.least(F.col("cap"), F.col("level") * F.col("weight"))
    return w.select("source", "source_size", "source_rows", F.coalesce(target, F.col("cap")).alias("target"))


def sort_key(doc_id: Column, text: Column, seed: int) -> Column:
    """Hash-random, of id and text, so that rows without an id have keys of their own."""
    digest = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), digest).cast("binary"))


def mix_sources(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17, keep=("doc_id",)) -> DataFrame:
    """Deal every source its budget of words.

    Returns the columns ``keep`` of ``docs`` plus source, size, source_size, target, taken
    (words taken, repeats counted), epochs (whole passes over the source) and cut (true for
    the one document per source of which only the first words are taken in the last pass).

    A null text has size 0; null is a source of its own; rows of one id are ordered by a hash of
    their texts, and rows equal in both are interchangeable. Empty input gives empty output. Other columns of
    ``docs`` are ignored unless named in ``keep``.
    """
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    names = list(dict.fromkeys(keep))
    kept = F.struct(*[F.col(c) for c in names]).alias("kept")
    slim = ["source", size, sort_key(F.col("doc_id"), F.col("text"), seed).alias("key"), F.col("doc_id").alias("tie")]
    # Sizes and keys are made once, unless the texts are to be returned: those are moved only once then.
    whole = docs.select(kept, *slim)
    sized = written(whole.drop("kept") if "text" in names else whole, "sizes")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    # The two small tables are stored, so that Spark knows their sizes and moves the texts only
    # once, to their buckets, unless there are very many sources.
    targets = written(source_targets(per_source, weights, share, cap).withColumnRenamed("source", "of"), "targets")
    unit = F.conv(F.substring("key", 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))

    def dealt(rows: DataFrame) -> DataFrame:
        rows = rows.join(targets, F.col("source").eqNullSafe(F.col("of")), "inner").drop("of")
        return rows.withColumn("bucket", F.floor(unit * F.ceil(F.col("source_rows") / BUCKET_ROWS)))

    # Words before each bucket of a source: one small row for each bucket.
    buckets = dealt(sized).groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = written(buckets.select(F.col("source").alias("of"), F.col("bucket").alias("nth"), F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead")), "buckets")
    rows = dealt(whole if "text" in names else sized)
    inside = Window.partitionBy("source", "bucket").orderBy("key", "tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(buckets, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("nth")), "inner")
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = budget - epochs * F.col("source_size") - F.col("before") - F.col("ahead")
    last = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left))
    return rows.select(
        *[F.col(f"kept.{c}").alias(c) for c in names if c != "source"],
        "source", "size", "source_size", "target",
        (epochs * F.col("size") + last).alias("taken"),
        epochs.alias("epochs"),
        ((last > 0) & (last < F.col("size"))).alias("cut"),
    )


def op6_source_mixing(spark, sf_dir: str) -> DataFrame:
    found = finished("mix", lambda: mix_sources(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
per_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3, 1, 2][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight
  FROM sized GROUP BY source),
filled AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS fills_at FROM per_source),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - coalesce(sum(cap) OVER (ORDER BY fills_at, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
            / sum(weight) OVER (ORDER BY fills_at, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own_level
  FROM filled),
targets AS (
  SELECT source, source_size,
         coalesce(least(cap, max(CASE WHEN own_level <= fills_at THEN own_level END) OVER () * weight), cap) AS target
  FROM levels),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
         CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
counted AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM placed)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken
FROM counted
"""
