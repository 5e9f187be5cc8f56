"""Retrieval metrics and experiments.

Frames: hits (query_id, item, rank from 1, relevant), expected (query_id, item) and runs
(run_id, metric, value, ts). Queries without a hit count with zero.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.sources.stored import written


def mark_relevant(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """``hits`` with relevant: whether the item is expected for its query."""
    want = expected.select("query_id", "item").distinct().withColumn("relevant", F.lit(True))
    return hits.join(want, ["query_id", "item"], "left").withColumn("relevant", F.coalesce("relevant", F.lit(False)))


def recall_at_k(hits: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """(query_id, recall): share of expected items among the first ``k``."""
    want = expected.select("query_id", "item").distinct()
    found = hits.where(F.col("rank") <= k).select("query_id", "item").distinct().withColumn("found", F.lit(1))
    return want.join(found, ["query_id", "item"], "left").groupBy("query_id").agg(F.avg(F.coalesce("found", F.lit(0))).alias("recall"))


def reciprocal_rank(hits: DataFrame) -> DataFrame:
    """(query_id, rr): one over the rank of the first relevant item anywhere in the list, or 0."""
    return hits.groupBy("query_id").agg(F.coalesce(1.0 / F.min(F.when(F.col("relevant"), F.col("rank"))), F.lit(0.0)).alias("rr"))


def ndcg_at_k(hits: DataFrame, k: int) -> DataFrame:
    """(query_id, ndcg): binary gains of the first ``k``, against the best order of the same list."""
    top = hits.where(F.col("rank") <= k)
    gain = F.sum(F.when(F.col("relevant"), 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0))
    g = top.groupBy("query_id").agg(gain.alias("dcg"), F.count_if("relevant").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("n").cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return g.select("query_id", F.when(F.col("n") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"))


def ir_metrics(hits: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """One row of recall, mrr and ndcg over all queries, four decimals; zeros for no query."""
    each = recall_at_k(hits, expected, k).join(reciprocal_rank(hits), "query_id", "full_outer").join(ndcg_at_k(hits, k), "query_id", "full_outer")
    mean = lambda c: F.round(F.coalesce(F.avg(F.coalesce(c, F.lit(0.0))), F.lit(0.0)), 4)
    return each.agg(mean("recall").alias("recall"), mean("rr").alias("mrr"), mean("ndcg").alias("ndcg"))


def hit_rate(hits: DataFrame, golden: DataFrame) -> DataFrame:
    """Share of golden questions (query_id, item) whose item is among the hits."""
    found = golden.join(hits.select("query_id", "item").distinct().withColumn("hit", F.lit(1)), ["query_id", "item"], "left")
    return found.agg(F.round(F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(0.0)), 4).alias("hit_rate"))


def golden_mrr(hits: DataFrame, golden: DataFrame) -> DataFrame:
    first = golden.join(hits, ["query_id", "item"], "left").groupBy("query_id").agg(F.coalesce(1.0 / F.min("rank"), F.lit(0.0)).alias("rr"))
    return first.agg(F.round(F.coalesce(F.avg("rr"), F.lit(0.0)), 4).alias("mrr"))


def median_top_score(hits: DataFrame) -> DataFrame:
    """Median over queries of the best score; queries without hits are left out."""
    return hits.groupBy("query_id").agg(F.max("score").alias("s")).agg(F.round(F.percentile("s", F.lit(0.5)), 6).alias("p50"))


#: Least values that pass, and for zero results the most.
VERDICT = {"hit_rate": 0.70, "mrr": 0.50, "zero_share": 0.10, "p50": 0.45}


def verdict(queries: DataFrame, hits: DataFrame, golden: DataFrame) -> DataFrame:
    """hit_rate, mrr, zero_share, p50 and passed, in one row."""
    none = queries.join(hits.select("query_id").distinct(), "query_id", "left_anti").agg(F.count(F.lit(1)).alias("none"))
    all_ = queries.agg(F.count(F.lit(1)).alias("all"))
    row = hit_rate(hits, golden).join(golden_mrr(hits, golden)).join(median_top_score(hits)).join(none).join(all_)
    row = row.withColumn("zero_share", F.round(F.coalesce(F.try_divide("none", "all"), F.lit(0.0)), 4)).drop("none", "all")
    v = VERDICT
    ok = (F.col("hit_rate") >= v["hit_rate"]) & (F.col("mrr") >= v["mrr"]) & (F.col("zero_share") <= v["zero_share"]) & (F.coalesce("p50", F.lit(0.0)) >= v["p50"])
    return row.withColumn("passed", ok)


def judge_prompts(examples: DataFrame) -> DataFrame:
    """(query_id, metric, prompt) for examples (query_id, question, answer, truth, contexts)."""
    plain = F.array_join("contexts", "\n---\n")
    numbered = F.array_join(F.transform("contexts", lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c)), "\n")
    ask = lambda task, *parts: F.concat(F.lit(task), *[x for name, c in parts for x in (F.lit(f"\n\n{name}:\n"), c)], F.lit("\n\nReply with one number from 0.0 to 1.0."))
    made = {
        "faithfulness": ask("How far does the context support the answer?", ("Context", plain), ("Answer", F.col("answer"))),
        "answer_relevancy": ask("How far does the answer address the question?", ("Question", F.col("question")), ("Answer", F.col("answer"))),
        "context_precision": ask("What share of the contexts bears on the question?", ("Question", F.col("question")), ("Contexts", numbered)),
        "context_recall": ask("What share of the expected answer do the contexts hold?", ("Question", F.col("question")), ("Expected answer", F.col("truth")), ("Contexts", numbered)),
    }
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("prompt")) for k, v in made.items()])).alias("p")
    return examples.select("query_id", each).select("query_id", "p.*")


def overlap_judge(prompt: str) -> str:
    """A stand-in for a model: the share of the words of the last part that the others have."""
    parts = prompt.lower().split("\n\n")[1:-1]
    last = set(parts[-1].split()) if parts else set()
    rest = {w for p in parts[:-1] for w in p.split()}
    return f"{len(last & rest) / len(last):.4f}" if last else "no"


#: Prompts that a judge gets at a time.
JUDGE_BATCH = 20


def judge(prompts: DataFrame, reply: Callable[[str], str] = overlap_judge, invoke_batch: Callable[[list[str]], list[str]] | None = None, batch: int = JUDGE_BATCH) -> DataFrame:
    """``prompts`` with the reply of a judge and error, asked in batches. Where ``invoke_batch`` is given it gets a batch at
    once; a batch that it fails on is asked one by one by ``reply``, and a prompt that this fails on has no reply."""
    def one(p: str) -> tuple[str | None, str | None]:
        try:
            return reply(p), None
        except Exception as e:  # a model's own failures
            return None, f"{type(e).__name__}: {e}"[:200]

    def several(part: list[str]) -> list[tuple[str | None, str | None]]:
        if invoke_batch is not None:
            try:
                found = invoke_batch(part)
                if len(found) == len(part):
                    return [(r, None) for r in found]
            except Exception:  # asked again below, one by one
                pass
        return [one(p) for p in part]

    @F.pandas_udf("reply string, error string")
    def run(s: pd.Series) -> pd.DataFrame:
        asked = s.tolist()
        return pd.DataFrame([x for at in range(0, len(asked), batch) for x in several(asked[at : at + batch])], columns=["reply", "error"])

    return prompts.withColumn("__r", run("prompt")).select(*prompts.columns, "__r.reply", "__r.error")


# Words that are scores, in the order in which they are looked for.
SCORE_WORDS = {"yes": 1.0, "true": 1.0, "correct": 1.0, "supported": 1.0, "no": 0.0, "false": 0.0, "incorrect": 0.0, "unsupported": 0.0, "high": 0.8, "medium": 0.5, "low": 0.2, "partial": 0.5}


def parse_score(reply: Column) -> Column:
    """Score from 0 to 1 in free text: a word, a percentage, a decimal, or a whole number out of
    1, 10 or 100; else 0.5."""
    words = F.split(F.lower(F.trim(reply)), r"\s+")
    out = None
    for w, s in SCORE_WORDS.items():
        hit = F.array_contains(words, w)
        out = F.when(hit, F.lit(s)) if out is None else out.when(hit, F.lit(s))
    number = lambda p: F.nullif(F.regexp_extract(reply, p, 1), F.lit("")).cast("double")
    percent, decimal, whole = number(r"(\d+(?:\.\d+)?)\s*%"), number(r"\b(\d?\.\d+)\b"), number(r"\b(\d+)\b")
    out = out.when(percent.isNotNull(), F.least(F.lit(1.0), percent / 100)).when(decimal <= 1, decimal).when(decimal <= 100, decimal / 100)
    return out.when(whole <= 1, whole).when(whole <= 10, whole / 10).when(whole <= 100, whole / 100).otherwise(0.5)


def metric_stats(values: DataFrame) -> DataFrame:
    """Mean, least, most and number of the values of each metric."""
    return values.groupBy("metric").agg(F.round(F.avg("value"), 4).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.count(F.lit(1)).alias("n"))


def runs_wide(runs: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row for each run with a column for each metric."""
    return runs.groupBy("run_id").pivot("metric", list(metrics)).agg(F.first("value"))


def compare_runs(runs: DataFrame, baseline: str, chosen: Sequence[str]) -> DataFrame:
    """Values of the chosen runs beside the baseline's, and the difference; unknown runs are left out."""
    base = runs.where(F.col("run_id") == baseline).select("metric", F.col("value").alias("base"))
    return runs.where(F.col("run_id").isin(*chosen)).join(base, "metric", "left").select("run_id", "metric", "value", "base", F.round(F.col("value") - F.col("base"), 6).alias("delta"))


def baseline_of(runs: DataFrame) -> DataFrame:
    """The run called ``baseline``, else the oldest."""
    order = Window.orderBy(F.desc(F.col("run_id") == "baseline"), "ts", "run_id")
    each = runs.groupBy("run_id").agg(F.min("ts").alias("ts"))
    return each.withColumn("r", F.row_number().over(order)).where("r = 1").select("run_id")


# Named weights of dense and sparse search, and whether hits are reranked.
SCORING_VARIANTS = {"dense_only": (1.0, 0.0, False), "hybrid_default": (0.7, 0.3, True), "hybrid_dense_heavy": (0.9, 0.1, True), "sparse_heavy": (0.3, 0.7, False)}


#: Chunks of an experiment that a provider gets at a time.
EMBED_BATCH = 512


def chunking_experiment(docs: DataFrame, queries: DataFrame, expected: DataFrame, strategy: str, k: int = 5, **options: int) -> DataFrame:
    """One row (strategy, chunk_count, recall, mrr, ndcg) of the corpus ``docs`` (item, text) chunked by a
    strategy, embedded and searched by ``queries`` (query_id, text); a document counts at its best chunk."""
    from corpuslake.operators import chunks, embedding, retrieval

    made = chunks.chunk_with(docs.select("item", "text"), chunks.create_strategy(strategy, **options))
    made = made.select("item", F.col("chunk").alias("text"))
    # Embedded once: the search counts its chunks before it reads them.
    vectors = written(embedding.embed(made, "text", batch=EMBED_BATCH).select("item", "vector"), "vectors")
    asked = embedding.embed(queries.select("query_id", "text"), "text")
    # The metrics read the hits several times.
    ranked = written(retrieval.dense_topk_of(asked, vectors, k, "item"), "ranked")
    metrics = ir_metrics(mark_relevant(ranked, expected), expected, k)
    return metrics.join(vectors.agg(F.count(F.lit(1)).alias("chunk_count"))).select(F.lit(strategy).alias("strategy"), "chunk_count", "recall", "mrr", "ndcg")
