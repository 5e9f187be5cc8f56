"""Queries over retrieval evaluation, judges and experiment runs."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuslake.operators import evaluation, experiments, retrieval
from corpuslake.plans import corpus
from corpuslake.plans.registry import query
from corpuslake.plans.views import view
from corpuslake.sources.stored import shared_dir


def _hits(spark, sf_dir):
    return view(spark, sf_dir, "retrieved")


def _expected(spark, sf_dir):
    return _hits(spark, sf_dir).where("relevant").select("query_id", "item")


def _golden(spark, sf_dir):
    """One golden item for each query: the next vector but four."""
    return view(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), (F.col("vec_id") + 5).alias("item"))


_TOP = "SELECT * FROM {retrieved} WHERE rank <= 8"


def _top(spark, sf_dir):
    return _hits(spark, sf_dir).where("rank <= 8")


@query("SELECT query_id, round(avg(CASE WHEN rank <= 5 THEN 1 ELSE 0 END), 6) AS recall FROM {retrieved} WHERE relevant GROUP BY 1")
def k1_recall_at_k(spark, sf_dir):
    return evaluation.recall_at_k(_hits(spark, sf_dir), _expected(spark, sf_dir), 5).select("query_id", F.round("recall", 6).alias("recall"))


@query("SELECT query_id, coalesce(1.0::DOUBLE / min(CASE WHEN relevant THEN rank END), 0) AS rr FROM {retrieved} GROUP BY 1")
def k2_mrr(spark, sf_dir):
    return evaluation.reciprocal_rank(_hits(spark, sf_dir))


_NDCG = """SELECT query_id, CASE WHEN count(*) FILTER (WHERE relevant) = 0 THEN 0 ELSE sum(CASE WHEN relevant THEN 1 / log2(rank + 1.0::DOUBLE) ELSE 0 END)
  / list_sum(list_transform(generate_series(1, count(*) FILTER (WHERE relevant)), lambda i: 1 / log2(i + 1.0::DOUBLE))) END AS ndcg FROM {retrieved} WHERE rank <= 8 GROUP BY 1"""


@query(f"SELECT query_id, round(ndcg, 6) AS ndcg FROM ({_NDCG})")
def k3_ndcg_at_k(spark, sf_dir):
    return evaluation.ndcg_at_k(_hits(spark, sf_dir), 8).select("query_id", F.round("ndcg", 6).alias("ndcg"))


@query(f"""
WITH r AS (SELECT query_id, avg(CASE WHEN rank <= 8 THEN 1 ELSE 0 END) AS recall FROM {{retrieved}} WHERE relevant GROUP BY 1),
m AS (SELECT query_id, coalesce(1.0::DOUBLE / min(CASE WHEN relevant THEN rank END), 0) AS rr FROM {{retrieved}} GROUP BY 1), n AS ({_NDCG})
SELECT round(avg(coalesce(recall, 0)), 4) AS recall, round(avg(rr), 4) AS mrr, round(avg(ndcg), 4) AS ndcg FROM m LEFT JOIN r USING (query_id) LEFT JOIN n USING (query_id)""")
def k4_ir_metrics(spark, sf_dir):
    return evaluation.ir_metrics(_hits(spark, sf_dir), _expected(spark, sf_dir), 8)


_G = "(SELECT vec_id AS query_id, vec_id + 5 AS item FROM {embeddings})"
_FOUND = f"SELECT g.query_id, h.rank FROM {_G} g LEFT JOIN ({_TOP}) h ON g.query_id = h.query_id AND g.item = h.item"


@query(f"SELECT round(avg(CASE WHEN rank IS NULL THEN 0 ELSE 1 END), 4) AS hit_rate FROM ({_FOUND})")
def k5_hit_rate(spark, sf_dir):
    return evaluation.hit_rate(_top(spark, sf_dir), _golden(spark, sf_dir))


@query(f"SELECT round(avg(coalesce(1.0::DOUBLE / rank, 0)), 4) AS mrr FROM ({_FOUND})")
def k6_qa_mrr(spark, sf_dir):
    return evaluation.golden_mrr(_top(spark, sf_dir), _golden(spark, sf_dir))


@query("SELECT round(quantile_cont(s, 0.5), 6) AS p50 FROM (SELECT query_id, max(score) AS s FROM {retrieved} GROUP BY 1)")
def k7_p50_top_score(spark, sf_dir):
    return evaluation.median_top_score(_hits(spark, sf_dir))


@query(f"""
WITH f AS ({_FOUND}), v AS (SELECT round(avg(CASE WHEN rank IS NULL THEN 0 ELSE 1 END), 4) AS hit_rate, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 4) AS mrr FROM f),
p AS (SELECT round(quantile_cont(s, 0.5), 6) AS p50 FROM (SELECT query_id, max(score) AS s FROM ({_TOP}) GROUP BY 1)),
z AS (SELECT round(avg(CASE WHEN vec_id IN (SELECT query_id FROM ({_TOP})) THEN 0 ELSE 1 END), 4) AS zero_share FROM {{embeddings}})
SELECT *, hit_rate >= 0.7 AND mrr >= 0.5 AND zero_share <= 0.1 AND p50 >= 0.45 AS passed FROM v, p, z""")
def k8_qa_verdict(spark, sf_dir):
    queries = view(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"))
    return evaluation.verdict(queries, _top(spark, sf_dir), _golden(spark, sf_dir))


@query(f"SELECT query_id, string_agg(item, ',' ORDER BY rank) AS retrieved FROM ({_TOP}) GROUP BY 1")
def k9_qa_probe(spark, sf_dir):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"].cast("string"))
    return _top(spark, sf_dir).groupBy("query_id").agg(F.array_join(ordered, ",").alias("retrieved"))


def _examples(spark, sf_dir):
    """Turns of a conversation as question, answer and contexts."""
    conv = view(spark, sf_dir, "conversations")
    first = F.min_by("text", "turn")
    all_ = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.col("text").alias("t")))), lambda x: x["t"])
    return conv.groupBy(F.col("conv_id").alias("query_id")).agg(first.alias("question"), F.max_by("text", "turn").alias("answer"), F.max_by("text", "turn").alias("truth"), all_.alias("contexts"))


@query("""
WITH e AS (SELECT conv_id, arg_min(text, turn) AS q, arg_max(text, turn) AS a, list(text ORDER BY turn) AS c FROM {conversations} WHERE turn IN (SELECT DISTINCT turn FROM {conversations}) GROUP BY 1),
p AS (SELECT conv_id, q, a, array_to_string(c, chr(10) || '---' || chr(10)) AS plain, array_to_string(list_transform(c, lambda x, i: '[' || i || '] ' || x), chr(10)) AS numbered, chr(10) || chr(10) AS nn, chr(10) || chr(10) || 'Reply with one number from 0.0 to 1.0.' AS tail FROM e)
SELECT conv_id AS query_id, 'faithfulness' AS metric, md5('How far does the context support the answer?' || nn || 'Context:' || chr(10) || plain || nn || 'Answer:' || chr(10) || a || tail) AS h FROM p
UNION ALL SELECT conv_id, 'answer_relevancy', md5('How far does the answer address the question?' || nn || 'Question:' || chr(10) || q || nn || 'Answer:' || chr(10) || a || tail) FROM p
UNION ALL SELECT conv_id, 'context_precision', md5('What share of the contexts bears on the question?' || nn || 'Question:' || chr(10) || q || nn || 'Contexts:' || chr(10) || numbered || tail) FROM p
UNION ALL SELECT conv_id, 'context_recall', md5('What share of the expected answer do the contexts hold?' || nn || 'Question:' || chr(10) || q || nn || 'Expected answer:' || chr(10) || a || nn || 'Contexts:' || chr(10) || numbered || tail) FROM p""")
def k10_judge_prompts(spark, sf_dir):
    return evaluation.judge_prompts(_examples(spark, sf_dir)).select("query_id", "metric", F.md5(F.col("prompt").cast("binary")).alias("h"))


@query()
def k11_judge_scores(spark, sf_dir):
    judged = evaluation.judge(evaluation.judge_prompts(_examples(spark, sf_dir)))
    return judged.select("query_id", "metric", evaluation.parse_score(F.col("reply")).alias("score"))


_REPLY = "CASE event_id % 6 WHEN 0 THEN 'Score: ' || CAST(user_id AS VARCHAR) || '%' WHEN 1 THEN 'I say 0.' || CAST(event_id % 97 AS VARCHAR) WHEN 2 THEN 'Yes' WHEN 3 THEN 'about ' || CAST(event_id % 130 AS VARCHAR) WHEN 4 THEN 'partial match' ELSE event_type END"


@query(f"""
WITH r AS (SELECT event_id, {_REPLY} AS t FROM {{events}}), w AS (SELECT *, string_split_regex(lower(t), '\\s+') AS ws,
  CAST(nullif(regexp_extract(t, '(\\d+(?:\\.\\d+)?)\\s*%', 1), '') AS DOUBLE) AS pc, CAST(nullif(regexp_extract(t, '\\b(\\d?\\.\\d+)\\b', 1), '') AS DOUBLE) AS de, CAST(nullif(regexp_extract(t, '\\b(\\d+)\\b', 1), '') AS DOUBLE) AS wh FROM r)
SELECT event_id, CAST(CASE {' '.join(f"WHEN list_contains(ws, '{k}') THEN {v}" for k, v in evaluation.SCORE_WORDS.items())} WHEN pc IS NOT NULL THEN least(1.0, pc / 100) WHEN de <= 1 THEN de WHEN de <= 100 THEN de / 100
  WHEN wh <= 1 THEN wh WHEN wh <= 10 THEN wh / 10 WHEN wh <= 100 THEN wh / 100 ELSE 0.5 END AS DOUBLE) AS score FROM w""".replace("{{events}}", "{events}"))
def k12_parse_score(spark, sf_dir):
    n = F.col("event_id")
    reply = (
        F.when(n % 6 == 0, F.concat(F.lit("Score: "), F.col("user_id").cast("string"), F.lit("%"))).when(n % 6 == 1, F.concat(F.lit("I say 0."), (n % 97).cast("string")))
        .when(n % 6 == 2, "Yes").when(n % 6 == 3, F.concat(F.lit("about "), (n % 130).cast("string"))).when(n % 6 == 4, "partial match").otherwise(F.col("event_type"))
    )
    return view(spark, sf_dir, "events").select("event_id", evaluation.parse_score(reply).alias("score"))


_VALUES = "SELECT l_returnflag AS metric, l_discount AS value FROM {lineitem}"


@query(f"SELECT metric, round(avg(value), 4) AS mean FROM ({_VALUES}) GROUP BY 1")
def k13_eval_summary(spark, sf_dir):
    values = view(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("metric"), F.col("l_discount").alias("value"))
    return evaluation.metric_stats(values).select("metric", "mean")


@query(f"SELECT metric, round(avg(value), 4) AS mean, min(value) AS least, max(value) AS most, count(*) AS n FROM ({_VALUES}) GROUP BY 1")
def k14_per_example_stats(spark, sf_dir):
    values = view(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("metric"), F.col("l_discount").alias("value"))
    return evaluation.metric_stats(values)


# Experiments: documents that have a vector, asked by some of them; those of the same label are expected.


def _corpus(spark, sf_dir):
    """Queries, chunks and expected chunks, these by label."""
    e = view(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")
    chunks = view(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text").join(e, "chunk_id")
    asked = chunks.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), F.substring("text", 1, 120).alias("text"), "vector", "label")
    return asked, chunks, experiments.SameLabel(asked.select("query_id", "label"), chunks.select("chunk_id", "label"))


def _candidates(spark, sf_dir, depth=20):
    asked, chunks, expected = _corpus(spark, sf_dir)
    return experiments.candidates(asked, chunks, depth, -1.0), expected


# What both searches find, fused by each row of v, reranked where it says so; then the metrics of the first k.
_EXPERIMENT = f"""e AS (SELECT vec_id AS chunk_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec, label FROM {{embeddings}}),
c AS (SELECT e.*, text FROM e JOIN {{documents}} d ON d.doc_id = chunk_id),
q AS (SELECT chunk_id AS query_id, substr(text, 1, 120) AS text, vec, label FROM c WHERE chunk_id % 20 = 0),
t AS (SELECT chunk_id, {corpus._TERMS} AS t FROM c),
p AS (SELECT chunk_id, term, count(*) AS tf, any_value(length) AS length FROM (SELECT chunk_id, len(t) AS length, unnest(t) AS term FROM t) GROUP BY 1, 2),
n AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM t), a AS (SELECT DISTINCT query_id, unnest({corpus._TERMS}) AS term FROM q), d AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
b AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / avgdl))), 9) AS score FROM a JOIN p USING (term) JOIN d USING (term), n GROUP BY 1, 2),
s1 AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS sparse_rank FROM b),
d1 AS (SELECT query_id, c.chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(q.vec, c.vec) DESC, c.chunk_id) AS dense_rank FROM q, c),
h AS (SELECT query_id, chunk_id, dense_rank, sparse_rank FROM (SELECT * FROM d1 WHERE dense_rank <= 20) FULL JOIN (SELECT * FROM s1 WHERE sparse_rank <= 20) USING (query_id, chunk_id)),
y AS (SELECT h.*, list_filter(list_distinct(string_split_regex(lower(q.text), '[ \\t\\n\\x0B\\f\\r]+')), lambda w: w <> '') AS x, list_filter(list_distinct(string_split_regex(lower(c.text), '[ \\t\\n\\x0B\\f\\r]+')), lambda w: w <> '') AS z
  FROM h JOIN q USING (query_id) JOIN c USING (chunk_id)),
o AS (SELECT * EXCLUDE (x, z), round(2.0::DOUBLE * len(list_intersect(x, z)) / (len(x) + len(z)), 9) AS again FROM y),
f AS (SELECT v.*, o.*, coalesce(v.dense_weight / (60 + dense_rank), 0) + coalesce(v.sparse_weight / (60 + sparse_rank), 0) AS fused FROM o, v),
g AS (SELECT *, row_number() OVER (PARTITION BY variant, query_id ORDER BY fused DESC, chunk_id) AS first FROM f WHERE fused > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY variant, query_id ORDER BY CASE WHEN rerank THEN again ELSE fused END DESC, chunk_id) AS rank FROM g WHERE first <= CASE WHEN rerank THEN least(4 * k, 50) ELSE k END),
w AS (SELECT variant, q.query_id, c.chunk_id FROM q JOIN c ON q.label = c.label AND q.query_id <> c.chunk_id, v),
m AS (SELECT r.*, w.chunk_id IS NOT NULL AS relevant FROM r LEFT JOIN w USING (variant, query_id, chunk_id) WHERE rank <= k),
u AS (SELECT variant, query_id, count(*) AS expected FROM w GROUP BY 1, 2),
x AS (SELECT variant, query_id, any_value(expected) AS expected, count(*) FILTER (WHERE relevant) AS found, min(CASE WHEN relevant THEN rank END) AS first, sum(CASE WHEN relevant THEN 1 / log2(rank + 1.0::DOUBLE) ELSE 0 END) AS dcg
  FROM u LEFT JOIN m USING (variant, query_id) GROUP BY 1, 2),
z AS (SELECT variant, round(avg(found / expected::DOUBLE), 4) AS recall, round(avg(coalesce(1.0::DOUBLE / first, 0)), 4) AS mrr,
  round(avg(CASE WHEN found > 0 THEN dcg / list_sum(list_transform(generate_series(1, found), lambda i: 1 / log2(i + 1.0::DOUBLE))) ELSE 0 END), 4) AS ndcg FROM x GROUP BY 1)"""


def _scorer(query: str, text: str) -> float:
    return round(retrieval.overlap_scorer(query, text), 9)


_NAMED = ", ".join(f"('{n}', {d}::DOUBLE, {s}::DOUBLE, 5, {str(r).lower()})" for n, (d, s, r) in evaluation.SCORING_VARIANTS.items())


@query(f"WITH v AS (SELECT * FROM (VALUES {_NAMED}) t(variant, dense_weight, sparse_weight, k, rerank)), {_EXPERIMENT} SELECT variant, recall, mrr, ndcg FROM z")
def k16_scoring_experiment(spark, sf_dir):
    """Every registered variant over one stage of candidates."""
    found, expected = _candidates(spark, sf_dir)
    return experiments.variant_experiment(found, expected, 5, list(evaluation.SCORING_VARIANTS))


_LISTS = {"dense_weight": [1.0, 0.7, 0.5, 0.3], "sparse_weight": [0.0, 0.3, 0.7], "k": [3, 5], "rerank": [False, True]}
_SWEPT = """v AS (SELECT '{{"dense_weight": ' || dense_weight || ', "k": ' || k || ', "rerank": ' || rerank || ', "sparse_weight": ' || sparse_weight || '}}' AS variant, * FROM
  (SELECT unnest([1.0, 0.7, 0.5, 0.3]::DOUBLE[]) AS dense_weight), (SELECT unnest([0.0, 0.3, 0.7]::DOUBLE[]) AS sparse_weight), (SELECT unnest([3, 5]) AS k), (SELECT unnest([false, true]) AS rerank))"""


def _sweep(spark, sf_dir):
    found, expected = _candidates(spark, sf_dir)
    return experiments.sweep_parameters(found, expected, _LISTS, _scorer)


@query(f"WITH {_SWEPT}, {_EXPERIMENT} SELECT v.*, recall, mrr, ndcg FROM z JOIN v USING (variant)")
def k17_parameter_sweep(spark, sf_dir):
    """48 combinations in one job."""
    return _sweep(spark, sf_dir)


@query(f"""WITH {_SWEPT}, {_EXPERIMENT}, s AS (SELECT 'run-' || md5(variant) AS run_id, variant AS params, recall, mrr, ndcg FROM z),
s2 AS (SELECT * FROM s UNION ALL SELECT * REPLACE ('baseline' AS run_id) FROM s WHERE run_id = (SELECT min(run_id) FROM s))
SELECT CAST(row_number() OVER (ORDER BY run_id) AS INT) AS place, * FROM s2""")
def a15_save_and_load_runs(spark, sf_dir):
    """The sweep's results saved as runs and read again; the first of them becomes the baseline."""
    swept = _sweep(spark, sf_dir)
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("recall", "mrr", "ndcg")])).alias("m")
    runs = swept.select(F.concat(F.lit("run-"), F.md5(F.col("variant").cast("binary"))).alias("run_id"), F.lit("2024-01-01").cast("timestamp").alias("ts"), F.col("variant").alias("params"), values).select("run_id", "ts", "params", "m.*")
    store = experiments.run_store(spark, f"{shared_dir(spark)}/corpuslake/runs-{uuid.uuid4().hex}")
    experiments.save_run(store, runs)
    loaded = experiments.load_runs(store)
    place = F.row_number().over(Window.orderBy(F.desc("ts"), "run_id")).alias("place")
    return loaded.select(place, "run_id", "params", *[F.col("metrics")[m].alias(m) for m in ("recall", "mrr", "ndcg")])


@query("""SELECT r.run_id, r.metric, r.value, b.value AS base, round(r.value - b.value, 6) AS delta FROM {runs} r LEFT JOIN (SELECT metric, value FROM {runs} WHERE run_id = 'run0') b ON r.metric = b.metric
WHERE r.run_id IN ('run1', 'run2', 'run33')""")
def k19_compare_runs(spark, sf_dir):
    return evaluation.compare_runs(view(spark, sf_dir, "runs"), "run0", ["run1", "run2", "run33", "unknown"])


@query("SELECT metric, round(avg(value), 4) AS mean, min(value) AS least, max(value) AS most, count(*) AS n FROM {runs} GROUP BY 1")
def a14_export_eval_results(spark, sf_dir):
    return evaluation.metric_stats(view(spark, sf_dir, "runs"))


@query("SELECT run_id FROM {runs} GROUP BY 1 ORDER BY max(run_id = 'baseline') DESC, min(ts), run_id LIMIT 1")
def a15_baseline_run(spark, sf_dir):
    return evaluation.baseline_of(view(spark, sf_dir, "runs"))


@query("SELECT run_id, max(CASE WHEN metric = 'A' THEN value END) AS \"A\", max(CASE WHEN metric = 'N' THEN value END) AS \"N\", max(CASE WHEN metric = 'R' THEN value END) AS \"R\" FROM {runs} GROUP BY 1")
def a16_export_runs_csv(spark, sf_dir):
    return evaluation.runs_wide(view(spark, sf_dir, "runs"), ["A", "N", "R"])


@query("""SELECT conv_id, turn, unnest(list_filter([CASE WHEN role = 'user' AND length(text) < 60 THEN 'empty query' END, CASE WHEN length(text) < 100 THEN 'empty answer' END], lambda x: x IS NOT NULL)) AS error FROM {conversations}""")
def c13_validate_golden(spark, sf_dir):
    errors = F.array(F.when((F.col("role") == "user") & (F.length("text") < 60), "empty query"), F.when(F.length("text") < 100, "empty answer"))
    return view(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.filter(errors, lambda x: x.isNotNull())).alias("error"))


@query("""SELECT p_partkey, unnest(list_filter([CASE WHEN p_size % 10 <= 0 THEN 'chunk_size must be positive' END, CASE WHEN p_partkey % 20 >= p_size % 10 THEN 'overlap must be less than chunk_size' END,
  CASE WHEN p_retailprice > 1500 THEN 'weights add up to more than 1' END], lambda x: x IS NOT NULL)) AS error FROM {part}""")
def c14_validate_experiment_params(spark, sf_dir):
    size, overlap = F.col("p_size") % 10, F.col("p_partkey") % 20
    errors = F.array(F.when(size <= 0, "chunk_size must be positive"), F.when(overlap >= size, "overlap must be less than chunk_size"), F.when(F.col("p_retailprice") > 1500, "weights add up to more than 1"))
    return view(spark, sf_dir, "part").select("p_partkey", F.explode(F.filter(errors, lambda x: x.isNotNull())).alias("error"))
