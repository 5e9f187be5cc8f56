"""Queries over embeddings and texts: dense, sparse and fused search, listings and reports.

Query sets: vectors whose id is divisible by 100, and the benchmark items.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from corpuslake.functions import text as tx
from corpuslake.operators import embedding, retrieval
from corpuslake.plans.corpus import _TERMS
from corpuslake.plans.registry import query
from corpuslake.plans.views import view
from corpuslake.sources.stored import written


def _vectors(spark, sf_dir):
    e = view(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")
    return e.withColumn("collection", F.concat(F.lit("kb"), (F.col("label") % 3).cast("string")))


def _queries(spark, sf_dir):
    return view(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _hits(df):
    return df.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


_SCORES = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM {embeddings}),
c AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, c.label, 'kb' || c.label % 3 AS collection, list_cosine_similarity(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0),
s AS (SELECT * FROM c WHERE score >= 0.1)"""
_RANK = "CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank"


@query(f"WITH {_SCORES} SELECT vec_id AS chunk_id FROM {{embeddings}} WHERE label = 4")
def h1_metadata_filter(spark, sf_dir):
    return retrieval.matching(_vectors(spark, sf_dir), label=4, collection=None).select("chunk_id")


@query(f"WITH {_SCORES}, r AS (SELECT *, {_RANK} FROM s) SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM r WHERE rank <= 10")
def h2_dense_topk(spark, sf_dir):
    return _hits(retrieval.dense_topk(_queries(spark, sf_dir), _vectors(spark, sf_dir), 10, 0.1))


@query()
def h3_dense_topk_ann(spark, sf_dir):
    return _hits(embedding.ann_topk(_queries(spark, sf_dir), _vectors(spark, sf_dir), 10))


_POST = f"""t AS (SELECT doc_id AS chunk_id, {_TERMS} AS t FROM {{documents}}),
p AS (SELECT chunk_id, term, count(*) AS tf, any_value(length) AS length FROM (SELECT chunk_id, len(t) AS length, unnest(t) AS term FROM t) GROUP BY 1, 2),
n AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM t)"""
_ASKED = f"a AS (SELECT DISTINCT query_id, unnest({_TERMS}) AS term FROM (SELECT item_id AS query_id, text FROM {{benchmark}}))"
_BM25 = f"""{_POST}, {_ASKED}, d AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
b AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / avgdl))), 9) AS score
  FROM a JOIN p USING (term) JOIN d USING (term), n GROUP BY 1, 2)"""


@query(f"WITH {_POST} SELECT chunk_id, count(*) AS n_terms, CAST(sum(tf) AS BIGINT) AS length FROM p GROUP BY 1")
def h4_sparse_vectors(spark, sf_dir):
    index = retrieval.postings(view(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text"))
    return index.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("tf").alias("length"))


def _sparse(spark, sf_dir, k):
    docs = view(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    asked = view(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.sparse_topk(asked, docs, k)


@query(f"WITH {_BM25}, r AS (SELECT *, {_RANK} FROM b) SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM r WHERE rank <= 10")
def h5_sparse_topk(spark, sf_dir):
    return _hits(_sparse(spark, sf_dir, 10))


_LISTS = "SELECT query_id, item AS chunk_id, rank FROM {retrieved} WHERE rank <= 8"
_OTHER = "SELECT query_id, item AS chunk_id, CAST(13 - rank AS INT) AS rank FROM {retrieved} WHERE rank > 3"


def _lists(spark, sf_dir):
    r = view(spark, sf_dir, "retrieved").select("query_id", F.col("item").alias("chunk_id"), "rank")
    return r.where("rank <= 8"), r.where("rank > 3").withColumn("rank", 13 - F.col("rank"))


@query(f"""WITH u AS (SELECT query_id, chunk_id, sum(w) AS score FROM (SELECT query_id, chunk_id, 0.7::DOUBLE / (60 + rank) AS w FROM ({_LISTS}) UNION ALL SELECT query_id, chunk_id, 0.3::DOUBLE / (60 + rank) FROM ({_OTHER})) GROUP BY 1, 2),
r AS (SELECT *, {_RANK} FROM u) SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM r WHERE rank <= 6""")
def h6_rrf_fuse(spark, sf_dir):
    return _hits(retrieval.rrf_fuse(*_lists(spark, sf_dir), 6))


@query()
def h7_hybrid_search(spark, sf_dir):
    docs = view(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    # Embedded once: the search counts its chunks before it reads them.
    chunks = written(embedding.embed(docs, "text").select("chunk_id", "text", "vector"), "embedded")
    asked = view(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    asked = embedding.embed(asked, "text")
    return _hits(retrieval.hybrid(asked, chunks, 10))


@query("""SELECT query_id, item AS chunk_id, round(CASE WHEN max(score) OVER w - min(score) OVER w < 1e-9 THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6) AS score
FROM {retrieved} WINDOW w AS (PARTITION BY query_id)""")
def h8_min_max_normalise(spark, sf_dir):
    hits = view(spark, sf_dir, "retrieved").select("query_id", F.col("item").alias("chunk_id"), "score")
    return retrieval.min_max(hits).withColumn("score", F.round("score", 6))


_PER = f"""{_SCORES}, k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, collection ORDER BY score DESC, chunk_id) AS INT) AS rank FROM s)"""


@query(f"WITH {_PER} SELECT query_id, collection, chunk_id, rank FROM k WHERE rank <= 5")
def h9_multi_collection_search(spark, sf_dir):
    hits = retrieval.dense_topk(_queries(spark, sf_dir), _vectors(spark, sf_dir), 5, 0.1, part="collection")
    return hits.select("query_id", "collection", "chunk_id", "rank")


@query(f"""WITH {_PER}, m AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM k WHERE rank <= 5 GROUP BY 1, 2), r AS (SELECT *, {_RANK} FROM m)
SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM r WHERE rank <= 8""")
def h10_merge_collections(spark, sf_dir):
    hits = retrieval.dense_topk(_queries(spark, sf_dir), _vectors(spark, sf_dir), 5, 0.1, part="collection")
    return _hits(retrieval.merge_collections(hits, 8))


@query("SELECT DISTINCT r_name AS collection FROM {region} WHERE r_name NOT IN (SELECT 'kb' || label % 3 FROM {embeddings})")
def h11_resolve_collections(spark, sf_dir):
    wanted = view(spark, sf_dir, "region").select(F.col("r_name").alias("collection"))
    return retrieval.unknown_collections(wanted, _vectors(spark, sf_dir))


@query("SELECT DISTINCT 'kb' || label % 3 AS collection, label % 3 = 0 AS is_default FROM {embeddings}")
def h12_list_collections(spark, sf_dir):
    return _vectors(spark, sf_dir).select("collection").distinct().withColumn("is_default", F.col("collection") == "kb0")


def _pairs(spark, sf_dir):
    """The first 20 hits of every query with both texts."""
    docs = view(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    asked = view(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    return _sparse(spark, sf_dir, 20).join(docs, "chunk_id").join(asked, "query_id")


def _rounded(query: str, text: str) -> float:
    return round(retrieval.overlap_scorer(query, text), 9)


@query(f"""
WITH {_BM25}, r AS (SELECT *, {_RANK} FROM b), h AS (SELECT r.query_id, r.chunk_id, list_distinct(string_split_regex(lower(i.text), '[ \\t\\n\\x0B\\f\\r]+')) AS x, list_distinct(string_split_regex(lower(d.text), '[ \\t\\n\\x0B\\f\\r]+')) AS y
  FROM r JOIN {{benchmark}} i ON i.item_id = r.query_id JOIN {{documents}} d ON d.doc_id = r.chunk_id WHERE rank <= 20),
w AS (SELECT query_id, chunk_id, list_filter(x, lambda t: t <> '') AS x, list_filter(y, lambda t: t <> '') AS y FROM h),
o AS (SELECT query_id, chunk_id, round(2.0::DOUBLE * len(list_intersect(x, y)) / (len(x) + len(y)), 9) AS score FROM w), z AS (SELECT *, {_RANK} FROM o)
SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM z WHERE rank <= 5""")
def h13_rerank(spark, sf_dir):
    return _hits(retrieval.rerank(_pairs(spark, sf_dir), 5, _rounded))


def _fails(query: str, text: str) -> float:
    """A scorer that breaks on texts with a card's digits."""
    if re.search("[0-9]{16}", text):
        raise ValueError("no digits please")
    return _rounded(query, text)


@query(f"""
WITH {_BM25}, r AS (SELECT *, {_RANK} FROM b), h AS (SELECT r.query_id, r.chunk_id, r.rank AS old, r.score AS was, regexp_matches(d.text, '[0-9]{{{{16}}}}') AS bad, list_distinct(string_split_regex(lower(i.text), '[ \\t\\n\\x0B\\f\\r]+')) AS x,
  list_distinct(string_split_regex(lower(d.text), '[ \\t\\n\\x0B\\f\\r]+')) AS y FROM r JOIN {{benchmark}} i ON i.item_id = r.query_id JOIN {{documents}} d ON d.doc_id = r.chunk_id WHERE rank <= 20),
w AS (SELECT query_id, chunk_id, old, was, max(bad) OVER (PARTITION BY query_id) AS failed, list_filter(x, lambda t: t <> '') AS x, list_filter(y, lambda t: t <> '') AS y FROM h),
o AS (SELECT query_id, chunk_id, failed, old, CASE WHEN failed THEN was ELSE round(2.0::DOUBLE * len(list_intersect(x, y)) / (len(x) + len(y)), 9) END AS score FROM w),
z AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN failed THEN -old ELSE score END DESC, chunk_id) AS INT) AS rank FROM o)
SELECT query_id, chunk_id, rank, round(score, 6) AS score, CASE WHEN failed THEN 'ValueError: no digits please' ELSE 'ok' END AS outcome FROM z WHERE rank <= 5""")
def h13_rerank_with_failures(spark, sf_dir):
    """Queries on one of whose hits the scorer fails keep the order of the search."""
    found = retrieval.rerank(_pairs(spark, sf_dir), 5, _fails)
    return found.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"), "outcome")


_KB1 = f"{_SCORES}, r AS (SELECT *, {_RANK} FROM s WHERE collection = 'kb1')"


@query(f"""WITH {_KB1}, n AS (SELECT query_id, count(*) AS result_count, max(score) AS max_score FROM r WHERE rank <= 5 GROUP BY 1)
SELECT vec_id AS query_id, 'dense' AS path, coalesce(result_count, 0) AS result_count, round(max_score, 6) AS max_score FROM {{embeddings}} LEFT JOIN n ON query_id = vec_id WHERE vec_id % 100 = 0""")
def h14_search(spark, sf_dir):
    options = retrieval.SearchOptions(k=5, threshold=0.1, filters={"collection": "kb1"})
    _, log = retrieval.search(_queries(spark, sf_dir), _vectors(spark, sf_dir), options)
    return log.withColumn("max_score", F.round("max_score", 6))


@query(f"""WITH {_SCORES}, k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, collection ORDER BY score DESC, chunk_id) AS INT) AS rank FROM s WHERE collection IN ('kb0', 'kb2')),
m AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM k WHERE rank <= 5 GROUP BY 1, 2), r AS (SELECT *, {_RANK} FROM m)
SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM r WHERE rank <= 5""")
def h14_search_collections(spark, sf_dir):
    options = retrieval.SearchOptions(k=5, threshold=0.1, collections=("kb0", "kb2"))
    return _hits(retrieval.search(_queries(spark, sf_dir), _vectors(spark, sf_dir), options)[0])


@query("""SELECT query_id, item AS chunk_id, printf('%.1f%%', round_even(100 * score, 1)) AS relevance FROM {retrieved} WHERE rank <= 3""")
def h15_search_report_rows(spark, sf_dir):
    hits = view(spark, sf_dir, "retrieved").where("rank <= 3")
    return hits.select("query_id", F.col("item").alias("chunk_id"), F.format_string("%.1f%%", F.bround(100 * F.col("score"), 1)).alias("relevance"))


@query("""SELECT c.conv_id AS document, t.turn AS target, c.turn AS chunk_index FROM {conversations} c JOIN {conversations} t ON c.conv_id = t.conv_id AND c.turn BETWEEN t.turn - 1 AND t.turn + 1""")
def h16_chunk_context(spark, sf_dir):
    turns = view(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document"), F.col("turn").alias("chunk_index"), "text")
    return retrieval.context(turns, turns, 1).select("document", "target", "chunk_index")


@query("""SELECT c.conv_id AS document, t.turn AS target, c.turn AS chunk_index FROM {conversations} c JOIN {conversations} t ON c.conv_id = t.conv_id AND c.turn BETWEEN t.turn - 1 AND t.turn + 1""")
def h16_every_chunk_context(spark, sf_dir):
    turns = view(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document"), F.col("turn").alias("chunk_index"), "text")
    return retrieval.context(turns, turns, 1).select("document", "target", "chunk_index")


@query("SELECT conv_id, count(*) AS chunk_count, arg_min(role, turn) AS first_role FROM {conversations} GROUP BY 1")
def h17_list_documents(spark, sf_dir):
    return view(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("chunk_count"), F.min_by("role", "turn").alias("first_role"))


@query("SELECT doc_type AS value, count(*) AS n FROM {registry} GROUP BY 1 ORDER BY n DESC, value LIMIT 3")
def h18_distinct_terms(spark, sf_dir):
    return retrieval.value_counts(view(spark, sf_dir, "registry"), "doc_type", 3)


_FIELDS = ["vendor", "product", "doc_type", "subsystem", "module", "version", "file_type"]
_EACH = " UNION ALL ".join(f"SELECT '{f}' AS field, {f} AS value FROM {{registry}}" for f in _FIELDS)


@query(f"""WITH c AS (SELECT field, value, count(*) AS n FROM ({_EACH}) WHERE trim(value) <> '' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS r FROM c)
SELECT field, string_agg(value || ' (' || n || ')', ', ' ORDER BY r) FILTER (WHERE r <= 4) || CASE WHEN count(*) > 4 THEN ' (+' || (count(*) - 4) || ' more)' ELSE '' END AS line FROM r GROUP BY 1""")
def h19_filter_terms_table(spark, sf_dir):
    return retrieval.filter_terms(view(spark, sf_dir, "registry"), _FIELDS, 4)


@query("SELECT file_type, doc_type, CAST(sum(chunks) AS BIGINT) AS chunks, count(DISTINCT path) AS documents, round(sum(chunks) * 768 * 4 / 1048576.0::DOUBLE, 4) AS index_mb FROM {registry} GROUP BY 1, 2")
def h20_kb_stats(spark, sf_dir):
    g = view(spark, sf_dir, "registry").groupBy("file_type", "doc_type").agg(F.sum("chunks").alias("chunks"), F.countDistinct("path").alias("documents"))
    return g.withColumn("index_mb", F.round(F.col("chunks") * 768 * 4 / F.lit(1048576.0), 4))


@query("SELECT conv_id, turn FROM {conversations} ORDER BY conv_id, turn LIMIT 50 OFFSET 50")
def h21_document_chunks_page(spark, sf_dir):
    return view(spark, sf_dir, "conversations").orderBy("conv_id", "turn").offset(50).limit(50).select("conv_id", "turn")


@query("SELECT id, sha256(query_text || chr(31) || CAST(top_k AS VARCHAR) || chr(31) || coalesce(filters, '') || chr(31) || coalesce(version_filter, '')) AS key FROM {query_log}")
def h22_repeat_request_key(spark, sf_dir):
    parts = [F.col(c) for c in ("query_text", "top_k", "filters", "version_filter")]
    return view(spark, sf_dir, "query_log").select("id", retrieval.request_key(*parts).alias("key"))


@query(f"""
WITH {_BM25}, r AS (SELECT *, {_RANK} FROM b), c AS (SELECT r.query_id, string_agg('[' || r.chunk_id || '] ' || d.text, chr(10) ORDER BY rank) AS t FROM r JOIN {{documents}} d ON d.doc_id = r.chunk_id WHERE rank <= 3 GROUP BY 1)
SELECT item_id AS query_id, md5('Answer from these passages only.' || chr(10) || chr(10) || coalesce(t, '') || chr(10) || chr(10) || 'Question: ' || text) AS h FROM {{benchmark}} LEFT JOIN c ON query_id = item_id""")
def h23_assemble_prompt(spark, sf_dir):
    docs = view(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    asked = view(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    prompts = retrieval.assemble_prompts(asked, _sparse(spark, sf_dir, 3).join(docs, "chunk_id"))
    return prompts.select("query_id", F.md5(F.col("prompt").cast("binary")).alias("h"))


@query("""SELECT page_id, md5(regexp_replace(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'), '(the)', '<mark>\\1</mark>', 'gi')) AS h FROM {pages}""")
def h25_highlight_matches(spark, sf_dir):
    return view(spark, sf_dir, "pages").select("page_id", F.md5(retrieval.highlight(F.col("html"), "the").cast("binary")).alias("h"))


@query("SELECT doc_id, md5(text) AS key FROM {documents}")
def g2_embed_once_per_text(spark, sf_dir):
    found = embedding.embed_distinct(view(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return found.where(F.size("vector") == embedding.DIM).select("doc_id", F.md5(F.col("text").cast("binary")).alias("key"))


@query("SELECT vec_id, len(embedding) AS dim FROM {embeddings} WHERE len(embedding) <> 768")
def g4_vector_dim_check(spark, sf_dir):
    return view(spark, sf_dir, "embeddings").where(F.size("embedding") != 768).select("vec_id", F.size("embedding").cast("long").alias("dim"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM {embeddings})
SELECT a.vec_id, round(list_inner_product(a.e, b.e), 6) AS dot, round(list_cosine_similarity(a.e, b.e), 6) AS cosine, round(list_distance(a.e, b.e), 6) AS euclid,
  round(list_sum(list_transform(list_zip(a.e, b.e), lambda p: abs(p[1] - p[2]))), 6) AS manhattan FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""")
def g5_distances(spark, sf_dir):
    a = view(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    both = a.join(a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    x, y = F.col("a"), F.col("b")
    return both.select("vec_id", *[F.round(f(x, y), 6).alias(n) for n, f in (("dot", retrieval.dot), ("cosine", retrieval.cosine), ("euclid", retrieval.euclidean), ("manhattan", retrieval.manhattan))])


@query("""SELECT conv_id, turn, role || '.md' AS source_file, (turn % 10) / 10.0::DOUBLE AS score, 'c' || turn AS chunk_id, 'P' || conv_id AS product, md5(replace(text, chr(10), ' ')) AS h FROM {conversations}""")
def h24_parse_search_report(spark, sf_dir):
    turns = view(spark, sf_dir, "conversations").withColumn("text", F.trim(F.translate("text", "\n", " ")))
    hit = F.concat(
        F.lit("\n### [1] "), "role", F.lit(".md (relevance: "), F.format_string("%.1f", (F.col("turn") % 10) * 10.0), F.lit("%)\n**ID:** `c"), F.col("turn").cast("string"),
        F.lit("`\n**Product:** P"), F.col("conv_id").cast("string"), F.lit("\n\n"), "text", F.lit("\n\n---"))
    report = turns.groupBy("conv_id").agg(F.concat(F.lit("# Results"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", hit.alias("hit")))), lambda x: x["hit"]), "")).alias("report"))
    found = report.select("conv_id", F.explode(retrieval.parse_report(F.col("report"))).alias("r")).select("conv_id", "r.*")
    return found.select("conv_id", F.substring("chunk_id", 2, 9).cast("long").alias("turn"), "source_file", F.round("score", 4).alias("score"), "chunk_id", "product", F.md5(F.col("text").cast("binary")).alias("h"))


@query("SELECT doc_id, true AS fell_back, false AS failed FROM {documents}")
def g3_embed_with_fallback(spark, sf_dir):
    found = embedding.embed(view(spark, sf_dir, "documents").select("doc_id", "text"), "text", _down, embedding.hash_provider)
    return found.select("doc_id", F.col("vector").isNotNull().alias("fell_back"), F.col("error").isNotNull().alias("failed"))


def _down(texts):
    raise ConnectionError("provider is down")
