"""Knowledge-base frames that Spark derives from the given tables.

Each view is one SQL text over the tables and other views, named in braces; it reads the same
in Spark SQL and in DuckDB, so that a query and its SQL twin start from the same rows. (Two
functions have other names there: ``sha256``, and ``each_of(a, b)``, a row for each number.)
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    # Source files: paths that the classification rules tell apart.
    "files": """
        SELECT doc_id, text, lang, source, n_chars AS length,
          CASE doc_id % 9 WHEN 0 THEN 'appserver' WHEN 1 THEN 'Data Sync' WHEN 2 THEN 'varios' WHEN 3 THEN 'CustomProduct'
            WHEN 4 THEN 'webreports' WHEN 5 THEN 'xECM 23.4' WHEN 6 THEN 'archive' WHEN 7 THEN 'ISO' ELSE 'records management' END
          || '/' || CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'admin/' WHEN 2 THEN 'Designer/Security/' ELSE 'templates/connectors/' END
          || CASE doc_id % 13 WHEN 0 THEN 'Admin-Guide' WHEN 1 THEN 'Release-Notes-23.4' WHEN 2 THEN 'ISO-9001-Standard' WHEN 3 THEN 'README'
            WHEN 4 THEN 'Upgrade_Guide_v2.5' WHEN 5 THEN 'API Reference CE 24.4' WHEN 6 THEN 'case-study' WHEN 7 THEN 'training module 3'
            WHEN 8 THEN 'OpenText overview' WHEN 9 THEN 'config_cookbook' WHEN 10 THEN 'meeting recording' WHEN 11 THEN 'version 16.2 notes'
            ELSE 'webreport security' END
          || '_' || CAST(doc_id AS STRING)
          || CASE doc_id % 11 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' WHEN 2 THEN '.txt' WHEN 3 THEN '.md' WHEN 4 THEN '.py' WHEN 5 THEN '.zip'
            WHEN 6 THEN '.json' WHEN 7 THEN '.PDF' WHEN 8 THEN '.exe' WHEN 9 THEN '' ELSE '.xlsx' END AS path
        FROM {documents}""",
    # The registry of indexed files; times are epoch seconds.
    "registry": """
        SELECT path, doc_id, sha256(text) AS sha256, split_part(path, '/', 1) AS product,
          CASE doc_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'txt' ELSE 'code' END AS file_type,
          CASE doc_id % 5 WHEN 0 THEN 'admin_guide' WHEN 1 THEN 'api_guide' WHEN 2 THEN 'document' WHEN 3 THEN 'standard' ELSE 'howto' END AS doc_type,
          CASE doc_id % 3 WHEN 0 THEN 'OpenText' WHEN 1 THEN '' ELSE 'ISO' END AS vendor,
          CASE doc_id % 6 WHEN 0 THEN 'API' WHEN 1 THEN 'Security' ELSE '' END AS subsystem,
          CASE doc_id % 8 WHEN 0 THEN 'Connectors' ELSE '' END AS module,
          CASE doc_id % 4 WHEN 0 THEN '23.4' WHEN 1 THEN '24.1' ELSE '' END AS version,
          CAST(floor(length / 520) AS BIGINT) + 1 AS chunks,
          CASE doc_id % 10 WHEN 7 THEN 'error' WHEN 8 THEN 'deleted' WHEN 9 THEN 'pending' ELSE 'ok' END AS status,
          CASE WHEN doc_id % 10 = 7 THEN 'cannot read ' || path END AS error_msg,
          1704067200 + (doc_id * 7919) % 7776000 AS indexed_at, length AS file_size,
          CASE doc_id % 6 WHEN 0 THEN 'draft,public' WHEN 1 THEN 'public' WHEN 2 THEN 'internal,draft,review' ELSE '' END AS tags
        FROM {files}""",
    # Requests to the knowledge base.
    "query_log": """
        SELECT event_id AS id, ts, event_type || ' help ' || CAST(user_id % 40 AS STRING) AS query_text,
          CAST(5 + event_id % 3 * 5 AS INT) AS top_k, user_id,
          CASE WHEN event_id % 7 = 0 THEN 0 ELSE event_id % 11 END AS result_count,
          CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN NULL ELSE CAST(400 + event_id % 601 AS DOUBLE) / 1000 END AS max_score,
          value * 20 AS latency_ms,
          CASE event_id % 3 WHEN 0 THEN NULL ELSE '{{"product": "P' || CAST(user_id % 6 AS STRING) || '"}}' END AS filters,
          CASE event_id % 4 WHEN 0 THEN '23.4' WHEN 1 THEN '24.1' END AS version_filter
        FROM {events}""",
    "jobs": """
        SELECT o_orderkey AS job_id, o_orderdate AS created_at, CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority,
          CASE o_orderkey % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'paused' WHEN 3 THEN 'completed' WHEN 4 THEN 'failed' ELSE 'cancelled' END AS status,
          1 + o_orderkey % 50 AS total_files, (o_orderkey * 7) % (1 + o_orderkey % 50) AS processed_files, CAST(1 + o_orderkey % 3600 AS DOUBLE) AS elapsed_s
        FROM {orders}""",
    # One changed metadata field of one document in one reclassification session.
    "history": """
        SELECT '2024-0' || CAST(1 + l_orderkey % 3 AS STRING) || '-1' || CAST(l_partkey % 10 AS STRING) || 'T0' || CAST(l_suppkey % 10 AS STRING) || '-00-00' AS session_timestamp,
          'docs/file' || CAST(l_orderkey % 4000 AS STRING) || '.pdf' AS source_file,
          CASE l_linenumber % 4 WHEN 0 THEN 'vendor' WHEN 1 THEN 'product' WHEN 2 THEN 'doc_type' ELSE 'subsystem' END AS field_name,
          l_returnflag || CAST(l_linenumber AS STRING) AS old_value, l_linestatus || CAST(l_suppkey % 5 AS STRING) AS new_value
        FROM {lineitem}""",
    "users": """
        SELECT c_custkey AS user_id, c_name AS username, c_mktsegment AS role, c_acctbal > 0 AS is_active, c_custkey % 17 = 0 AS erased,
          1704067200 + (c_custkey * 6007) % 7776000 AS created_at
        FROM {customer}""",
    "api_keys": """
        SELECT o_orderkey AS key_id, o_custkey AS user_id, 'kb_' || CAST(o_orderkey % 9973 AS STRING) AS prefix, o_orderpriority AS description,
          o_orderstatus = 'F' AS revoked, o_orderdate AS created_at
        FROM {orders}""",
    "erasure_requests": """
        SELECT c_custkey AS request_id, c_custkey % 97 AS user_id, CASE c_custkey % 3 WHEN 0 THEN 'requested' WHEN 1 THEN 'approved' ELSE 'completed' END AS status,
          1704067200 + (c_custkey * 4001) % 7776000 AS requested_at
        FROM {customer}""",
    # Remote pages as connector state.
    "remote": """
        SELECT CASE page_id % 3 WHEN 0 THEN 'wiki' WHEN 1 THEN 'issues' ELSE 'repo' END AS source_key, CAST(page_id AS STRING) AS remote_id, url AS remote_url, html,
          1704067200 + (page_id * 3571) % 7776000 AS remote_mtime, 1704067200 + (page_id * 2711) % 7776000 AS ingested_at,
          CASE WHEN page_id % 5 > 0 THEN 'c' || CAST(page_id % 97 AS STRING) END AS checkpoint
        FROM {pages}""",
    # One ranked list of retrieved items for each query: neighbours by label and number.
    "retrieved": """
        SELECT q.vec_id AS query_id, c.vec_id AS item, c.label = q.label AS relevant,
          CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY (c.vec_id * 31 + q.vec_id * 17) % 101, c.vec_id) AS INT) AS rank,
          CAST(1000 - (c.vec_id * 31 + q.vec_id * 17) % 101 AS DOUBLE) / 1000 AS score
        FROM (SELECT vec_id, label, each_of(1, 12) AS step FROM {embeddings}) q JOIN {embeddings} c ON c.vec_id = q.vec_id + q.step""",
    "runs": """
        SELECT 'run' || CAST(l_suppkey % 40 AS STRING) AS run_id, l_returnflag AS metric, round(avg(l_discount), 6) AS value, max(l_shipdate) AS ts
        FROM {lineitem} GROUP BY 1, 2""",
}

_NAME = re.compile(r"\{(\w+)\}")


def needs(sql: str) -> list[str]:
    """Views that a text names, those they rest on first."""
    out: list[str] = []
    for name in _NAME.findall(sql):
        if name in VIEWS:
            out += [n for n in [*needs(VIEWS[name]), name] if n not in out]
    return out


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or view as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    frames = {n: view(spark, sf_dir, n) for n in set(_NAME.findall(text))}
    text = re.sub(r"\bsha256\((\w+)\)", r"sha2(\1, 256)", text)
    return spark.sql(re.sub(r"\beach_of\(([^)]*)\)", r"explode(sequence(\1))", text), **frames)


def oracle(sql: str) -> str:
    """DuckDB SQL of a text that names tables and views in braces."""
    with_ = ", ".join(f"{n} AS ({_plain(VIEWS[n])})" for n in needs(sql))
    body = _plain(sql).strip()
    if not with_:
        return body
    return f"WITH {with_}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {with_} {body}"


def _plain(sql: str) -> str:
    sql = re.sub(r"\beach_of\(([^)]*)\)", r"unnest(generate_series(\1))", sql)
    return _NAME.sub(r"\1", sql).replace("{{", "{").replace("}}", "}")
