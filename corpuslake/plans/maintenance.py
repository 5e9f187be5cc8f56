"""Queries over chunk tables, registries, connector state and reclassification history."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslake.operators import tables
from corpuslake.plans.registry import query
from corpuslake.plans.views import view

_COLS = ["path", "product", "doc_type", "status", "chunks"]
_C = ", ".join(_COLS)
_FIELDS = ["vendor", "product", "subsystem", "doc_type"]


def _reg(spark, sf_dir):
    return view(spark, sf_dir, "registry")


def _split_tags(reg):
    return reg.withColumn("tags", F.filter(F.split("tags", ","), lambda t: t != ""))


_NEW = "SELECT CASE WHEN doc_id % 2 = 0 THEN path ELSE 'new/' || path END AS path, 'Fresh' AS product, doc_type, 'ok' AS status, chunks + 1 AS chunks FROM {registry} WHERE status = 'ok'"


def _fresh(spark, sf_dir):
    reg = _reg(spark, sf_dir).where("status = 'ok'")
    path = F.when(F.col("doc_id") % 2 == 0, F.col("path")).otherwise(F.concat(F.lit("new/"), "path"))
    return reg.select(path.alias("path"), F.lit("Fresh").alias("product"), "doc_type", "status", (F.col("chunks") + 1).alias("chunks"))


@query(f"WITH n AS ({_NEW}) SELECT {_C} FROM {{registry}} WHERE path NOT IN (SELECT path FROM n) UNION ALL SELECT {_C} FROM n")
def i1_upsert_chunks(spark, sf_dir):
    return tables.upsert(_reg(spark, sf_dir).select(*_COLS), _fresh(spark, sf_dir), "path")


@query("""
SELECT conv_id, turn, role FROM {conversations} WHERE conv_id NOT IN (SELECT conv_id FROM {conversations} WHERE turn = 3)
UNION ALL SELECT conv_id, turn + 100, role FROM {conversations} WHERE turn = 3""")
def i2_replace_document(spark, sf_dir):
    conv = view(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return tables.replace_documents(conv, conv.where("turn = 3").withColumn("turn", F.col("turn") + 100), "conv_id")


@query(f"SELECT {_C} FROM {{registry}} WHERE NOT (doc_type = 'howto' AND status = 'ok')")
def i3_delete_by_filter(spark, sf_dir):
    return tables.delete_by_filter(_reg(spark, sf_dir).select(*_COLS), {"doc_type": "howto", "status": "ok"})


@query(f"WITH n AS ({_NEW}) SELECT r.path, coalesce(n.product, r.product) AS product, r.doc_type, r.status, coalesce(n.chunks, r.chunks) AS chunks FROM {{registry}} r LEFT JOIN n ON r.path = n.path")
def i4_update_metadata(spark, sf_dir):
    return tables.update_fields(_reg(spark, sf_dir).select(*_COLS), _fresh(spark, sf_dir), ["path"], ["product", "chunks"])


@query("SELECT path, CASE WHEN product = 'ISO' THEN 'norm' ELSE tags END AS tags FROM {registry}")
def i5_set_tags(spark, sf_dir):
    reg = _reg(spark, sf_dir).select("path", "product", "tags")
    new = reg.where("product = 'ISO'").select("path", F.lit("norm").alias("tags"))
    return tables.update_fields(reg, new, ["path"], ["tags"]).select("path", "tags")


@query(r"""
WITH t AS (SELECT doc_id, list_filter(list_transform(string_split(text, ' '), lambda x: lower(regexp_replace(x, '^\s+|\s+$', '', 'g'))), lambda x: x <> '') AS l FROM {documents}),
d AS (SELECT doc_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM t)
SELECT doc_id, CAST(len(l) AS INT) AS n, CASE WHEN len(list_filter(l, lambda x: length(x) > 50)) > 0 THEN 'tag too long' WHEN len(list_filter(l, lambda x: regexp_matches(x, '\s'))) > 0 THEN 'tag with white space'
  WHEN len(l) > 20 THEN 'too many tags' END AS error FROM d""")
def i6_validate_tags(spark, sf_dir):
    docs = view(spark, sf_dir, "documents")
    clean, error = tables.valid_tags(F.split("text", " "))
    return docs.select("doc_id", F.size(clean).alias("n"), error.alias("error"))


_TAGS = "list_filter(string_split(tags, ','), lambda t: t <> '')"


@query(f"""SELECT path, array_to_string(list_filter(CASE WHEN list_contains({_TAGS}, 'review') THEN {_TAGS} ELSE list_append({_TAGS}, 'review') END, lambda t: t <> 'draft'), ',') AS tags FROM {{registry}}""")
def i7_edit_tags(spark, sf_dir):
    reg = _split_tags(_reg(spark, sf_dir))
    tags, _ = tables.edited_tags(F.col("tags"), F.array(F.lit("review")), F.array(F.lit("draft")))
    return reg.select("path", F.array_join(tags, ",").alias("tags"))


@query(f"SELECT path, array_to_string(list_filter({_TAGS}, lambda t: t <> 'draft'), ',') AS tags FROM {{registry}} WHERE list_contains({_TAGS}, 'draft')")
def i8_delete_tag(spark, sf_dir):
    reg = _split_tags(_reg(spark, sf_dir)).where(F.array_contains("tags", "draft"))
    return reg.select("path", F.array_join(F.array_remove("tags", "draft"), ",").alias("tags"))


@query(f"""SELECT tag, count(*) AS documents, substr(string_agg(DISTINCT product, ', ' ORDER BY product), 1, 30) AS products, substr(string_agg(DISTINCT doc_type, ', ' ORDER BY doc_type), 1, 30) AS doc_types
FROM (SELECT unnest({_TAGS}) AS tag, product, doc_type FROM {{registry}}) GROUP BY 1""")
def i9_tag_counts(spark, sf_dir):
    return tables.tag_counts(_split_tags(_reg(spark, sf_dir)), "tags")


@query("SELECT path, tags FROM {registry} WHERE status = 'ok' AND contains(tags, 'pub') ORDER BY path LIMIT 100")
def i10_tagged_documents(spark, sf_dir):
    return _reg(spark, sf_dir).where("status = 'ok' AND contains(tags, 'pub')").orderBy("path").limit(100).select("path", "tags")


@query("SELECT path FROM {registry} WHERE product = 'ISO' AND doc_type = 'howto'")
def i11_match_documents(spark, sf_dir):
    return tables.matching(_reg(spark, sf_dir), tables.parse_filter("product=ISO, doc_type=howto")).select("path")


@query("SELECT path, CASE WHEN vendor = 'ISO' THEN 'deleted' ELSE status END AS status, CASE WHEN vendor = 'ISO' THEN 0 ELSE chunks END AS chunks FROM {registry}")
def i12_remove_documents(spark, sf_dir):
    reg = _reg(spark, sf_dir)
    gone = tables.matching(reg, {"vendor": "ISO"}).select("path", F.lit("deleted").alias("status"), F.lit(0).cast("long").alias("chunks"))
    return tables.update_fields(reg.select("path", "status", "chunks"), gone, ["path"], ["status", "chunks"])


@query("SELECT path, indexed_at FROM {registry} WHERE status = 'pending' OR product = 'webreports'")
def i13_reingest_queue(spark, sf_dir):
    reg = _reg(spark, sf_dir)
    queued = tables.matching(reg, {"product": "webreports"}).select("path", F.lit("pending").alias("status"))
    now = tables.update_fields(reg.select("path", "status", "indexed_at"), queued, ["path"], ["status"])
    return tables.newest(now.where("status = 'pending'"), "indexed_at", "path").select("path", "indexed_at")


@query("SELECT path, CASE WHEN status = 'pending' AND vendor = 'ISO' THEN 'ok' ELSE status END AS status FROM {registry}")
def i13_cancel_reingest(spark, sf_dir):
    reg = _reg(spark, sf_dir)
    return tables.cancel_reingest(reg, tables.matching(reg, {"vendor": "ISO"})).select("path", "status")


@query("""SELECT path, CASE WHEN doc_id % 11 = 0 THEN 'pending' ELSE status END AS status, CASE WHEN doc_id % 11 = 0 THEN 0 ELSE chunks END AS left FROM {registry}""")
def i13_queue_reingest(spark, sf_dir):
    reg = _reg(spark, sf_dir)
    chunks = reg.select(F.col("path").alias("source_file"), F.explode(F.sequence(F.lit(1).cast("long"), "chunks")).alias("chunk_index"))
    left, marked = tables.queue_reingest(chunks, reg, reg.where("doc_id % 11 = 0"))
    counts = left.groupBy(F.col("source_file").alias("path")).agg(F.count(F.lit(1)).alias("left"))
    return marked.select("path", "status").join(counts, "path", "left").select("path", "status", F.coalesce("left", F.lit(0)).alias("left"))


@query("""SELECT path, action, tags FROM (SELECT path, 'set' AS action, tags, indexed_at AS moment FROM {registry} WHERE tags <> '' UNION ALL
SELECT path, 'clear' AS action, '' AS tags, indexed_at + 60 AS moment FROM {registry} WHERE status = 'deleted') ORDER BY moment DESC, path LIMIT 200""")
def i14_tag_audit(spark, sf_dir):
    reg = _reg(spark, sf_dir)
    log = reg.where("tags <> ''").select("path", F.lit("set").alias("action"), "tags", F.col("indexed_at").alias("at"))
    log = log.unionByName(reg.where("status = 'deleted'").select("path", F.lit("clear").alias("action"), F.lit("").alias("tags"), (F.col("indexed_at") + 60).alias("at")))
    return tables.newest(log, "at", "path", 200).select("path", "action", "tags")


# The fresh labels: every third document gets another vendor and subsystem.
_CHANGES = " UNION ALL ".join(
    f"SELECT path, '{f}' AS field_name, {f} AS old_value, {new} AS new_value, chunks AS chunk_count FROM {{registry}} WHERE doc_id % 2 = 0 AND {f} IS DISTINCT FROM {new}"
    for f, new in (("vendor", "CASE WHEN doc_id % 3 = 1 THEN 'OpenText' ELSE vendor END"), ("product", "product"), ("subsystem", "CASE WHEN doc_id % 3 = 1 THEN 'Admin' ELSE subsystem END"), ("doc_type", "doc_type"))
)


def _changes(spark, sf_dir):
    stored = _reg(spark, sf_dir).withColumn("chunk_count", F.col("chunks"))
    other = F.col("doc_id") % 3 == 1
    fresh = _reg(spark, sf_dir).where("doc_id % 2 = 0").withColumn("vendor", F.when(other, "OpenText").otherwise(F.col("vendor"))).withColumn("subsystem", F.when(other, "Admin").otherwise(F.col("subsystem")))
    return tables.field_changes(stored, fresh, "path", _FIELDS)


@query(_CHANGES)
def i15_detect_reclassification(spark, sf_dir):
    return _changes(spark, sf_dir)


@query(f"SELECT '2024-01-31T00-00-00' AS session_timestamp, path, field_name, old_value FROM ({_CHANGES})")
def i16_backup_metadata(spark, sf_dir):
    return _changes(spark, sf_dir).select(F.lit("2024-01-31T00-00-00").alias("session_timestamp"), "path", "field_name", "old_value")


@query(f"SELECT '2024-01-31T00-00-00' AS session_timestamp, path, field_name, old_value, new_value FROM ({_CHANGES})")
def i17_log_reclassification(spark, sf_dir):
    return _changes(spark, sf_dir).select(F.lit("2024-01-31T00-00-00").alias("session_timestamp"), "path", "field_name", "old_value", "new_value")


@query("""SELECT path, CASE WHEN doc_id % 6 = 4 THEN 'OpenText' ELSE vendor END AS vendor, CASE WHEN doc_id % 6 = 4 THEN 'Admin' ELSE subsystem END AS subsystem FROM {registry}""")
def i18_apply_reclassification(spark, sf_dir):
    wide = _changes(spark, sf_dir).groupBy("path").pivot("field_name", _FIELDS).agg(F.first("new_value"))
    return tables.update_fields(_reg(spark, sf_dir).select("path", *_FIELDS), wide, ["path"], _FIELDS).select("path", "vendor", "subsystem")


@query(f"SELECT field_name, old_value, new_value, count(*) AS documents FROM ({_CHANGES}) GROUP BY 1, 2, 3")
def i19_reclassification_preview(spark, sf_dir):
    return _changes(spark, sf_dir).groupBy("field_name", "old_value", "new_value").agg(F.count(F.lit(1)).alias("documents"))


@query(f"SELECT path, string_agg(field_name || ':' || old_value || '>' || new_value, ';' ORDER BY field_name) AS detail FROM ({_CHANGES}) GROUP BY 1")
def i20_verify_classification(spark, sf_dir):
    one = F.concat("field_name", F.lit(":"), "old_value", F.lit(">"), "new_value")
    return _changes(spark, sf_dir).groupBy("path").agg(F.array_join(F.array_sort(F.collect_list(one)), ";").alias("detail"))


@query("SELECT session_timestamp, count(DISTINCT source_file) AS documents, count(*) AS changes FROM {history} GROUP BY 1")
def i21_reclassify_sessions(spark, sf_dir):
    return tables.sessions(view(spark, sf_dir, "history")).orderBy(F.desc("session_timestamp"))


_RESTORED = """
WITH b AS (SELECT source_file, field_name, max(old_value) AS v FROM {{history}} h WHERE {where} AND session_timestamp = (SELECT max(session_timestamp) FROM {{history}} x WHERE x.source_file = h.source_file AND x.field_name = h.field_name AND {xwhere}) GROUP BY 1, 2),
f AS (SELECT DISTINCT source_file FROM {{history}})
SELECT f.source_file, coalesce(max(CASE WHEN field_name = 'vendor' THEN v END), 'now') AS vendor, coalesce(max(CASE WHEN field_name = 'product' THEN v END), 'now') AS product
FROM f LEFT JOIN b ON f.source_file = b.source_file GROUP BY 1"""


def _current(spark, sf_dir):
    return view(spark, sf_dir, "history").select("source_file").distinct().withColumns({f: F.lit("now") for f in _FIELDS})


@query(_RESTORED.format(where="session_timestamp = '2024-02-13T05-00-00'", xwhere="x.session_timestamp = '2024-02-13T05-00-00'"))
def i22_rollback_session(spark, sf_dir):
    backups = view(spark, sf_dir, "history").where("session_timestamp = '2024-02-13T05-00-00'")
    return tables.restore(_current(spark, sf_dir), backups, "source_file", _FIELDS).select("source_file", "vendor", "product")


@query(_RESTORED.format(where="session_timestamp < '2024-02-15' AND source_file LIKE 'docs/file1%.pdf'", xwhere="x.session_timestamp < '2024-02-15'"))
def i23_rollback_before(spark, sf_dir):
    backups = view(spark, sf_dir, "history").where((F.col("session_timestamp") < "2024-02-15") & F.col("source_file").rlike(tables.glob_pattern("docs/file1*.pdf")))
    return tables.restore(_current(spark, sf_dir), backups, "source_file", _FIELDS).select("source_file", "vendor", "product")


@query("SELECT session_timestamp, source_file, field_name FROM {history} WHERE session_timestamp >= '2024-02-01'")
def i24_prune_backups(spark, sf_dir):
    return view(spark, sf_dir, "history").where("session_timestamp >= '2024-02-01'").select("session_timestamp", "source_file", "field_name")


@query("SELECT session_timestamp, count(DISTINCT source_file) AS documents, count(*) AS changes FROM {history} WHERE session_timestamp >= '2024-03-12' GROUP BY 1")
def i25_recent_reclassifications(spark, sf_dir):
    return tables.sessions(view(spark, sf_dir, "history").where("session_timestamp >= '2024-03-12'"))


@query("SELECT source_file, count(*) AS n FROM {history} GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, source_file LIMIT 20")
def i26_most_reclassified(spark, sf_dir):
    n = view(spark, sf_dir, "history").groupBy("source_file").agg(F.count(F.lit(1)).alias("n"))
    return n.where("n > 1").orderBy(F.desc("n"), "source_file").limit(20)


@query("SELECT source_file, field_name, old_value, new_value FROM {history} WHERE contains(source_file, 'file12')")
def i27_history_search(spark, sf_dir):
    return view(spark, sf_dir, "history").where("contains(source_file, 'file12')").select("source_file", "field_name", "old_value", "new_value")


@query("SELECT path, sha256(text) AS sha256 FROM {files}")
def j1_content_hash(spark, sf_dir):
    return view(spark, sf_dir, "files").select("path", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


# The scan: even documents changed, every seventh is new.
_SCAN = "SELECT CASE WHEN doc_id % 7 = 0 THEN 'new/' || path ELSE path END AS path, CASE WHEN doc_id % 2 = 0 THEN 'x' || sha256 ELSE sha256 END AS sha256 FROM {registry}"


def _scan(spark, sf_dir):
    path = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("new/"), "path")).otherwise(F.col("path"))
    return _reg(spark, sf_dir).select(path.alias("path"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("x"), "sha256")).otherwise(F.col("sha256")).alias("sha256"))


@query(f"""SELECT s.path, CASE WHEN r.path IS NULL THEN 'new' WHEN status = 'error' THEN 'previous error - retrying' WHEN s.sha256 <> r.sha256 THEN 'content modified'
  WHEN status IN ('deleted', 'pending') THEN 'status ' || status ELSE 'no changes' END AS action FROM ({_SCAN}) s LEFT JOIN {{registry}} r ON s.path = r.path""")
def j2_plan_ingest(spark, sf_dir):
    return tables.plan_ingest(_scan(spark, sf_dir), _reg(spark, sf_dir))


@query(f"SELECT s.path FROM ({_SCAN}) s JOIN {{registry}} r ON s.path = r.path AND s.sha256 = r.sha256 AND status = 'ok'")
def j3_already_indexed(spark, sf_dir):
    return _scan(spark, sf_dir).join(_reg(spark, sf_dir).where("status = 'ok'"), ["path", "sha256"], "left_semi").select("path")


@query("SELECT path, CASE WHEN doc_id % 10 = 7 THEN 'ok' ELSE status END AS status, CASE WHEN doc_id % 10 = 7 THEN NULL ELSE error_msg END AS error_msg FROM {registry}")
def j4_mark_ok(spark, sf_dir):
    reg = _reg(spark, sf_dir).select("path", "status", "error_msg")
    done = reg.where("status = 'error'").select("path", F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error_msg"))
    return tables.upsert(reg, done, "path")


@query("""SELECT path, CASE WHEN doc_id % 6 = 0 THEN 'error' ELSE status END AS status, CASE WHEN doc_id % 6 = 0 THEN substr(repeat('no text in ' || path || ' ', 30), 1, 500) ELSE error_msg END AS error_msg, chunks FROM {registry}
UNION ALL SELECT 'lost/' || path, 'error', substr(repeat('no text in ' || path || ' ', 30), 1, 500), 0 FROM {registry} WHERE doc_id % 50 = 1""")
def j5_mark_error(spark, sf_dir):
    reg = _reg(spark, sf_dir)
    message = F.repeat(F.concat(F.lit("no text in "), "path", F.lit(" ")), 30).alias("message")
    known = reg.where("doc_id % 6 = 0").select("path", message)
    lost = reg.where("doc_id % 50 = 1").select(F.concat(F.lit("lost/"), "path").alias("path"), message)
    return tables.mark_errors(reg.select("path", "status", "error_msg", "chunks"), known.unionByName(lost))


@query(f"SELECT path, CASE WHEN status = 'ok' AND path NOT IN (SELECT path FROM ({_SCAN})) THEN 'deleted' ELSE status END AS status FROM {{registry}}")
def j6_sync_deleted(spark, sf_dir):
    return tables.mark_missing(_reg(spark, sf_dir).select("path", "status"), _scan(spark, sf_dir))


@query("SELECT path, status FROM {registry} WHERE status <> 'deleted'")
def j7_purge(spark, sf_dir):
    return _reg(spark, sf_dir).where("status <> 'deleted'").select("path", "status")


@query("SELECT path, status FROM {registry} WHERE status NOT IN ('error', 'failed')")
def j7_delete_failed(spark, sf_dir):
    return tables.delete_with_status(_reg(spark, sf_dir), "error", "failed").select("path", "status")


@query("SELECT r.product, r.n, 0 AS left FROM (SELECT product, count(*) AS n FROM {registry} GROUP BY 1) r")
def j7_reset(spark, sf_dir):
    """Rows of each product before and after."""
    reg = _reg(spark, sf_dir)
    left = tables.delete_with_status(reg).groupBy("product").agg(F.count(F.lit(1)).alias("left"))
    return reg.groupBy("product").agg(F.count(F.lit(1)).alias("n")).join(left, "product", "left").select("product", "n", F.coalesce("left", F.lit(0)).cast("int").alias("left"))


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'error') AS errors, count(*) FILTER (WHERE status = 'deleted') AS deleted,
CAST(sum(chunks) AS BIGINT) AS chunks, min(indexed_at) AS first_indexed, max(indexed_at) AS last_indexed FROM {registry}""")
def j8_registry_summary(spark, sf_dir):
    return tables.registry_summary(_reg(spark, sf_dir))


@query("""WITH r AS (SELECT *, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '(root)' END AS source FROM {registry})
SELECT CASE WHEN grouping(source) = 1 THEN 'TOTAL' ELSE source END AS source, count(*) AS files, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'error') AS errors,
CAST(sum(chunks) AS BIGINT) AS chunks, max(indexed_at) AS last_indexed FROM r GROUP BY ROLLUP (source)""")
def j9_per_source_summary(spark, sf_dir):
    return tables.per_source(_reg(spark, sf_dir))


@query("SELECT path, error_msg FROM {registry} WHERE status = 'error'")
def j10_list_errors(spark, sf_dir):
    return tables.newest(_reg(spark, sf_dir).where("status = 'error'"), "indexed_at", "path").select("path", "error_msg")


@query("SELECT path, indexed_at FROM {registry} WHERE vendor = 'OpenText' AND indexed_at BETWEEN 1705000000 AND 1711000000 ORDER BY file_size DESC, path LIMIT 25 OFFSET 25")
def j11_browse_documents(spark, sf_dir):
    reg = tables.matching(_reg(spark, sf_dir), {"vendor": "OpenText"}).where(F.col("indexed_at").between(1705000000, 1711000000))
    return tables.page(reg, [F.desc("file_size"), F.col("path")], 25, 25).select("path", "indexed_at")


@query("SELECT path FROM {registry} WHERE status = 'ok' ORDER BY indexed_at DESC, path LIMIT 20 OFFSET 40")
def j12_recent_documents_page(spark, sf_dir):
    return tables.page(_reg(spark, sf_dir).where("status = 'ok'"), [F.desc("indexed_at"), F.col("path")], 40, 20).select("path")


@query("SELECT s.status, count(r.path) AS n FROM (SELECT unnest(['completed', 'ok', 'error', 'pending']) AS status) s LEFT JOIN {registry} r ON s.status = r.status GROUP BY 1")
def j13_status_counts(spark, sf_dir):
    return tables.status_counts(_reg(spark, sf_dir), ["completed", "ok", "error", "pending"])


@query("SELECT status, count(*) AS files, CAST(sum(chunks) AS BIGINT) AS chunks FROM {registry} GROUP BY 1")
def j14_ingest_outcomes(spark, sf_dir):
    return _reg(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("files"), F.sum("chunks").alias("chunks"))


@query("SELECT sha256, count(*) AS n, min(path) AS first_path FROM {registry} GROUP BY 1 HAVING count(*) > 1")
def j15_duplicate_files(spark, sf_dir):
    return tables.duplicates(_reg(spark, sf_dir))


@query("""SELECT source_key, remote_id, ingested_at FROM {remote} WHERE NOT (source_key = 'wiki') UNION ALL SELECT source_key, remote_id, ingested_at + 5 FROM {remote} WHERE source_key = 'wiki'
UNION ALL SELECT 'wiki', 'n' || remote_id, ingested_at FROM {remote} WHERE source_key = 'repo'""")
def j17_connector_upsert(spark, sf_dir):
    state = view(spark, sf_dir, "remote").select("source_key", "remote_id", "ingested_at")
    new = state.where("source_key = 'wiki'").withColumn("ingested_at", F.col("ingested_at") + 5)
    new = new.unionByName(state.where("source_key = 'repo'").select(F.lit("wiki").alias("source_key"), F.concat(F.lit("n"), "remote_id").alias("remote_id"), "ingested_at"))
    return tables.upsert(state, new, "source_key", "remote_id")


@query("SELECT remote_id, ingested_at FROM {remote} WHERE source_key = 'issues'")
def j18_connector_list(spark, sf_dir):
    state = tables.matching(view(spark, sf_dir, "remote"), {"source_key": "issues"})
    return tables.newest(state, "ingested_at", "remote_id").select("remote_id", "ingested_at")


@query("SELECT source_key, remote_id, remote_url, ingested_at FROM {remote} WHERE source_key = 'wiki' AND remote_id = '6'")
def j18_connector_get(spark, sf_dir):
    return tables.connector_get(view(spark, sf_dir, "remote"), "wiki", "6").select("source_key", "remote_id", "remote_url", "ingested_at")


@query("SELECT source_key, remote_id FROM {remote} WHERE NOT (source_key = 'repo' OR (source_key = 'wiki' AND CAST(remote_id AS BIGINT) % 2 = 0))")
def j18_connector_delete(spark, sf_dir):
    """A whole source, and single documents of another."""
    state = view(spark, sf_dir, "remote").select("source_key", "remote_id")
    one = state.where("source_key = 'wiki' AND CAST(remote_id AS BIGINT) % 2 = 0")
    whole = state.where("source_key = 'repo'").select("source_key", F.lit(None).cast("string").alias("remote_id"))
    return tables.connector_delete(state, one.unionAll(whole))


@query("""SELECT source_key, max(checkpoint) AS checkpoint FROM {remote} r WHERE checkpoint IS NOT NULL AND ingested_at = (SELECT max(ingested_at) FROM {remote} x WHERE x.source_key = r.source_key AND x.checkpoint IS NOT NULL) GROUP BY 1""")
def j19_sync_checkpoint(spark, sf_dir):
    return tables.latest_checkpoints(view(spark, sf_dir, "remote"))


@query("SELECT source_key, strftime(make_timestamp(max(remote_mtime) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS checkpoint FROM {remote} GROUP BY 1")
def j20_advance_checkpoint(spark, sf_dir):
    return tables.next_checkpoints(view(spark, sf_dir, "remote"))


@query("SELECT remote_id FROM {remote} WHERE remote_mtime >= 1704500000")
def j21_changed_since(spark, sf_dir):
    return view(spark, sf_dir, "remote").where("remote_mtime >= 1704500000").select("remote_id")


@query("SELECT source_key, count(*) AS fetched, count(*) FILTER (WHERE checkpoint IS NULL) AS errors FROM {remote} GROUP BY 1")
def j22_sync_result_counts(spark, sf_dir):
    return view(spark, sf_dir, "remote").groupBy("source_key").agg(F.count(F.lit(1)).alias("fetched"), F.count_if(F.col("checkpoint").isNull()).alias("errors"))


@query("SELECT product, count(*) AS n FROM {registry} GROUP BY 1")
def j23_documents_per_product(spark, sf_dir):
    return _reg(spark, sf_dir).groupBy("product").agg(F.count(F.lit(1)).alias("n"))


_OK = "list_contains(['pdf', 'docx', 'txt', 'md', 'py', 'json', 'xlsx'], lower(regexp_extract(string_split(path, '/')[-1], '^.+\\.([^.]+)$', 1)))"


@query(f"""WITH f AS (SELECT f.path, f.text, f.length, r.status AS old, {_OK.replace('path', 'f.path')} AS fits FROM {{files}} f JOIN {{registry}} r ON f.path = r.path)
SELECT path, CASE WHEN old = 'ok' THEN 'ok' WHEN fits AND length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 30 THEN 'ok' ELSE 'error' END AS status FROM f""")
def j16_ingest_corpus(spark, sf_dir):
    from corpuslake.operators.ingest import ingest_corpus

    _, registry = ingest_corpus(view(spark, sf_dir, "files").select("path", "text", "length"), _reg(spark, sf_dir).select("path", "sha256", "status"))
    return registry.select("path", "status")
