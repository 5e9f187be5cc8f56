"""Queries over files and chunks: scanning, text, validation, classification, chunking, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslake.functions import paths
from corpuslake.functions import text as tx
from corpuslake.operators import chunks, validation
from corpuslake.plans.registry import query
from corpuslake.plans.views import view


def _case(text: str, rules, other: str = "NULL") -> str:
    """SQL that gives the label of the first rule found in ``text``."""
    arms = " ".join(f"WHEN regexp_matches({text}, '{'|'.join(f'(?:{p})' for p in ps)}', 'i') THEN '{label}'" for label, ps in rules)
    return f"CASE {arms} ELSE {other} END"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _map(column: str, pairs, other: str = "NULL") -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v if isinstance(v, int) else repr(v)}" for k, v in pairs) + f" ELSE {other} END"


# Path parts in SQL.
_PARTS = r"""p AS (
  SELECT *, string_split(path, '/') AS parts, len(string_split(path, '/')) AS k, string_split(path, '/')[-1] AS name FROM {files}),
q AS (SELECT *, regexp_replace(name, '^(.+)\.[^.]+$', '\1') AS stem, lower(regexp_extract(name, '^.+\.([^.]+)$', 1)) AS ext,
  parts[1:k - 1] AS folders, CASE WHEN k > 1 THEN parts[1] ELSE '' END AS root FROM p)"""
_ALIASES = list(paths.PRODUCT_ALIASES)
_PRODUCT = (
    "coalesce(CASE WHEN root <> '' THEN coalesce(" + _map("lower(root)", _ALIASES) + ", CASE "
    + " ".join(f"WHEN contains(lower(root), '{a}') OR contains('{a}', lower(root)) THEN '{p}'" for a, p in _ALIASES)
    + f" END, CASE WHEN lower(root) NOT IN {_in(paths.PLAIN_FOLDERS)} THEN root END) END, "
    + _case("regexp_replace(lower(stem), '[_\\-]', ' ', 'g')", paths.PRODUCT_NAMES) + ", 'geral')"
)
_DOC_TYPE = (
    f"CASE WHEN ext IN {_in(paths.ARTIFACT_SUFFIXES)} THEN 'release_artifact' ELSE "
    + _case("regexp_replace(lower(stem || ' ' || array_to_string(parts[greatest(k - 1, 1):k], ' ')), '[_\\-/\\\\]', ' ', 'g')", paths.DOC_TYPE_RULES, "'document'") + " END"
)
_VENDOR_RE = "|".join(f"(?:{p})" for _, ps in paths.VENDOR_NAMES for p in ps)
_VENDOR = (
    f"CASE WHEN regexp_matches(regexp_replace(lower(stem || ' ' || path), '[_\\-/\\\\]', ' ', 'g'), '{_VENDOR_RE}', 'i') "
    f"OR len(list_filter(folders, lambda d: regexp_matches(regexp_replace(regexp_replace(lower(d), '^(.+)\\.[^.]+$', '\\1'), '[_\\-/]', ' ', 'g'), '{_VENDOR_RE}', 'i'))) > 0 THEN 'OpenText' "
    + " ".join(f"WHEN product IN {_in(ps)} THEN '{v}'" for v, ps in paths.VENDOR_PRODUCTS) + " WHEN contains(product, 'ISO') THEN 'ISO' ELSE '' END"
)
_NAMED = f"list_filter(folders, lambda d: lower(d) NOT IN {_in(paths.PLAIN_FOLDERS)})"
_SUBSYSTEM = f"CASE WHEN len(folders) >= 2 AND len({_NAMED}) >= 2 THEN {_NAMED}[2] ELSE " + _case("regexp_replace(lower(stem), '[_\\-/]', ' ', 'g')", paths.SUBSYSTEM_NAMES, "''") + " END"
_MODULE = "CASE " + " ".join(f"WHEN product = '{p}' AND regexp_matches(path, '{r}', 'i') THEN '{m}'" for p, rules in paths.MODULE_FOLDERS for r, m in rules) + " ELSE '' END"
_VERSION = "coalesce(" + ", ".join(f"nullif(regexp_extract(coalesce({s}, ''), '{p}', 0, 'i'), '')" for s in ("name", "parts[k - 1]", "CASE WHEN k > 2 THEN parts[k - 2] END") for p in paths.VERSION_PATTERNS) + ")"
_CLASSIFIED = f"WITH {_PARTS}, c AS (SELECT *, {_PRODUCT} AS product FROM q) "


def _plain(sql: str) -> str:
    """Braces of patterns are doubled, those of view names are not."""
    return sql.replace("{", "{{").replace("}", "}}").replace("{{files}}", "{files}")


@query(_plain(f"WITH {_PARTS} SELECT path, {_map('ext', paths.FILE_TYPES.items())} AS file_type FROM q WHERE {_map('ext', paths.FILE_TYPES.items())} IS NOT NULL"))
def a2_file_type_of(spark, sf_dir):
    files = view(spark, sf_dir, "files").select("path", paths.file_type_of(F.col("path")).alias("file_type"))
    return files.where("file_type IS NOT NULL")


@query("SELECT doc_id, n_chars, lang, source FROM {documents}")
def a4_scan_parquet(spark, sf_dir):
    return view(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")


_STAGED = "'source: ' || source_key || chr(10) || 'url: ' || remote_url || chr(10) || 'mtime: ' || CAST(remote_mtime AS VARCHAR) || chr(10) || '---' || chr(10) || html"


@query(f"SELECT source_key || '__' || regexp_replace(remote_url, '[^A-Za-z0-9]', '_', 'g') || '__' || remote_id || '.md' AS file_name, sha256({_STAGED}) AS body_hash FROM {{remote}}")
def a11_stage_documents(spark, sf_dir):
    from corpuslake.sources.staging import stage_documents

    staged = stage_documents(view(spark, sf_dir, "remote"))
    return staged.select("file_name", F.sha2("staged", 256).alias("body_hash"))


@query("SELECT remote_id, 'source=' || source_key || ',url=' || remote_url || ',mtime=' || CAST(remote_mtime AS VARCHAR) AS header FROM {remote}")
def a12_parse_staged_header(spark, sf_dir):
    from corpuslake.sources.staging import parse_header, stage_documents

    staged = stage_documents(view(spark, sf_dir, "remote")).withColumn("h", parse_header(F.col("staged")))
    value = lambda k: F.concat(F.lit(f"{k}="), F.element_at("h", k))
    return staged.select("remote_id", F.concat_ws(",", value("source"), value("url"), value("mtime")).alias("header"))


@query("SELECT path, sha256, product, doc_type, status, chunks FROM {registry} WHERE status = 'ok' AND doc_type = 'howto'")
def a13_export_registry(spark, sf_dir):
    from corpuslake.sources.exports import select_registry

    return select_registry(view(spark, sf_dir, "registry"), status="ok", doc_type="howto").select("path", "sha256", "product", "doc_type", "status", "chunks")


@query("SELECT doc_id, sha256(text) AS h FROM {documents}")
def b1_text_sections(spark, sf_dir):
    content = view(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    return content.select("doc_id", F.sha2(F.decode("content", "UTF-8"), 256).alias("h"))


@query("SELECT doc_id, sha256('```' || lang || chr(10) || text || chr(10) || '```') AS h FROM {documents}")
def b2_code_sections(spark, sf_dir):
    docs = view(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha2(tx.fenced(F.col("text"), F.col("lang")), 256).alias("h"))


@query(r"""SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '[^\x{00}-\x{FF}]', '?', 'g'), '[^\x20-\x7E\x{80}-\x{FF}\n\r\t]', ' ', 'g'), ' {{3,}}', ' ', 'g'),
  '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')) AS h FROM {pages}""")
def b8_wordperfect_text(spark, sf_dir):
    pages = view(spark, sf_dir, "pages").withColumn("html", F.regexp_replace("html", r"[^\x00-\xFF]", "?"))
    return pages.select("page_id", F.md5(tx.wordperfect_text(F.encode("html", "ISO-8859-1")).cast("binary")).alias("h"))


@query("""WITH o AS (SELECT path, file_size, file_type, doc_id % 10 < 7 AS first, doc_id % 10 < 9 AS second, CAST(1 + doc_id % 40 AS DOUBLE) AS s FROM {registry})
SELECT file_type, count(*) AS files, round(100.0::DOUBLE * count(*) FILTER (WHERE first) / count(*), 4) AS primary_share, round(100.0::DOUBLE * count(*) FILTER (WHERE NOT first AND second) / count(*), 4) AS fallback_share,
  round(100.0::DOUBLE * count(*) FILTER (WHERE NOT first AND NOT second) / count(*), 4) AS failed_share, round(avg(s), 4) AS mean_seconds,
  coalesce((SELECT string_agg(path, ',' ORDER BY file_size DESC, path) FROM (SELECT * FROM o x WHERE x.file_type = o.file_type AND NOT first AND NOT second ORDER BY file_size DESC, path LIMIT 5)), '') AS largest_failures FROM o GROUP BY 1""")
def b12_extractor_audit(spark, sf_dir):
    from corpuslake.operators.tables import extractor_audit

    n = F.col("doc_id") % 10
    outcomes = view(spark, sf_dir, "registry").select("path", "file_size", "file_type", (n < 7).alias("first"), (n < 9).alias("second"), (1 + F.col("doc_id") % 40).cast("double").alias("seconds"))
    return extractor_audit(outcomes, "file_type")


_MD = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<br\s*/?>', chr(10), 'g'), '</p>', chr(10) || chr(10), 'g'), '</li>', chr(10), 'g'), '<[^>]+>', '', 'g')"
for _name, _char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("#x27", "''"), ("nbsp", " "), ("amp", "&")):
    _MD = f"replace({_MD}, '&{_name};', '{_char}')"


@query(rf"""SELECT page_id, sha256(array_to_string(list_filter(list_transform(string_split_regex({_MD}, '\r\n|\r|\n'),
  lambda x: regexp_replace(x, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')), lambda x: x <> ''), chr(10))) AS h FROM {{pages}}""")
def b10_html_to_markdown(spark, sf_dir):
    return view(spark, sf_dir, "pages").select("page_id", F.sha2(tx.html_to_markdown(F.col("html")), 256).alias("h"))


_CHECKED = f"""WITH {_PARTS}, r AS (SELECT path, length, text, ext,
  CASE WHEN length = 0 THEN 'exists' END AS c1,
  CASE WHEN ext = '' OR ext NOT IN {_in(validation.ALLOWED)} THEN 'extension' END AS c2,
  CASE WHEN {_map('ext', validation.MEDIA.items())} IS NULL THEN 'media?' WHEN NOT regexp_matches({_map('ext', validation.MEDIA.items())}, '^(text/|application/|image/)') THEN 'media' END AS c3,
  CASE WHEN length < 1 OR length > 104857600 THEN 'size' END AS c4,
  CASE WHEN length > {_map('ext', validation.SIZES.items(), '104857600')} THEN 'size_by_type' END AS c5,
  CASE WHEN ext IN {_in(validation.TEXT_TYPES)} AND (length(regexp_replace(substr(text, 1, 10000), '^\\s+|\\s+$', '', 'g')) < 10
    OR len(regexp_extract_all(substr(text, 1, 10000), '[^ \\t\\n\\x0B\\f\\r]+')) < 5) THEN 'text' END AS c8,
  CASE WHEN length(path) > 255 OR length(name) > 255 OR regexp_matches(name, '[<>:"|?*\\x00-\\x1F]') THEN 'path' END AS c9 FROM q) """


def _checks():
    path, length, text = F.col("path"), F.col("length"), F.col("text")
    return {
        "c1": validation.check_exists(path, length), "c2": validation.check_extension(path), "c3": validation.check_media(path), "c4": validation.check_size(length),
        "c5": validation.check_size_by_type(path, length), "c8": validation.check_text(path, text), "c9": validation.check_path(path),
    }


def _check(spark, sf_dir, name: str):
    files = view(spark, sf_dir, "files").withColumn("r", _checks()[name])
    return files.select("path", F.col("r.valid").alias("valid"))


@query(_plain(_CHECKED + "SELECT path, c1 IS NULL AS valid FROM r"))
def c1_check_exists(spark, sf_dir):
    return _check(spark, sf_dir, "c1")


@query(_plain(_CHECKED + "SELECT path, c2 IS NULL AS valid FROM r"))
def c2_check_extension(spark, sf_dir):
    return _check(spark, sf_dir, "c2")


@query(_plain(_CHECKED + "SELECT path, c3 IS NULL AS valid FROM r"))
def c3_check_mime(spark, sf_dir):
    return _check(spark, sf_dir, "c3")


@query(_plain(_CHECKED + "SELECT path, c4 IS NULL AS valid FROM r"))
def c4_check_size(spark, sf_dir):
    return _check(spark, sf_dir, "c4")


@query(_plain(_CHECKED + "SELECT path, c5 IS NULL AS valid FROM r"))
def c5_check_size_by_type(spark, sf_dir):
    return _check(spark, sf_dir, "c5")


@query(_plain(f"WITH {_PARTS} SELECT path, NOT (ext IN {_in(validation.TEXT_TYPES)} AND doc_id % 3 = 0 AND length(text) > 2) AS valid FROM q"))
def c6_check_encoding(spark, sf_dir):
    # Every third file gets a byte that no UTF-8 text has.
    broken = F.when((F.col("doc_id") % 3 == 0) & (F.length("text") > 2), F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FF")))).otherwise(F.col("text").cast("binary"))
    files = view(spark, sf_dir, "files").withColumn("r", validation.check_encoding(F.col("path"), broken))
    return files.select("path", F.col("r.valid").alias("valid"))


@query(_plain(f"WITH {_PARTS} SELECT path, ext NOT IN {_in(validation.SIGNATURES)} OR (doc_id % 2 = 0 AND ext = 'pdf') AS valid FROM q"))
def c7_check_signature(spark, sf_dir):
    content = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("%PDF-1.7 "), F.col("text"))).otherwise(F.concat(F.lit("-"), F.col("text"))).cast("binary")
    files = view(spark, sf_dir, "files").withColumn("r", validation.check_signature(F.col("path"), content))
    return files.select("path", F.col("r.valid").alias("valid"))


@query(_plain(_CHECKED + "SELECT path, c8 IS NULL AS valid FROM r"))
def c8_check_text(spark, sf_dir):
    return _check(spark, sf_dir, "c8")


@query(_plain(_CHECKED + "SELECT path, c9 IS NULL AS valid FROM r"))
def c9_check_path(spark, sf_dir):
    return _check(spark, sf_dir, "c9")


def _validated(spark, sf_dir):
    return validation.validate(view(spark, sf_dir, "files"), list(_checks().values()))


# A result stops the list if it is an ERROR; "media?", "exists", "text" and "path" only warn.
_FAIL_FAST = "CASE WHEN c2 IS NOT NULL THEN 2 WHEN c3 = 'media' THEN 3 WHEN c4 IS NOT NULL AND length > 1 THEN 4 WHEN c5 IS NOT NULL THEN 5 ELSE 7 END"
_FAILED = f"list_filter(list_transform([c1, c2, c3, c4, c5, c8, c9][1:{_FAIL_FAST}], lambda x: replace(x, '?', '')), lambda x: x IS NOT NULL)"


@query(_plain(_CHECKED + f"SELECT path, CAST({_FAIL_FAST} AS INT) AS checks_run, len({_FAILED}) = 0 AS valid FROM r"))
def c10_validate_corpus(spark, sf_dir):
    return _validated(spark, sf_dir).select("path", F.size("results").alias("checks_run"), "valid")


@query(_plain(_CHECKED + f"SELECT path, unnest({_FAILED}) AS failed FROM r"))
def c11_failure_reasons(spark, sf_dir):
    return validation.failure_reasons(_validated(spark, sf_dir), "path").select("path", F.substring_index("reason", ":", 1).alias("failed"))


@query("""SELECT doc_id, CASE WHEN b < 1024 THEN printf('%.1f B', CAST(b AS DOUBLE)) WHEN b < 1048576 THEN printf('%.1f KB', b / 1024.0::DOUBLE)
  WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576.0::DOUBLE) WHEN b < 1099511627776 THEN printf('%.1f GB', b / 1073741824.0::DOUBLE)
  ELSE printf('%.1f TB', b / 1099511627776.0::DOUBLE) END AS size
FROM (SELECT doc_id, n_chars * n_chars * n_chars AS b FROM {documents})""")
def c12_format_bytes(spark, sf_dir):
    return view(spark, sf_dir, "documents").select("doc_id", tx.format_bytes(F.col("n_chars") * F.col("n_chars") * F.col("n_chars")).alias("size"))


def _labels(spark, sf_dir):
    return paths.classified(view(spark, sf_dir, "files").select("path"))


@query(_plain(_CLASSIFIED + f"SELECT path, {_DOC_TYPE} AS doc_type FROM c"))
def d1_infer_doc_type(spark, sf_dir):
    return _labels(spark, sf_dir).select("path", "doc_type")


@query(_plain(_CLASSIFIED + "SELECT path, product FROM c"))
def d2_infer_product(spark, sf_dir):
    return _labels(spark, sf_dir).select("path", "product")


@query(_plain(_CLASSIFIED + f"SELECT path, {_VENDOR} AS vendor FROM c"))
def d3_infer_vendor(spark, sf_dir):
    return _labels(spark, sf_dir).select("path", "vendor")


@query(_plain(_CLASSIFIED + f"SELECT path, {_SUBSYSTEM} AS subsystem FROM c"))
def d4_infer_subsystem(spark, sf_dir):
    return _labels(spark, sf_dir).select("path", "subsystem")


@query(_plain(_CLASSIFIED + f"SELECT path, {_MODULE} AS module FROM c"))
def d5_infer_module(spark, sf_dir):
    return _labels(spark, sf_dir).select("path", "module")


@query(_plain(_CLASSIFIED + f"SELECT path, {_VERSION} AS version FROM c"))
def d6_extract_version(spark, sf_dir):
    return _labels(spark, sf_dir).select("path", "version")


@query(_plain(_CLASSIFIED + f"""SELECT path, coalesce(CASE WHEN doc_id % 5 = 0 THEN 'user_guide' END, CASE WHEN root = 'ISO' THEN 'standard' END, {_DOC_TYPE}) AS doc_type,
  coalesce(CASE WHEN root = 'ISO' THEN 'Standards' END, product) AS product FROM c"""))
def d7_apply_overrides(spark, sf_dir):
    from corpuslake.operators.overrides import apply_overrides

    files = view(spark, sf_dir, "files")
    root = F.element_at(F.split("path", "/"), 1)
    by_file = files.where("doc_id % 5 = 0").select("path", F.lit("user_guide").alias("doc_type"), F.lit(None).cast("string").alias("product"))
    by_folder = files.select(root.alias("folder")).where("folder = 'ISO'").distinct().select("folder", F.lit("standard").alias("doc_type"), F.lit("Standards").alias("product"))
    return apply_overrides(_labels(spark, sf_dir).withColumn("folder", root), by_file, by_folder, ["doc_type", "product"]).select("path", "doc_type", "product")


@query(_plain(_CLASSIFIED + f"SELECT path, {_DOC_TYPE} AS doc_type, product, {_VENDOR} AS vendor, {_SUBSYSTEM} AS subsystem, {_MODULE} AS module, {_VERSION} AS version FROM c"))
def d9_classify(spark, sf_dir):
    return _labels(spark, sf_dir)


@query("""SELECT path, doc_type FROM {registry} WHERE doc_type NOT IN ('howto', 'standard')""")
def d10_strip_valid_doc_types(spark, sf_dir):
    return view(spark, sf_dir, "registry").where(~F.col("doc_type").isin("howto", "standard")).select("path", "doc_type")


def _pieces(size: int, overlap: int) -> str:
    step = max(1, size - overlap)
    return f"SELECT doc_id, CAST(s / {step} AS INT) AS pos, substr(text, CAST(s AS BIGINT) + 1, {size}) AS chunk FROM (SELECT doc_id, text, unnest(generate_series(0, length(text) - 1, {step})) AS s FROM {{documents}})"


@query(f"SELECT doc_id, pos, md5(chunk) AS h FROM ({_pieces(1000, 200)}) WHERE length(chunk) >= 30")
def e1_chunk_fixed(spark, sf_dir):
    docs = view(spark, sf_dir, "documents").select("doc_id", "text")
    return chunks.chunk_fixed(docs, 1000, 200).select("doc_id", "pos", F.md5(F.col("chunk").cast("binary")).alias("h"))


@query(f"SELECT source, lang, count(*) AS chunks, CAST(sum(length(chunk)) AS BIGINT) AS chars FROM ({_pieces(600, 80)}) JOIN {{documents}} USING (doc_id) GROUP BY 1, 2")
def e2_chunk_fixed_keep(spark, sf_dir):
    docs = view(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return chunks.chunk_fixed(docs, 600, 80, 0).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("chunk")).cast("long").alias("chars"))


@query()
def e3_chunk_recursive(spark, sf_dir):
    docs = view(spark, sf_dir, "documents").select("doc_id", "text")
    return chunks.chunk_recursive(docs, 600, 80).select("doc_id", "pos", F.length("chunk").alias("chars"))


@query("""
WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS para, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM {documents}),
w AS (SELECT doc_id, p, len(regexp_extract_all(para, '[^ \\t\\n\\x0B\\f\\r]+')) AS w FROM p WHERE length(regexp_replace(para, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')) > 0),
b AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w)
SELECT doc_id, CAST(floor(before / 120) AS INT) AS pos, CAST(sum(w) AS BIGINT) AS words FROM b GROUP BY 1, 2""")
def e4_chunk_semantic(spark, sf_dir):
    return chunks.chunk_semantic(view(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", 120).select("doc_id", "pos", F.col("words").cast("long").alias("words"))


_SIZE = _map("file_type", [(k, v[0]) for k, v in chunks.CHUNK_SETTINGS.items()], "600")
_OVER = _map("file_type", [(k, v[1]) for k, v in chunks.CHUNK_SETTINGS.items()], "80")


@query(f"SELECT path, {_SIZE} AS size, {_OVER} AS overlap, CAST(ceil(file_size / ({_SIZE} - {_OVER})::DOUBLE) AS BIGINT) AS windows FROM {{registry}}")
def e5_chunk_settings_by_type(spark, sf_dir):
    reg = view(spark, sf_dir, "registry")
    size, overlap = chunks.settings_by_type(F.col("file_type"))
    return reg.select("path", size.alias("size"), overlap.alias("overlap"), F.ceil(F.col("file_size") / (size - overlap)).alias("windows"))


@query(f"SELECT doc_id, pos FROM ({_pieces(300, 40)}) WHERE length(regexp_replace(chunk, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')) >= 30")
def e6_drop_short_chunks(spark, sf_dir):
    docs = view(spark, sf_dir, "documents").select("doc_id", "text")
    return chunks.drop_short(chunks.chunk_fixed(docs, 300, 40, 0)).select("doc_id", "pos")


@query("""
WITH s AS (SELECT conv_id, turn, CAST(s / 150 AS INT) AS pos, substr(text, CAST(s AS BIGINT) + 1, 200) AS chunk
  FROM (SELECT conv_id, turn, text, unnest(generate_series(0, length(text) - 1, 150)) AS s FROM {conversations}))
SELECT conv_id, turn, pos, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) - 1 AS INT) AS chunk_index FROM s WHERE length(chunk) >= 30""")
def e7_number_chunks(spark, sf_dir):
    sections = view(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return chunks.number_chunks(chunks.chunk_fixed(sections, 200, 50), "conv_id", "turn", "pos").select("conv_id", "turn", "pos", "chunk_index")


@query()
def e8_chunk_corpus(spark, sf_dir):
    docs = view(spark, sf_dir, "files").select("path", F.lit(0).alias("section"), "text")
    cut = chunks.number_chunks(chunks.chunk_recursive(docs, 600, 80), "path", "section", "pos")
    chunk_id = F.sha2(F.concat_ws("::", "path", F.col("chunk_index").cast("string"), "chunk"), 256)
    return cut.select(chunk_id.alias("chunk_id"), "path", "chunk_index", F.length("chunk").alias("chars"))


@query("SELECT doc_id, CASE WHEN length(text) = 0 THEN 'no content extracted' ELSE 'chunks empty after split' END AS error FROM {documents} WHERE length(text) < 30")
def e10_documents_without_chunks(spark, sf_dir):
    docs = view(spark, sf_dir, "documents").select("doc_id", "text")
    made = chunks.chunk_fixed(docs, 600, 80).select("doc_id").distinct()
    reason = F.when(F.length("text") == 0, "no content extracted").otherwise("chunks empty after split")
    return docs.join(made, "doc_id", "left_anti").select("doc_id", reason.alias("error"))


_STOP = "[" + ", ".join(f"'{w}'" for w in tx.STOP_WORDS) + "]"
_TERMS = rf"""list_filter(string_split_regex(regexp_replace(regexp_replace(lower(text), '[_-]', ' ', 'g'), '[^a-z0-9\s]', ' ', 'g'), '\s+'),
  lambda t: length(t) >= 3 AND NOT list_contains({_STOP}, t) AND NOT regexp_matches(t, '^[0-9]+$'))"""


@query(f"SELECT doc_id, len({_TERMS}) AS n, md5(array_to_string({_TERMS}, ' ')) AS h FROM {{documents}}")
def f1_tokenize_terms(spark, sf_dir):
    found = view(spark, sf_dir, "documents").select("doc_id", tx.terms(F.col("text")).alias("t"))
    return found.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ").cast("binary")).alias("h"))


@query(f"""
WITH e AS (SELECT doc_id, unnest({_TERMS}) AS term, generate_subscripts({_TERMS}, 1) AS pos FROM {{documents}}),
c AS (SELECT doc_id, term, count(*) AS n, min(pos) AS first FROM e GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS r FROM c)
SELECT doc_id, string_agg(term, ',' ORDER BY r) AS terms FROM r WHERE r <= 8 GROUP BY 1""")
def f2_top_terms(spark, sf_dir):
    return chunks.top_terms(view(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", F.array_join("terms", ",").alias("terms"))


_LABEL_COLUMNS = ("product", "module", "subsystem", "doc_type", "vendor")
_TITLE = "array_to_string(list_transform(string_split(doc_type, '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
_TOPICS = f"""list_filter([product, CASE WHEN module <> '' THEN module WHEN subsystem <> '' THEN subsystem END, CASE WHEN {_TITLE} <> product AND {_TITLE} <> module THEN {_TITLE} END,
  CASE WHEN vendor <> '' AND vendor <> product THEN vendor END], lambda x: x IS NOT NULL)"""
_HINTS = """list_filter(['product:' || product || ':doc_type:' || doc_type, CASE WHEN subsystem <> '' THEN 'product:' || product || ':subsystem:' || subsystem END,
  CASE WHEN module <> '' THEN 'product:' || product || ':module:' || module END, CASE WHEN vendor <> '' AND vendor <> product THEN 'vendor:' || vendor END,
  CASE WHEN subsystem <> '' AND module <> '' THEN 'subsystem:' || subsystem || ':module:' || module END], lambda x: x IS NOT NULL)"""


def _labelled(spark, sf_dir):
    cols = [F.col(c) for c in _LABEL_COLUMNS]
    return view(spark, sf_dir, "registry").select("path", "product", tx.topics(*cols).alias("topics"), tx.related_hints(*cols).alias("hints"))


@query(f"SELECT path, array_to_string({_TOPICS}, '|') AS topics FROM {{registry}}")
def f3_topics_of(spark, sf_dir):
    return _labelled(spark, sf_dir).select("path", F.array_join("topics", "|").alias("topics"))


@query("SELECT path, substr(sha256(path || '::' || product), 1, 16) AS graph_id FROM {registry}")
def f4_document_graph_id(spark, sf_dir):
    return view(spark, sf_dir, "registry").select("path", tx.graph_id(F.col("path"), F.col("product")).alias("graph_id"))


@query(f"SELECT path, array_to_string({_HINTS}, '|') AS hints FROM {{registry}}")
def f5_related_hints(spark, sf_dir):
    return _labelled(spark, sf_dir).select("path", F.array_join("hints", "|").alias("hints"))


@query(f"""
WITH e AS (SELECT doc_id, unnest({_TERMS}) AS term, generate_subscripts({_TERMS}, 1) AS pos FROM {{documents}}),
c AS (SELECT doc_id, term, count(*) AS n, min(pos) AS first FROM e GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS r FROM c),
t AS (SELECT doc_id, string_agg(term, ',' ORDER BY r) AS terms FROM r WHERE r <= 8 GROUP BY 1)
SELECT path, substr(sha256(path || '::' || product), 1, 16) AS graph_id, coalesce(terms, '') AS entities, array_to_string({_TOPICS}, '|') AS topics, array_to_string({_HINTS}, '|') AS related
FROM {{registry}} LEFT JOIN t USING (doc_id)""")
def f6_graph_columns(spark, sf_dir):
    terms = chunks.top_terms(view(spark, sf_dir, "documents"), "doc_id", "text")
    cols = [F.col(c) for c in _LABEL_COLUMNS]
    reg = view(spark, sf_dir, "registry").join(terms, "doc_id", "left")
    return reg.select(
        "path", tx.graph_id(F.col("path"), F.col("product")).alias("graph_id"), F.coalesce(F.array_join("terms", ","), F.lit("")).alias("entities"),
        F.array_join(tx.topics(*cols), "|").alias("topics"), F.array_join(tx.related_hints(*cols), "|").alias("related"),
    )


@query(f"SELECT topic, count(*) AS n FROM (SELECT unnest({_TOPICS}) AS topic FROM {{registry}}) GROUP BY 1")
def f7_topic_counts(spark, sf_dir):
    return chunks.topic_counts(_labelled(spark, sf_dir), "topics")


@query(f"SELECT path FROM {{registry}} WHERE list_contains({_TOPICS}, 'Connectors') ORDER BY path LIMIT 100")
def f8_explore_topic(spark, sf_dir):
    return _labelled(spark, sf_dir).where(F.array_contains("topics", "Connectors")).select("path").distinct().orderBy("path").limit(100)


def _graph_chunks(spark, sf_dir):
    """Chunks of the registered documents with their graph ids."""
    reg = view(spark, sf_dir, "registry").select("doc_id", F.col("path").alias("source_file"), tx.graph_id(F.col("path"), F.col("product")).alias("doc_graph_id"))
    docs = view(spark, sf_dir, "documents").select("doc_id", "text").join(reg, "doc_id")
    return chunks.chunk_fixed(docs, 600, 80).withColumnRenamed("pos", "chunk_index")


@query(f"""WITH c AS (SELECT substr(sha256(path || '::' || product), 1, 16) AS doc_graph_id, path AS source_file, pos AS chunk_index, chunk
  FROM ({_pieces(600, 80)}) JOIN {{registry}} USING (doc_id) WHERE length(chunk) >= 30),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_graph_id ORDER BY source_file, chunk_index) AS INT) AS place FROM c)
SELECT doc_graph_id, place, source_file, chunk_index, md5(CASE WHEN length(chunk) > 200 THEN substr(chunk, 1, 200) || '...' ELSE chunk END) AS h FROM r WHERE place <= 100""")
def f9_related_chunks(spark, sf_dir):
    found = chunks.related_chunks(_graph_chunks(spark, sf_dir))
    return found.select("doc_graph_id", "place", "source_file", "chunk_index", F.md5(F.col("preview").cast("binary")).alias("h"))


_CLASSES = f"""e AS (SELECT DISTINCT path, unnest({_HINTS}) AS label FROM {{registry}}),
m AS (SELECT path, sha256(string_agg(label, chr(31) ORDER BY label)) AS class_id FROM e GROUP BY 1)"""


@query(f"""
WITH {_CLASSES}, z AS (SELECT class_id, count(*) AS n FROM m GROUP BY 1), l AS (SELECT DISTINCT class_id, label FROM e JOIN m USING (path)),
t AS (SELECT DISTINCT a.class_id AS a, b.class_id AS b FROM l a JOIN l b USING (label))
SELECT path, class_id, CAST(links AS BIGINT) AS links FROM m JOIN (SELECT a AS class_id, sum(n) - 1 AS links FROM t JOIN z ON z.class_id = b GROUP BY 1) USING (class_id)""")
def f10_related_members(spark, sf_dir):
    return chunks.related_classes(_labelled(spark, sf_dir), "path", "hints")[0]


@query(f"""
WITH {_CLASSES}, z AS (SELECT class_id, count(*) AS n FROM m GROUP BY 1), l AS (SELECT DISTINCT class_id, label FROM e JOIN m USING (path)),
t AS (SELECT a.class_id AS a, b.class_id AS b, count(*) AS shared FROM l a JOIN l b ON a.label = b.label AND a.class_id <= b.class_id GROUP BY 1, 2),
p AS (SELECT a, b, shared, CASE WHEN a = b THEN x.n * (x.n - 1) // 2 ELSE x.n * y.n END AS links FROM t JOIN z x ON x.class_id = a JOIN z y ON y.class_id = b)
SELECT * FROM p WHERE links > 0""")
def f10_related_classes(spark, sf_dir):
    return chunks.related_classes(_labelled(spark, sf_dir), "path", "hints")[1]


@query(f"""
WITH {_CLASSES}, z AS (SELECT class_id, count(*) AS n, min(path) AS least FROM m GROUP BY 1), l AS (SELECT DISTINCT class_id, label FROM e JOIN m USING (path)),
t AS (SELECT a.class_id AS a, b.class_id AS b, count(*) AS shared FROM l a JOIN l b ON a.label = b.label AND a.class_id <= b.class_id GROUP BY 1, 2),
p AS (SELECT least(x.least, y.least) AS a, greatest(x.least, y.least) AS b, shared, CASE WHEN t.a = t.b THEN x.n * (x.n - 1) // 2 ELSE x.n * y.n END AS links FROM t JOIN z x ON x.class_id = t.a JOIN z y ON y.class_id = t.b)
SELECT * FROM p WHERE links > 0""")
def f10_related_documents(spark, sf_dir):
    return chunks.related_documents(_labelled(spark, sf_dir), "path", "hints")
