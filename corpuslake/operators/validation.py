"""Validation of files as columns: each check is an expression over (path, length, text) that
gives a struct of name, valid, severity and message; a pipeline is an array of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.functions.paths import extension_of, name_of
from corpuslake.functions.text import SPACE, stripped

# Extensions that may be indexed.
ALLOWED = ("pdf", "docx", "doc", "xlsx", "xls", "pptx", "ppt", "txt", "md", "rst", "py", "ts", "js", "java", "go", "rs", "cpp", "c", "cs", "yaml", "yml", "json", "xml", "sh", "sql")
# Media types by extension.
MEDIA = {
    "pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "doc": "application/msword",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "txt": "text/plain", "md": "text/markdown", "py": "text/x-python",
    "zip": "application/zip", "json": "application/json", "exe": "application/x-msdownload", "mp4": "video/mp4", "png": "image/png",
}
_MB = 1 << 20
# Largest size in bytes by extension.
SIZES = {
    **dict.fromkeys(("txt", "md", "rst"), 10 * _MB), **dict.fromkeys(("py", "js", "ts", "java", "go", "rs", "cpp", "c", "cs"), 5 * _MB),
    **dict.fromkeys(("json", "yaml", "yml", "xml"), _MB), **dict.fromkeys(("pdf", "docx", "doc"), 50 * _MB), **dict.fromkeys(("xlsx", "xls"), 20 * _MB),
    **dict.fromkeys(("pptx", "ppt"), 100 * _MB),
}
# First bytes by extension.
SIGNATURES = {"pdf": ("25504446",), "zip": ("504B0304", "504B0506"), "docx": ("504B0304",), "xlsx": ("504B0304",), "pptx": ("504B0304",)}
TEXT_TYPES = ("txt", "md", "rst", "py", "js", "ts", "java", "go", "rs", "cpp", "c", "cs", "json", "yaml", "yml", "xml", "sh", "sql")


def result(name: str, *failures: tuple[Column, str, Column | str]) -> Column:
    """The first failure (condition, severity, message) that holds, else a pass."""
    as_col = lambda m: m if isinstance(m, Column) else F.lit(m)
    made = lambda ok, sev, msg: F.struct(F.lit(name).alias("name"), F.lit(ok).alias("valid"), F.lit(sev).alias("severity"), as_col(msg).alias("message"))
    out = None
    for cond, severity, message in failures:
        out = F.when(cond, made(False, severity, message)) if out is None else out.when(cond, made(False, severity, message))
    return out.otherwise(made(True, "INFO", ""))


def check_exists(path: Column, length: Column) -> Column:
    return result("exists", (length.isNull(), "ERROR", F.concat(F.lit("File not found: "), path)), (length == 0, "WARNING", "File is empty"))


def check_extension(path: Column, allowed=ALLOWED) -> Column:
    ext = extension_of(path)
    return result("extension", (ext == "", "ERROR", "File has no extension"), (~ext.isin(*allowed), "ERROR", F.concat(F.lit("Unsupported extension: ."), ext)))


def check_media(path: Column, prefixes=("text/", "application/", "image/")) -> Column:
    kind = F.try_element_at(F.create_map(*[F.lit(x) for p in MEDIA.items() for x in p]), extension_of(path))
    fits = F.lit(False)
    for p in prefixes:
        fits = fits | kind.startswith(p)
    return result("media", (kind.isNull(), "WARNING", "Could not determine media type"), (~fits, "ERROR", F.concat(F.lit("Unsupported media type: "), kind)))


def check_size(length: Column, least: int = 1, most: int = 100 * _MB) -> Column:
    return result("size", (length < least, "WARNING", "File too small"), (length > most, "ERROR", "File too large"))


def check_size_by_type(path: Column, length: Column) -> Column:
    most = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in SIZES.items() for x in p]), extension_of(path)), F.lit(100 * _MB))
    return result("size_by_type", (length > most, "ERROR", "File too large for its type"))


def check_encoding(path: Column, content: Column) -> Column:
    """Text must be valid UTF-8; anything else still reads as Latin-1 and only warns."""
    return result("encoding", (extension_of(path).isin(*TEXT_TYPES) & ~F.is_valid_utf8(content.cast("string")), "WARNING", "Not valid UTF-8"))


def check_signature(path: Column, content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 4))
    failures = [((extension_of(path) == e) & ~head.isin(*s), "ERROR", f"Invalid .{e} header (possible corruption)") for e, s in SIGNATURES.items()]
    return result("signature", *failures)


def check_text(path: Column, text: Column, least_chars: int = 10, least_words: int = 5) -> Column:
    head = F.substring(text, 1, 10_000)
    words = F.size(F.filter(F.split(head, rf"{SPACE}+"), lambda w: w != ""))
    is_text = extension_of(path).isin(*TEXT_TYPES)
    return result("text", (is_text & (F.length(stripped(head)) < least_chars), "WARNING", "Text too short"), (is_text & (words < least_words), "WARNING", "Too few words"))


def check_path(path: Column, most: int = 255) -> Column:
    return result("path", (F.length(path) > most, "WARNING", "Path too long"), (F.length(name_of(path)) > most, "WARNING", "Name too long"), (name_of(path).rlike(r'[<>:"|?*\x00-\x1F]'), "WARNING", "Unusual characters"))


def validate(files: DataFrame, checks: list[Column], fail_fast: bool = True, skip_warnings: bool = False) -> DataFrame:
    """``files`` with results and valid. Fail-fast keeps results up to the first ERROR; a WARNING
    fails a file too unless warnings are skipped."""
    results = F.array(*checks)
    error = F.array_position(F.transform(results, lambda r: (~r["valid"]) & (r["severity"] == "ERROR")), True)
    out = files.withColumn("results", results).withColumn("stop", error)
    if fail_fast:
        out = out.withColumn("results", F.when(F.col("stop") > 0, F.slice("results", F.lit(1), F.col("stop").cast("int"))).otherwise(F.col("results")))
    bad = F.exists("results", lambda r: (~r["valid"]) & ((r["severity"] == "ERROR") | F.lit(not skip_warnings)))
    return out.withColumn("valid", ~bad).drop("stop")


def failure_reasons(validated: DataFrame, key: str) -> DataFrame:
    """(key, reason) of each failed check of files that did not pass."""
    failed = validated.where("NOT valid").select(key, F.explode(F.filter("results", lambda r: ~r["valid"])).alias("r"))
    return failed.select(key, F.concat("r.name", F.lit(": "), "r.message").alias("reason"))
