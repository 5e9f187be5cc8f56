"""Remote documents from JSON texts of a wiki, an issue tracker and a repository listing.

Fetching over a network is left to whoever lands the JSON; a connector is a function from
landed rows to remote documents (remote_id, source_key, title, content, content_type,
remote_url, remote_mtime in epoch seconds, metadata). ``register`` adds further kinds.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.functions.text import html_to_markdown

# Extensions of repository files that are kept, and those that are markdown.
REPO_TYPES = (
    "md", "rst", "txt", "py", "js", "ts", "tsx", "jsx", "css", "scss", "less", "json", "yaml", "yml", "toml", "cfg", "ini", "conf", "xml", "html",
    "sh", "bash", "zsh", "env", "sql", "dockerfile", "go", "rs", "java", "kt", "swift", "c", "cpp", "h", "hpp",
)
MARKDOWN_TYPES = ("md", "rst")
# How marked text of a document tree is written.
MARKS = {"code": "`{}`", "strong": "**{}**", "em": "*{}*", "strike": "~~{}~~"}

PAGE = "id string, title string, space struct<key:string,name:string>, version struct<number:long,when:string>, body struct<storage:struct<value:string>>, _links struct<webui:string>"
NAMED = "struct<name:string>"
ISSUE = f"key string, fields struct<summary:string,description:string,updated:string,labels:array<string>,status:{NAMED},priority:{NAMED},assignee:struct<displayName:string>,project:struct<key:string,name:string>>"


# What follows the text of these nodes, and what stands before the children of others.
AFTER = {"paragraph": "\n\n", "heading": "\n\n", "tableCell": " | ", "tableHeader": " | ", "codeBlock": "\n```\n"}
BEFORE = {"codeBlock": "\n```\n", "hardBreak": "\n"}


def _children(node) -> list:
    found = node.get("content") if isinstance(node, dict) else None
    return found if isinstance(found, list) else []


def _marked(node: dict) -> str:
    text, marks = node.get("text"), node.get("marks")
    if not isinstance(text, str) or not text.strip():
        return ""
    for mark in (m for m in (marks if isinstance(marks, list) else []) if isinstance(m, dict)):
        attrs = mark.get("attrs")
        if mark.get("type") == "link":
            text = f"[{text}]({attrs.get('href', '') if isinstance(attrs, dict) else ''})"
        else:
            text = MARKS.get(str(mark.get("type", "")), "{}").replace("{}", text)
    return text


def _tree_lines(root: dict) -> str:
    """The text of a document tree in order, by a stack of nodes and texts that are still to come: trees may be of
    any depth, and what is no object in them has no text."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, tuple):
            out.append(node[0])
            continue
        if not isinstance(node, dict):
            continue
        kind, todo = str(node.get("type", "")), []
        if kind == "text":
            out.append(_marked(node))
            continue
        if kind in ("bulletList", "orderedList"):
            for i, item in enumerate(_children(node), 1):
                todo += [("- " if kind == "bulletList" else f"{i}. ",), *_children(item), ("\n",)]
        elif kind == "hardBreak":
            todo = [(BEFORE[kind],)]
        else:
            todo = [(BEFORE.get(kind, ""),), *_children(node), (AFTER.get(kind, ""),)]
        stack += reversed(todo)
    return "".join(out)


def tree_text(tree: str | None) -> str:
    """Plain text of a document tree given as JSON; lines stripped, blank ones dropped. Null, what
    is no JSON, too deep for its reader or no object has no text."""
    try:
        node = json.loads(tree or "null")
    except (ValueError, RecursionError):
        return ""
    lines = _tree_lines(node).splitlines() if isinstance(node, dict) else []
    return "\n".join(x for x in (line.strip() for line in lines) if x)


def adf_to_text(tree: Column) -> Column:
    """``tree_text`` in Arrow batches."""
    @F.pandas_udf("string")
    def run(trees: pd.Series) -> pd.Series:
        return trees.map(tree_text)

    return run(tree)


def epoch(iso: Column) -> Column:
    """Epoch seconds of an ISO time; null where it is none."""
    return F.unix_micros(F.try_to_timestamp(F.nullif(iso, F.lit("")))) / 1_000_000


def _documents(rows: DataFrame, source_key: str, **columns: Column) -> DataFrame:
    meta = columns.pop("metadata")
    return rows.select(F.lit(source_key).alias("source_key"), *[c.alias(n) for n, c in columns.items()], F.map_from_arrays(F.array(*[F.lit(k) for k in meta]), F.array(*[F.coalesce(v, F.lit("")) for v in meta.values()])).alias("metadata"))


def remote_pages(raw: DataFrame, source_key: str, base: str) -> DataFrame:
    """Wiki pages (value: JSON). Texts that are no JSON object are left out."""
    p = raw.select(F.from_json("value", PAGE).alias("p")).where("p IS NOT NULL AND (p.id IS NOT NULL OR p.body IS NOT NULL)").select("p.*")
    text = lambda c: F.coalesce(c, F.lit(""))
    return _documents(
        p, source_key, remote_id=text(F.col("id")), title=F.coalesce("title", F.lit("Untitled")), content=html_to_markdown(text(F.col("body.storage.value"))), content_type=F.lit("text/markdown"),
        remote_url=F.when(text(F.col("_links.webui")) != "", F.concat(F.lit(base), F.col("_links.webui"))), remote_mtime=epoch(F.col("version.when")),
        metadata={"space_key": F.col("space.key"), "space_name": F.col("space.name"), "version": F.coalesce(F.col("version.number"), F.lit(1)).cast("string"), "modified": F.col("version.when")},
    )


def remote_issues(raw: DataFrame, source_key: str, base: str) -> DataFrame:
    """Issues (value: JSON); the description is a document tree."""
    i = raw.select(F.from_json("value", ISSUE).alias("i")).where("i IS NOT NULL AND (i.key IS NOT NULL OR i.fields IS NOT NULL)").select("i.*")
    f = lambda name: F.col(f"fields.{name}")
    return _documents(
        i, source_key, remote_id=F.coalesce("key", F.lit("")), title=F.coalesce(f("summary"), F.lit("Untitled")), content=adf_to_text(f("description")), content_type=F.lit("text/markdown"),
        remote_url=F.concat(F.lit(f"{base}/browse/"), F.coalesce("key", F.lit(""))), remote_mtime=epoch(f("updated")),
        metadata={"project_key": f("project.key"), "project_name": f("project.name"), "priority": f("priority.name"), "status": f("status.name"), "assignee": f("assignee.displayName"), "labels": F.array_join(f("labels"), ","), "updated": f("updated")},
    )


def repo_type(path: Column) -> Column:
    """Content type of a repository file; null for files that are left out."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext.isin(*MARKDOWN_TYPES), "text/markdown").when(ext.isin(*REPO_TYPES), "text/plain")


def repo_files(listing: DataFrame, source_key: str, base: str) -> DataFrame:
    """Files of a repository listing (path, content, commit, mtime) of the kinds that are kept."""
    rows = listing.withColumn("kind", repo_type(F.col("path"))).where("kind IS NOT NULL")
    return _documents(
        rows, source_key, remote_id=F.col("path"), title=F.element_at(F.split("path", "/"), -1), content=F.col("content"), content_type=F.col("kind"),
        remote_url=F.concat(F.lit(f"{base}/blob/"), "commit", F.lit("/"), "path"), remote_mtime=F.col("mtime").cast("double"), metadata={"commit": F.col("commit"), "path": F.col("path")},
    )


CONNECTORS: dict[str, Callable[[DataFrame, str, str], DataFrame]] = {"wiki": remote_pages, "issues": remote_issues, "repo": repo_files}


def register(kind: str, parse: Callable[[DataFrame, str, str], DataFrame]) -> None:
    CONNECTORS[kind] = parse


def fetch_documents(kind: str, raw: DataFrame, source_key: str, base: str, since: float | None = None) -> DataFrame:
    """Remote documents of a registered kind, with ``since`` those changed from then on (and those
    whose time is not known); an unknown kind is an error."""
    if kind not in CONNECTORS:
        raise ValueError(f"unknown connector: {kind}")
    found = CONNECTORS[kind](raw, source_key, base)
    return found if since is None else found.where(F.col("remote_mtime").isNull() | (F.col("remote_mtime") >= since))
