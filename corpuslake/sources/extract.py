"""Text sections of files: one distributed job over (path, content) rows.

Every file type has an extractor from bytes to (page, text) pairs; a file that cannot be read
gives no section and never fails the job. Archives are read to a depth of two.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

from corpuslake.functions.paths import FILE_TYPES
from corpuslake.sources.batches import bounded, gathered

Sections = list[tuple[str, str]]
#: Entries of archives beyond this size are skipped.
LARGEST_ENTRY = 500 << 20
DEEPEST = 2


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _texts(node, leaf: str, without: str = "") -> str:
    apart = {id(t) for x in node.iter() if without and _name(x.tag) == without for t in x.iter()}
    return "".join(t.text or "" for t in node.iter() if _name(t.tag) == leaf and id(t) not in apart)


def _tree(archive: zipfile.ZipFile, entry: str):
    return ElementTree.fromstring(archive.read(entry))


def _numbered(archive: zipfile.ZipFile, pattern: str) -> list[str]:
    found = [(int(m[1]), n) for n in archive.namelist() if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def plain(content: bytes) -> Sections:
    return [("", content.decode("utf-8", "replace"))]


def _paragraph(node, breaks: dict[str, str], skipped: tuple[str, ...]) -> str:
    """Text of a paragraph, with what tabs, breaks and the like stand for; parts that are set apart from it are left out."""
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        kind = _name(x.tag) if isinstance(x.tag, str) else ""
        if x is not node and (kind in skipped or not kind):
            stack.append(x.tail or "")
            continue
        times = next((int(v) for k, v in x.attrib.items() if _name(k) == "c" and v.isdigit()), 1)
        inner = breaks[kind] * times if kind in breaks else ""
        own = [inner, x.text or "" if kind in ("t", "p", "h", "span", "a") else "", *x]
        stack += [*([x.tail or ""] if x is not node else []), *reversed(own)]
    return "".join(out)


def docx(content: bytes) -> Sections:
    """Paragraphs of the body that are not blank, stripped; those of tables and text boxes are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        tree = _tree(z, "word/document.xml")
    body = next((n for n in tree.iter() if _name(n.tag) == "body"), tree)
    for t in tree.iter():  # white space between elements is layout
        if _name(t.tag) != "t":
            t.text = None
        t.tail = None
    breaks, skipped = {"tab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "-"}, ("pPr", "rPr", "drawing", "pict", "object", "del", "tbl", "AlternateContent")
    text = "\n".join(x for x in (_paragraph(p, breaks, skipped).strip() for p in body if _name(p.tag) == "p") if x)
    return [("", text)] if text else []


def _column(reference: str) -> int | None:
    """The column of a cell reference such as ``AB12``, from 0."""
    n = 0
    for c in reference:
        if not "A" <= c <= "Z":
            break
        n = n * 26 + ord(c) - 64
    return n - 1 if n else None


# Built-in number formats that are dates or times.
DATE_FORMATS = (14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47)


def _date_styles(archive: zipfile.ZipFile) -> list[bool]:
    """Of each cell style, whether it shows a date or a time."""
    if "xl/styles.xml" not in archive.namelist():
        return []
    tree = _tree(archive, "xl/styles.xml")
    own = {int(f.get("numFmtId", -1)): re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", f.get("formatCode", "")).lower() for f in tree.iter() if _name(f.tag) == "numFmt"}
    dated = lambda n: any(c in own[n] for c in "dmyhs") and "general" not in own[n] if n in own else n in DATE_FORMATS
    return [dated(int(x.get("numFmtId", 0))) for xfs in tree.iter() if _name(xfs.tag) == "cellXfs" for x in xfs]


def _value(cell, shared: list[str], dated: list[bool]) -> str:
    kind, raw = cell.get("t", "n"), _texts(cell, "v")
    if kind == "s":
        return shared[int(raw)] if raw.isdigit() and int(raw) < len(shared) else ""
    if kind == "inlineStr":
        return _texts(cell, "t")
    if kind == "b":
        return {"1": "True", "0": "False"}.get(raw, raw)
    if kind == "n" and raw:
        try:
            number = float(raw) if set(raw) & set(".eE") else int(raw)
        except ValueError:
            return raw
        style = cell.get("s", "")
        if style.isdigit() and int(style) < len(dated) and dated[int(style)]:
            return str(dt.datetime(1899, 12, 30) + dt.timedelta(seconds=round(number * 86400)))
        return str(number)
    return raw


def _sheets(archive: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, entry) of the worksheets in the workbook's order, by its relations; by number where it has none."""
    sheets = [s for s in _tree(archive, "xl/workbook.xml").iter() if _name(s.tag) == "sheet"]
    if "xl/_rels/workbook.xml.rels" not in archive.namelist():
        return list(zip([s.get("name") for s in sheets], _numbered(archive, r"xl/worksheets/sheet(\d+)\.xml"), strict=False))
    targets = {r.get("Id"): r.get("Target", "") for r in _tree(archive, "xl/_rels/workbook.xml.rels")}
    entry = lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}"
    found = ((s.get("name"), entry(targets.get(next((v for k, v in s.attrib.items() if _name(k) == "id" and k != "id"), ""), ""))) for s in sheets)
    return [(n, e) for n, e in found if e in archive.namelist() and "worksheets" in e]


def xlsx(content: bytes) -> Sections:
    """A section for each sheet: its name, then rows with tabs between cells; blank rows dropped. Cells stand in
    the column that their reference names, and rows are as wide as the sheet says."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = [_texts(s, "t", "rPh") for s in _tree(z, "xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in z.namelist() else []
        dated, out = _date_styles(z), []
        for name, entry in _sheets(z):
            tree = _tree(z, entry)
            wide = next((d.get("ref", "").rpartition(":")[2] for d in tree.iter() if _name(d.tag) == "dimension" and ":" in d.get("ref", "")), "")
            rows = []
            for row in (r for r in tree.iter() if _name(r.tag) == "row"):
                cells: dict[int, str] = {}
                for c in (c for c in row if _name(c.tag) == "c"):
                    at = _column(c.get("r", ""))
                    cells[max(cells, default=-1) + 1 if at is None else at] = _value(c, shared, dated)
                if any(x.strip() for x in cells.values()):
                    rows.append("\t".join(cells.get(i, "") for i in range(max(*cells, _column(wide) or 0, 0) + 1)))
            if rows:
                out.append((name, f"[Planilha: {name}]\n" + "\n".join(rows)))
    return out


def pptx(content: bytes) -> Sections:
    """A section for each slide that has text."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        out = []
        for i, entry in enumerate(_numbered(z, r"ppt/slides/slide(\d+)\.xml"), 1):
            shapes = (_texts(s, "t").strip() for s in _tree(z, entry).iter() if _name(s.tag) == "sp")
            text = "\n".join(t for t in shapes if t)
            if text:
                out.append((str(i), text))
    return out


ODF_BREAKS = {"s": " ", "tab": "\t", "line-break": "\n"}
ODF_SKIPPED = ("note", "annotation", "tracked-changes")
#: Times that a repeated row or column with text is written out at most; more are none that a file's author made.
MOST_REPEATS = 16384


def _repeats(node, of: str) -> int:
    found = next((v for k, v in node.attrib.items() if _name(k) == f"number-{of}-repeated"), "1")
    return min(int(found), MOST_REPEATS) if found.isdigit() else 1


def _odf_texts(node, between: str) -> str:
    return between.join(x for x in (_paragraph(p, ODF_BREAKS, ODF_SKIPPED).strip() for p in node.iter() if _name(p.tag) in ("p", "h")) if x)


def _table(table) -> list[str]:
    """Rows with tabs between cells, repeated ones as often as they stand; blank rows and what is blank at the ends dropped."""
    rows = []
    for row in (r for r in table.iter() if _name(r.tag) == "table-row"):
        cells: list[str] = []
        blank = 0  # blank cells are written only if others follow
        for c in (c for c in row if _name(c.tag) in ("table-cell", "covered-table-cell")):
            text, n = _odf_texts(c, "").strip() or "".join(c.itertext()).strip(), _repeats(c, "columns")
            if text:
                cells += [""] * blank + [text] * n
                blank = 0
            else:
                blank += n
        if line := "\t".join(cells).strip():
            rows += [line] * _repeats(row, "rows")
    return rows


def open_document(content: bytes) -> Sections:
    """Paragraphs of texts, tables' among them; of spreadsheets a section for each table, of presentations one for each page."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        tree = _tree(z, "content.xml")
    named = lambda kind: [n for n in tree.iter() if _name(n.tag) == kind]
    name = lambda node: next((v for k, v in node.attrib.items() if _name(k) == "name"), "") or "Sheet"
    if named("presentation"):
        out = [(str(i), _odf_texts(p, "\n")) for i, p in enumerate(named("page"), 1)]
    elif named("spreadsheet") or (named("table") and not named("text")):
        out = [(name(t), f"[Sheet: {name(t)}]\n" + "\n".join(rows)) for t in named("table") if (rows := _table(t))]
    else:
        out = [("", _odf_texts(tree, "\n"))]
    return [(p, t) for p, t in out if t]


EXTRACTORS: dict[str, Callable[[bytes], Sections]] = {
    "txt": plain, "docx": docx, "xlsx": xlsx, "pptx": pptx, "odt": open_document, "ods": open_document, "odp": open_document,
}


def sections_of(path: str, content: bytes | None, depth: int = 0) -> list[tuple[str, str, str]]:
    """(source path, page, text) of a file; inside archives the source path is the entry's."""
    ext = path.rpartition("/")[2].rpartition(".")[2].lower()
    kind = FILE_TYPES.get(ext)
    try:
        if kind == "code":
            return [(path, "", f"```{ext}\n{(content or b'').decode('utf-8', 'replace')}\n```")]
        if kind == "zip" and depth < DEEPEST:
            out = []
            with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
                for e in z.infolist():
                    if not e.is_dir() and e.file_size <= LARGEST_ENTRY:
                        inner = sections_of(e.filename, z.read(e), depth + 1)
                        nested = FILE_TYPES.get(e.filename.rpartition(".")[2].lower()) == "zip"
                        out += [(f"{e.filename}/{p}" if nested else p, page, t) for p, page, t in inner]
            return out
        if kind in EXTRACTORS:
            return [(path, page, text) for page, text in EXTRACTORS[kind](content or b"")]
    except Exception:  # whatever a broken file raises, it has no text
        return []
    return []


PROPERTIES = ("title", "author", "subject", "keywords")


def properties_of(path: str, content: bytes | None) -> tuple[str, str, str, str]:
    """Title, author, subject and keywords among the core properties of a docx; else empty texts."""
    found = dict.fromkeys(PROPERTIES, "")
    if path.lower().endswith(".docx"):
        try:
            with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
                for node in _tree(z, "docProps/core.xml"):
                    name = {"creator": "author"}.get(_name(node.tag), _name(node.tag))
                    if name in found:
                        found[name] = node.text or ""
        except Exception:  # whatever a broken file raises, it has no properties
            pass
    return tuple(found.values())


def document_properties(files: DataFrame) -> DataFrame:
    """(path, title, author, subject, keywords) of files (path, content)."""
    schema = pa.schema([(c, pa.string()) for c in ("path", *PROPERTIES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((p, *properties_of(p, c)) for b in bounded(batches, 1) for p, c in zip(*(x.to_pylist() for x in b.columns), strict=True))
        return gathered(rows, schema, lambda r: sum(map(len, r[1:])) + 64)

    return files.select("path", "content").mapInArrow(run, "path string, title string, author string, subject string, keywords string")


def extract_sections(files: DataFrame) -> DataFrame:
    """(path, section_no, source_path, page, text) of files (path, content). Files are opened one after another, and what
    they hold is handed on in batches of some bytes."""
    schema = pa.schema([("path", pa.string()), ("section_no", pa.int32()), ("source_path", pa.string()), ("page", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((p, i, *s) for b in bounded(batches, 1) for p, c in zip(*(x.to_pylist() for x in b.columns), strict=True) for i, s in enumerate(sections_of(p, c)))
        return gathered(rows, schema, lambda r: len(r[4]) + 256)

    return files.select("path", "content").mapInArrow(run, "path string, section_no int, source_path string, page string, text string")


#: Partitions of a scan that one task reads. Spark reckons 4 MB for opening a file, so that 32 small ones make a partition.
SCAN_PARTITIONS = 16


def scan_documents(spark, root: str) -> DataFrame:
    """(path, length, modified, content, file_type) of files of known types below ``root``, empty ones too. Others are not opened."""
    from pyspark.sql import functions as F

    from corpuslake.functions.paths import FILE_TYPES, file_type_of
    from corpuslake.sources.landed import empty_files

    known = ",".join("".join(f"[{c}{c.upper()}]" for c in x) for x in FILE_TYPES)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{known}}}").load(root)
    # Millions of small files are hundreds of tasks for each core otherwise.
    parts = found.rdd.getNumPartitions()
    empty = empty_files(spark, root)
    empty = empty.select("path", F.col("modified").alias("modificationTime"), F.lit(0).cast("bigint").alias("length"), F.lit(b"").alias("content"))
    found = found.coalesce(max(1, max(4 * spark.sparkContext.defaultParallelism, -(-parts // SCAN_PARTITIONS)) - empty.rdd.getNumPartitions()))
    found = found.unionByName(empty).withColumn("file_type", file_type_of(F.col("path"))).where("file_type IS NOT NULL")
    return found.select("path", "length", F.col("modificationTime").alias("modified"), "content", "file_type")


def scan_ordered(spark, path: str) -> DataFrame:
    """As ``scan_documents``, of one file or of a folder, by extension and then path."""
    from pyspark.sql import functions as F

    from corpuslake.functions.paths import extension_of

    return scan_documents(spark, path).orderBy(extension_of(F.col("path")), "path")
