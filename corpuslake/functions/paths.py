"""Classification of documents by rules over their paths, as Column expressions.

The rules become ``when`` chains, so a corpus is classified in one projection without a
shuffle. Paths are relative to the document root, with ``/`` between parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Document types in falling priority, each with its patterns.
DOC_TYPE_RULES = (
    ("standard", (r"\biso\b", r"\biso[-_]\d+", r"15489", r"\blgpd\b", r"lei.geral", r"\bgdpr\b", r"\bnist\b", r"\bcompliance\b", r"\bregulation\b")),
    ("release_notes", (r"release.?notes?", r"relnotes?", r"what.?s.?new", r"patch.?notes?", r"changelog")),
    ("upgrade_guide", (r"upgrad", r"migrat", r"update.instal", r"migration")),
    ("install_guide", (r"install", r"installation", r"setup.guide", r"deploy", r"getting.started", r"\bigi\b", r"\bigu\b", r"\biasw\b", r"\bigw\b", r"\bigd\b")),
    ("admin_guide", (r"admin", r"administration", r"system.admin", r"sysadmin", r"\bacn\b", r"\bagd\b", r"operator")),
    ("config_guide", (r"config", r"configuration", r"scenario", r"setup", r"\bcgd\b", r"\bist\b", r"storm.config", r"cookbook", r"how.to", r"howto")),
    ("user_guide", (r"user.?guide", r"user.?manual", r"\bugd\b", r"end.user", r"manual.do.usu", r"guia.do.usu")),
    ("api_guide", (r"\bapi\b", r"\bsdk\b", r"programm", r"developer", r"integration", r"web.service", r"\brest\b", r"\bsoap\b", r"\bpsa\b", r"interface", r"endpoints?")),
    ("howto", (r"case.study", r"how.to", r"howto", r"troubleshoot", r"cookbook", r"recipe", r"tip", r"trick", r"best.practice", r"reverse.proxy", r"ha.proxy", r"\bkb\d{5,}", r"knowledge.base")),
    ("training", (r"training", r"vilt", r"webinar", r"workshop", r"course", r"module\s*\d", r"day\s*\d", r"lab", r"study.guide", r"learn", r"tutorial", r"enablement", r"certification", r"certificate")),
    ("overview", (r"overview", r"introduction", r"intro\b", r"what.is", r"understanding", r"fundamentals?", r"concepts?", r"architecture", r"whitepaper", r"datasheet", r"presentation", r"comprehensive", r"portfolio")),
    ("reference", (r"technical.paper", r"terminolog", r"glossar", r"reference", r"spec", r"specification", r"technical.note", r"technote")),
    ("meeting", (r"meeting.recording", r"recording", r"session", r"clickthrough", r"knowledge.sharing")),
    ("release_artifact", (r"\.zip$", r"\.patch$", r"pat\d{9,}", r"p-ar-center", r"schema.and.pre.upgrade")),
)
# Suffixes that are artifacts whatever the name says.
ARTIFACT_SUFFIXES = ("zip", "patch", "mp4", "avi", "jpg", "png")
# Folder names and the products they stand for, in order.
PRODUCT_ALIASES = (
    ("appserver", "AppServer"), ("app server", "AppServer"), ("datasync", "DataSync"), ("data sync", "DataSync"), ("adminportal", "AdminPortal"),
    ("admin portal", "AdminPortal"), ("adobe", "Adobe"), ("reccordsmanagement", "RecordsManagement"), ("records management", "RecordsManagement"),
    ("varios", "geral"), ("templates", "geral"), ("contentserver", "ContentServer"), ("content server", "ContentServer"), ("webreports", "WebReports"),
    ("web reports", "WebReports"), ("xecm", "xECM"), ("extended ecm", "xECM"), ("extendedecm", "xECM"), ("workflow", "Workflow"), ("cside", "CSIDE"),
    ("content server ide", "CSIDE"), ("brava", "Brava"), ("ot2", "OT2"), ("documentviewer", "DocumentViewer"), ("document viewer", "DocumentViewer"),
    ("apigateway", "APIGateway"), ("api gateway", "APIGateway"), ("archivecenter", "ArchiveCenter"), ("archive center", "ArchiveCenter"),
)
# Folders that name no product.
PLAIN_FOLDERS = ("varios", "templates", "archive")
# Products by file name, in order.
PRODUCT_NAMES = (
    ("AppServer", (r"app.?server", r"\bappserver\b")), ("DataSync", (r"data.?sync", r"\bdatasync\b")), ("AdminPortal", (r"admin.?portal", r"\badminportal\b")),
    ("DocumentFilters", (r"document.filters",)), ("TeleForm", (r"teleform",)), ("Adobe", (r"\badobe\b", r"adobe.sign", r"docusign")),
    ("SAP", (r"\bsap\b", r"successfactors", r"archiving.and.document.access")), ("ISO", (r"\biso[-_]\d+", r"15489", r"irish.version")),
    ("RecordsManagement", (r"records?.management", r"file.plan", r"lgpd", r"lei.geral")), ("Apache", (r"\bapache\b",)), ("Gradle", (r"\bgradle\b",)),
    ("CMIS", (r"\bcmis\b",)), ("WebReports", (r"webreport", r"web.?report")), ("xECM", (r"\bxecm\b", r"extended.?ecm")), ("Workflow", (r"\bworkflow\b",)),
    ("CSIDE", (r"\bcside\b", r"content.?server.?ide")), ("ContentServer", (r"content.?server",)), ("Brava", (r"\bbrava\b",)), ("OT2", (r"\bot2\b",)),
    ("DocumentViewer", (r"document.?viewer", r"doc.?viewer")), ("APIGateway", (r"api.?gateway", r"apigateway")), ("ArchiveCenter", (r"archive.?center", r"archivecenter")),
)
# Vendor patterns, and products of a vendor.
VENDOR_NAMES = (("OpenText", (r"\bopentext\b", r"\bot\s+\w")),)
VENDOR_PRODUCTS = (
    ("OpenText", ("WebReports", "xECM", "Workflow", "CSIDE", "ContentServer", "Brava", "OT2", "DocumentViewer", "APIGateway", "ArchiveCenter", "AppServer", "DataSync", "AdminPortal", "RecordsManagement")),
    ("ISO", ("ISO",)),
)
# Subsystems by file name, in order.
SUBSYSTEM_NAMES = (
    ("API", (r"\bapi\b", r"\bsdk\b", r"\brest\b", r"\bsoap\b", r"\bwebservice")), ("Security", (r"\bsecurity\b", r"\bauth\b", r"\bpermission\b", r"\bacl\b")),
    ("Admin", (r"\badmin\b", r"\badministration\b", r"\boperator\b")), ("Integration", (r"\bintegration\b", r"\bconnector\b")),
    ("Migration", (r"\bmigration\b", r"\bupgrade\b", r"\bupgrad")), ("Install", (r"\binstall\b", r"\bsetup\b", r"\bdeploy")),
    ("Reporting", (r"\breport\b", r"\bdashboard\b")), ("Performance", (r"\bperformance\b", r"\btuning\b", r"\bscalab")),
)
# Modules of a product by folder, in order.
MODULE_FOLDERS = (
    ("AppServer", ((r"/(?:admin|administration)/", "Administration"), (r"/(?:config|configuration)/", "Configuration"), (r"/(?:api|integration)/", "API"), (r"/security/", "Security"))),
    ("DataSync", ((r"/(?:connector|connectors)/", "Connectors"), (r"/(?:sync|synchronization)/", "Synchronization"), (r"/(?:monitor|monitoring)/", "Monitoring"))),
    ("AdminPortal", ((r"/(?:user|users)/", "User Management"), (r"/(?:role|roles|permission)/", "Roles & Permissions"), (r"/(?:report|reporting)/", "Reporting"), (r"/(?:dashboard)/", "Dashboard"))),
)
# Version patterns in order.
VERSION_PATTERNS = (r"CE\s+(\d{2}\.\d+(?:\.\d+)?)", r"v(\d+\.\d+(?:\.\d+)?)", r"(\d{2}\.\d+(?:\.\d+)?)", r"version\s+(\d+\.\d+(?:\.\d+)?)")
# File types by extension.
FILE_TYPES = {
    "pdf": "pdf", "docx": "docx", "doc": "doc", "xlsx": "xlsx", "xls": "xls", "pptx": "pptx", "ppt": "ppt", "txt": "txt", "md": "txt", "rst": "txt",
    "py": "code", "ts": "code", "js": "code", "java": "code", "go": "code", "rs": "code", "cpp": "code", "c": "code", "cs": "code", "yaml": "code", "yml": "code",
    "json": "code", "xml": "code", "sh": "code", "sql": "code", "odt": "odt", "ods": "ods", "odp": "odp", "wpd": "wpd", "zip": "zip",
}


def any_of(patterns) -> str:
    """One case-insensitive pattern that is found where one of several is."""
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem_of(path: Column) -> Column:
    """The file name without its last suffix; a leading dot starts no suffix."""
    return F.regexp_replace(name_of(path), r"^(.+)\.[^.]+$", "$1")


def extension_of(path: Column) -> Column:
    """Lower-cased last suffix without its dot; empty if there is none."""
    return F.lower(F.regexp_extract(name_of(path), r"^.+\.([^.]+)$", 1))


def file_type_of(path: Column) -> Column:
    """File type by extension; null for unknown extensions."""
    known = F.create_map(*[F.lit(x) for pair in FILE_TYPES.items() for x in pair])
    return F.try_element_at(known, extension_of(path))


def first_match(text: Column, rules) -> Column:
    """Label of the first rule of (label, patterns) found in ``text``; null if none is."""
    out = None
    for label, patterns in rules:
        hit = text.rlike(any_of(patterns))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def doc_type_of(path: Column) -> Column:
    """Type of the highest-priority rule found in the stem and the last two parts of the path."""
    parts = F.split(path, "/")
    near = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), " ")
    text = F.regexp_replace(F.lower(F.concat(stem_of(path), F.lit(" "), near)), r"[_\-/\\]", " ")
    return F.when(extension_of(path).isin(*ARTIFACT_SUFFIXES), "release_artifact").otherwise(F.coalesce(first_match(text, DOC_TYPE_RULES), F.lit("document")))


def product_of(path: Column, override: Column | None = None) -> Column:
    """Override, else the root folder's alias, else the root folder itself, else by file name, else ``geral``."""
    parts = F.split(path, "/")
    root = F.when(F.size(parts) > 1, F.element_at(parts, 1)).otherwise("")
    low = F.lower(root)
    exact = F.try_element_at(F.create_map(*[F.lit(x) for pair in PRODUCT_ALIASES for x in pair]), low)
    near = None
    for alias, product in PRODUCT_ALIASES:
        hit = low.contains(alias) | F.lit(alias).contains(low)
        near = F.when(hit, product) if near is None else near.when(hit, product)
    own = F.when(~low.isin(*PLAIN_FOLDERS), root)
    by_name = first_match(F.regexp_replace(F.lower(stem_of(path)), r"[_\-]", " "), PRODUCT_NAMES)
    found = F.coalesce(F.when(root != "", F.coalesce(exact, near, own)), by_name, F.lit("geral"))
    return found if override is None else F.coalesce(F.nullif(override, F.lit("")), found)


def vendor_of(path: Column, product: Column) -> Column:
    """Vendor named in the file name or path, then in a parent folder, then by product; else empty."""
    text = F.regexp_replace(F.lower(F.concat(stem_of(path), F.lit(" "), path)), r"[_\-/\\]", " ")
    parts = F.split(path, "/")
    pattern = any_of([p for _, ps in VENDOR_NAMES for p in ps])
    parents = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda d: F.regexp_replace(F.regexp_replace(F.lower(d), r"^(.+)\.[^.]+$", "$1"), r"[_\-/]", " "))
    by_product = None
    for vendor, products in VENDOR_PRODUCTS:
        by_product = F.when(product.isin(*products), vendor) if by_product is None else by_product.when(product.isin(*products), vendor)
    return (
        F.when(text.rlike(pattern) | F.exists(parents, lambda d: d.rlike(pattern)), VENDOR_NAMES[0][0])
        .otherwise(F.coalesce(by_product, F.when(product.contains("ISO"), "ISO"), F.lit("")))
    )


def subsystem_of(path: Column) -> Column:
    """Second folder, folders that name nothing left out, if there are two; else by file name; else empty."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    named = F.filter(folders, lambda d: ~F.lower(d).isin(*PLAIN_FOLDERS))
    by_name = first_match(F.regexp_replace(F.lower(stem_of(path)), r"[_\-/]", " "), SUBSYSTEM_NAMES)
    return F.when((F.size(folders) >= 2) & (F.size(named) >= 2), F.get(named, F.lit(1))).otherwise(F.coalesce(by_name, F.lit("")))


def module_of(path: Column, product: Column) -> Column:
    """Module of a product by its folders; else empty."""
    out = None
    for name, rules in MODULE_FOLDERS:
        for pattern, module in rules:
            hit = (product == name) & path.rlike("(?i)" + pattern)
            out = F.when(hit, module) if out is None else out.when(hit, module)
    return out.otherwise("")


def version_of(path: Column) -> Column:
    """First version pattern found in the file name, then the folder above, then the one above that; null if none."""
    parts = F.split(path, "/")
    n = F.size(parts)
    places = [name_of(path), F.try_element_at(parts, F.when(n > 1, n - 1)), F.try_element_at(parts, F.when(n > 2, n - 2))]
    return F.coalesce(*[F.nullif(F.regexp_extract(F.coalesce(place, F.lit("")), "(?i)" + p, 0), F.lit("")) for place in places for p in VERSION_PATTERNS])


def classify(path: Column, override: Column | None = None, product: Column | None = None) -> dict[str, Column]:
    """All labels of a path by name. ``product``: a column that holds ``product_of(path)`` already,
    so that its many tests run once and not for each label that rests on it."""
    own = product_of(path) if product is None else product
    chosen = own if override is None else F.coalesce(F.nullif(override, F.lit("")), own)
    return {
        "doc_type": doc_type_of(path), "product": chosen, "vendor": vendor_of(path, chosen), "subsystem": subsystem_of(path),
        "module": module_of(path, own), "version": version_of(path),
    }


def classified(files: DataFrame, path: str = "path", override: str | None = None) -> DataFrame:
    """``files`` with all labels of their paths."""
    once = files.withColumn("__product", product_of(F.col(path)))
    labels = classify(F.col(path), F.col(override) if override else None, F.col("__product"))
    return once.select(*[c for c in files.columns if c not in labels], *[c.alias(n) for n, c in labels.items()])


def enrich_gaps(rows: DataFrame, properties: DataFrame, path: str = "path") -> DataFrame:
    """``rows`` with vendor, product and doc_type filled from document properties (path, title, author,
    subject, keywords) where they are null, empty, ``geral`` or ``document``; nothing else changes, and
    rows without properties stay as they are. Of several properties of a path the greatest text counts."""
    words = F.filter(F.array("title", "subject", "author", "keywords"), lambda x: F.coalesce(x, F.lit("")) != "")
    text = F.regexp_replace(F.array_join(words, " "), r"[_\-/\\\\]", " ")
    known = properties.groupBy(F.col(path).alias("__path")).agg(F.max(text).alias("__text"))
    both = rows.join(known, F.col(path) == F.col("__path"), "left")
    use = F.trim(F.coalesce("__text", F.lit(""))) != ""
    concrete = F.when(~F.coalesce("product", F.lit("")).isin("", "geral"), F.col("product"))
    both = both.withColumn("__product", F.when(use, F.coalesce(concrete, product_of(F.col("__text")))))
    found = {"vendor": vendor_of(F.col("__text"), F.coalesce(concrete, F.lit(""))), "product": F.col("__product"), "doc_type": doc_type_of(F.col("__text"))}
    gap = lambda c: use & F.coalesce(F.col(c), F.lit("")).isin("", "geral", "document")
    filled = {c: F.when(gap(c), F.coalesce(F.nullif(v, F.lit("")), F.col(c))).otherwise(F.col(c)) for c, v in found.items()}
    return both.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in rows.columns])
