"""Text normalisation, terms and labels, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no terms.
STOP_WORDS = tuple(
    """the a an is are was were be been being have has had do does did will would could should may might shall can to of in for on with at by
    from as into through during before after above below between out off over under again further then once here there when where why how all
    each every both few more most other some such no nor not only own same so than too very just because but and or if while about up this that
    these those it its which who whom what i me my we our you your he she they them their his her itself themselves please see also use using
    used set get make made via per e.g. i.e. etc etc. note important steps step click select choose enter type press configure""".split()
)
#: White space as Python's strip and split see it in ASCII.
SPACE = r"[ \t\n\x0B\f\r]"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def terms(text: Column) -> Column:
    """Lower-case terms of three characters or more, without stop words and numbers, in order."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"(?<![a-z0-9])(?![0-9]++(?![a-z0-9]))[a-z0-9]{3,}+"), F.lit(0))
    # A list this long becomes a hash set in Spark's plan.
    return F.filter(found, lambda t: ~t.isin(*STOP_WORDS))


def html_to_markdown(html: Column) -> Column:
    """Line breaks from br, p and li; other tags dropped; entities resolved; lines stripped, blank ones dropped."""
    t = F.regexp_replace(html, r"<br\s*/?>", "\n")
    t = F.regexp_replace(F.regexp_replace(t, "</p>", "\n\n"), "</li>", "\n")
    t = F.regexp_replace(t, "<[^>]+>", "")
    # The ampersand comes last, so that it makes no new entity.
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("#x27", "'"), ("nbsp", " "), ("amp", "&")):
        t = F.replace(t, F.lit(f"&{name};"), F.lit(char))
    lines = F.transform(F.split(t, r"\r\n|\r|\n"), stripped)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def fenced(text: Column, language: Column) -> Column:
    """Code as a fenced block."""
    return F.concat(F.lit("```"), language, F.lit("\n"), text, F.lit("\n```"))


def wordperfect_text(content: Column) -> Column:
    """Latin-1 text of a binary: what cannot be printed becomes a space, runs of three spaces or more one."""
    text = F.decode(content, "ISO-8859-1")
    return stripped(F.regexp_replace(F.regexp_replace(text, r"[^\x20-\x7E\x80-\xFF\n\r\t]", " "), " {3,}", " "))


def title(label: Column) -> Column:
    return F.initcap(F.replace(label, F.lit("_"), F.lit(" ")))


def topics(product: Column, module: Column, subsystem: Column, doc_type: Column, vendor: Column) -> Column:
    """Ordered topic labels: product, module or else subsystem, titled type if new, vendor if not the product."""
    some = lambda c: F.when(F.coalesce(stripped(c), F.lit("")) != "", stripped(c))
    first = F.filter(F.array(some(product), F.coalesce(some(module), some(subsystem))), lambda x: x.isNotNull())
    label = title(some(doc_type))
    with_type = F.when(label.isNotNull() & ~F.array_contains(first, label), F.array_append(first, label)).otherwise(first)
    own = some(vendor)
    return F.when(own.isNotNull() & ~own.eqNullSafe(some(product)), F.array_append(with_type, own)).otherwise(with_type)


def related_hints(product: Column, module: Column, subsystem: Column, doc_type: Column, vendor: Column) -> Column:
    """Labels by which related documents find each other."""
    p, m, s, d, v = (F.coalesce(stripped(c), F.lit("")) for c in (product, module, subsystem, doc_type, vendor))
    hint = lambda ok, *parts: F.when(ok, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]))
    return F.filter(
        F.array(
            hint((p != "") & (d != ""), "product:", p, ":doc_type:", d), hint((p != "") & (s != ""), "product:", p, ":subsystem:", s),
            hint((p != "") & (m != ""), "product:", p, ":module:", m), hint((v != "") & (v != p), "vendor:", v),
            hint((s != "") & (m != ""), "subsystem:", s, ":module:", m),
        ),
        lambda x: x.isNotNull(),
    )


def graph_id(source_file: Column, product: Column) -> Column:
    return F.substring(F.sha2(F.concat(source_file, F.lit("::"), product), 256), 1, 16)


def format_bytes(n: Column) -> Column:
    """Size with one decimal and the largest fitting unit of B to TB."""
    out = None
    for i, unit in enumerate(("B", "KB", "MB", "GB")):
        text = F.concat(F.format_string("%.1f", F.bround(n.cast("double") / 1024.0**i, 1)), F.lit(f" {unit}"))
        out = F.when(n < 1024 ** (i + 1), text) if out is None else out.when(n < 1024 ** (i + 1), text)
    return out.otherwise(F.concat(F.format_string("%.1f", F.bround(n.cast("double") / 1024.0**4, 1)), F.lit(" TB")))
