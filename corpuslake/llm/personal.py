"""Personal data by bootstrapped contextual extraction, in DataFrame functions alone.

Strict patterns find the seeds: mail addresses, IP addresses, card and phone numbers. The one or two
words before a seed are a lexical pattern. Looser forms of the four kinds (a phone number without its
plus sign, a spelt-out mail address, ...) are candidates: they count only where the words around
them say so. Patterns and instances are the two sides of a graph, scored in turn: a pattern by how
purely the instances that follow it are of one kind, a candidate by the patterns that it follows;
candidates that have become likely support further patterns in the next round. What is likely at the end is
added, wherever it stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.llm.common import finished, table, text_of, written

KINDS = ("email", "ip", "card", "phone")

# The contracts' patterns, written so that they take linear time and little stack on any text; what they
# match is the same (test_base_patterns): a match begins where no character that could belong to it stands before.
SEEDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-][A-Za-z0-9.-]*?(?=\.(?![A-Za-z0-9-])|[^A-Za-z0-9.-]|\z)",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# Looser forms.
CANDIDATES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?: ?@ ?[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}| ?[\[({](?:at|AT)[\])}] ?[A-Za-z0-9-]{1,63}(?: ?[\[({](?:dot|DOT)[\])}] ?[A-Za-z0-9-]{1,63}| ?\. ?[A-Za-z0-9-]{1,63}){0,8}| (?:at|AT) [A-Za-z0-9-]{1,63}(?: (?:dot|DOT) [A-Za-z0-9-]{1,63}){1,8})(?![A-Za-z0-9@])",
    "ip": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){4,7}:?[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}:(?:[0-9A-Fa-f]{1,4}:){0,5}[0-9A-Fa-f]{1,4}|[0-9]{1,3}(?: ?[\[(](?:\.|dot)[\])] ?[0-9]{1,3}){3})(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ ./_-]{0,2}[0-9]){12,18}+(?![ ./_-]{0,2}[0-9])(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+@/_-])(?<![0-9][ .-])(?:\([0-9]{2,4}\) ?|[0-9])(?:[ .-]?[0-9]){6,14}+(?![ .-]?[0-9])(?![0-9A-Za-z@/_])",
}
#: Characters before an instance in which its pattern's words are looked for.
LEFT = 56
#: What a pattern of one word, and one of two words, needs of likely instances; millionths from here on.
SUPPORT = (8_000_000, 3_000_000)
LEAST_PATTERN, LEAST_INSTANCE, DOUBT = 0.8, 850_000, 500_000
ROUNDS = 3


def _hits(text: Column, kind: str, seed: bool) -> Column:
    """Matches in order: characters between the match before and this one, the match, the characters before it."""
    pattern = F.lit((SEEDS if seed else CANDIDATES)[kind])
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"))
    made = lambda x, i: F.struct(F.lit(KINDS.index(kind)).alias("kind"), F.lit(seed).alias("seed"), i.alias("nth"), F.length(x["gap"]).cast("long").alias("gap"), x["hit"].alias("hit"), F.right(x["gap"], F.lit(LEFT)).alias("left"))
    return F.transform(F.filter(zipped, lambda x: x["hit"].isNotNull()), made)


def _scan(docs: DataFrame, keep) -> DataFrame:
    """kept, row and hits of every row: one pass over the texts, most of which need no more than a look for
    a digit, an at sign, a plus sign or a spelt-out form."""
    text = F.col("text")
    none = F.array().cast("array<struct<kind:int,seed:boolean,nth:int,gap:bigint,hit:string,left:string>>")
    digit, at, plus = F.rlike(text, F.lit("[0-9]")), F.contains(text, F.lit("@")), F.contains(text, F.lit("+"))
    spelt = at | F.rlike(text, F.lit(r"[\[({](?:at|AT)[\])}]| (?:dot|DOT) "))
    colon = F.rlike(text, F.lit(r":[0-9A-Fa-f:]|[0-9] ?[\[(]"))
    wanted = [(at, "email", True), (digit, "ip", True), (digit, "card", True), (plus, "phone", True), (spelt, "email", False), (colon, "ip", False), (digit, "card", False), (digit, "phone", False)]
    hits = F.concat(*[F.when(need, _hits(text, kind, seed)).otherwise(none) for need, kind, seed in wanted])
    rows = docs.select(F.struct(*[F.col(c) for c in keep]).alias("kept"), F.monotonically_increasing_id().alias("row"), text_of(F.col("text")).alias("text"))
    return rows.select("kept", "row", hits.alias("hits"))


def digits_of(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit is right: every second digit from the right counts twice, nines cast out."""
    at = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d >= "5", 9).otherwise(0)))
    return F.aggregate(at, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid() -> Column:
    hit, n = F.col("hit"), F.length(digits_of(F.col("hit")))
    byte = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    seeds = {"email": F.lit(True), "ip": F.rlike(hit, F.lit(rf"^{byte}(?:\.{byte}){{3}}$")), "card": luhn(digits_of(hit)), "phone": n.between(10, 15)}
    out = F.when(~F.col("seed"), F.when(F.col("kind") == KINDS.index("phone"), n.between(7, 15)).otherwise(True))
    for kind, ok in seeds.items():
        out = out.when(F.col("kind") == KINDS.index(kind), ok)
    return out


def _items(scan: DataFrame) -> DataFrame:
    """row, kind, seed, start, end, hit, left of what is found, without candidates that touch a seed."""
    one = scan.select("row", F.explode("hits").alias("x")).select("row", "x.*")
    order = Window.partitionBy("row", "kind", "seed").orderBy("nth")
    size = F.length("hit").cast("long")
    one = one.withColumn("end", F.sum(F.col("gap") + size).over(order)).withColumn("start", F.col("end") - size).where(_valid())
    # Two running frames: one that looks ahead would take quadratic time.
    forth = Window.partitionBy("row").orderBy("start", "kind", "seed", "end").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("row").orderBy(F.col("start").desc(), F.col("kind").desc(), F.col("seed").desc(), F.col("end").desc()).rowsBetween(Window.unboundedPreceding, 0)
    ahead, after = F.max(F.when(F.col("seed"), F.col("end"))).over(forth), F.min(F.when(F.col("seed"), F.col("start"))).over(back)
    free = (F.coalesce(ahead, F.lit(0)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
    return one.withColumn("free", F.col("seed") | free).where("free").select("row", "kind", "seed", "start", "end", "hit", "left")


def contexts(left: Column) -> Column:
    """The patterns of what stands before an instance: its last word and its last two, in small letters, digits alike."""
    shown = F.regexp_replace(F.regexp_replace(F.lower(left), "[0-9]", "0"), r"\s+", " ")
    two, one = F.regexp_extract(shown, r"(\S{1,24} \S{1,24}) ?$", 1), F.regexp_extract(shown, r"(?:^|\s)(\S{1,24}) ?$", 1)
    return F.filter(F.array(F.concat(F.lit("1 "), one), F.concat(F.lit("2 "), two)), lambda c: F.length(c) > 2)


def instance_of(hit: Column) -> Column:
    """The same for all ways to set off the parts of an instance."""
    return F.md5(F.regexp_replace(F.lower(hit), r"[\s().\[\]{}_/-]", "").cast("binary"))


def _graph(items: DataFrame) -> DataFrame:
    """(pattern, kind, instance, seed), each once: patterns that some candidate follows, and their instances."""
    edges = items.select(F.explode(contexts(F.col("left"))).alias("pattern"), "kind", instance_of(F.col("hit")).alias("instance"), "seed")
    edges = edges.groupBy("pattern", "kind", "instance").agg(F.max("seed").alias("seed"))
    open_ = edges.where("NOT seed").select(F.col("pattern").alias("of")).distinct()
    return edges.join(open_, F.col("pattern") == F.col("of"), "left_semi")


def _round(edges: DataFrame, likely: DataFrame) -> DataFrame:
    """How likely each candidate (kind, instance) is by the patterns that it follows, in millionths."""
    held = edges.join(likely, ["kind", "instance"], "left").withColumn("sure", F.when(F.col("seed"), 1_000_000).otherwise(F.coalesce("sure", F.lit(0))).cast("long"))
    sums = held.groupBy("pattern").agg(*[F.sum(F.when(F.col("kind") == k, F.col("sure")).otherwise(0)).alias(f"s{k}") for k in range(len(KINDS))])
    every = sum((F.col(f"s{k}") for k in range(len(KINDS))), F.lit(0))
    support = F.when(F.startswith(F.col("pattern"), F.lit("1")), SUPPORT[0]).otherwise(SUPPORT[1])
    stack = F.array(*[F.struct(F.lit(k).alias("kind"), F.when(F.col(f"s{k}") >= support, F.col(f"s{k}") / (every + DOUBT)).alias("purity")) for k in range(len(KINDS))])
    good = sums.select("pattern", F.explode(stack).alias("g")).select("pattern", "g.kind", "g.purity").where(F.col("purity") >= LEAST_PATTERN)
    # Whole numbers add up alike in any order.
    weight = F.round(-1_000_000 * F.log(1 - F.col("purity"))).cast("long")
    found = edges.where("NOT seed").join(good.select("pattern", "kind", weight.alias("w")), ["pattern", "kind"]).groupBy("kind", "instance").agg(F.sum("w").alias("w"))
    return found.select("kind", "instance", F.round(1_000_000 * (1 - F.exp(-F.col("w") / 1_000_000))).cast("long").alias("sure"))


def discovered(items: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(kind, instance, sure) of the candidates that are likely in the end."""
    edges = written(_graph(items), "graph")
    likely = edges.where("false").select("kind", "instance", F.lit(0).cast("long").alias("sure"))
    for _ in range(rounds):
        likely = written(_round(edges, likely), "likely")
    return likely.where(F.col("sure") >= LEAST_INSTANCE)


def personal_data(docs: DataFrame, keep=("doc_id",), rounds: int = ROUNDS) -> DataFrame:
    """What personal data each row of ``docs`` holds.

    Returns the columns ``keep``, found (kind, start, end, base and text of each span, by start, then kind in
    the order of ``KINDS``; code points, end exclusive) and how many base spans of each kind there are
    (n_email, n_ip, n_card, n_phone). Base spans are the seeds; the others were discovered by the words before them.

    A null or empty text has none. Equal rows have equal spans, and an instance counts once however
    many rows repeat it. Empty input gives empty output; other columns are ignored.
    """
    names = list(dict.fromkeys(keep))
    scan = written(_scan(docs, names), "scan")
    items = written(_items(scan), "items")
    likely = discovered(items, rounds)
    more = items.where("NOT seed").withColumn("instance", instance_of(F.col("hit"))).join(likely, ["kind", "instance"])
    # Of discovered spans that overlap, the one that begins first stays, then the longest, then the likeliest.
    order = Window.partitionBy("row").orderBy("start", F.col("end").desc(), F.col("sure").desc(), "kind")
    more = more.withColumn("past", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))).where("past IS NULL OR past <= start")
    span = F.struct("start", "kind", "end", F.col("seed").alias("base"), F.col("hit").alias("text"))
    spans = items.where("seed").unionByName(more.select(*items.columns)).groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    out = scan.select("kept", "row").join(spans, "row", "left").withColumn("spans", F.coalesce("spans", F.array()))
    named = F.transform("spans", lambda s: F.struct(F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"), s["text"].alias("text")))
    counts = [F.size(F.filter("found", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return out.withColumn("found", named).select("kept.*", "found", *counts)


def shown(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13_personal_data(spark, sf_dir: str) -> DataFrame:
    """The counts are those of base spans."""
    found = finished("personal", lambda: personal_data(table(spark, sf_dir, "documents")))
    base = F.sha2(shown(F.filter("found", lambda s: s["base"])).cast("binary"), 256)
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", base.alias("base_sha256"), shown(F.col("found")).alias("spans"))
