"""The training-data operators against brute force, and on nulls, empty tables, repeated rows
and extra columns with clashing names."""

import hashlib
import math
import os
import re
import time
import zlib
from collections import Counter
from functools import reduce

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from corpuslake.llm import common, decontaminate, fitting, graph, langmodel, language, mixing, nearest, numtext, quality, queries, repeats, similar, simhash, substrings, suffixes, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, row long, kept string, fp string"
have = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def docs_of(spark, texts, **other):
    rows = [(i, t, other.get("lang", "en"), f"s{i % 3}", len(t or ""), "k", 1, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def texts():
    import duckdb

    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    found = [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()]
    rng = np.random.default_rng(1)
    long = " ".join(f"w{n}" for n in rng.integers(0, 999, 3000))
    shared = [f"x{i} " * 3 + " ".join(long.split()[i * 7 : i * 7 + 300]) + f" y{i}" for i in range(12)]
    return [*found, None, "", "   ", "a " * 300, "ab" * 900, found[3], found[3], "Éa ñ b", *shared]


def brute_repeats(texts, size, words):
    lines = [(t or "").encode().split() if words else (t or "").encode() for t in texts]
    key = lambda line, i: tuple(line[i : i + size]) if words else line[i : i + size]
    seen = Counter(key(line, i) for line in lines for i in range(len(line) - size + 1))
    out = []
    for line in lines:
        hit = [False] * len(line)
        for i in range(len(line) - size + 1):
            if seen[key(line, i)] > 1:
                hit[i : i + size] = [True] * size
        left = b" ".join(w for w, h in zip(line, hit) if not h) if words else bytes(b for b, h in zip(line, hit) if not h)
        spans = sum(h and not (i and hit[i - 1]) for i, h in enumerate(hit))
        out.append((len(line), sum(hit), spans, hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("limit", [1000, 2])
def test_substring_dedup(spark, texts, limit, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP_LIMIT", limit)
    got = substrings.substring_dedup(docs_of(spark, texts), with_text=True).collect()
    want = brute_repeats(texts, 35, True)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == {i: (n, m, h) for i, (n, m, _, h) in enumerate(want)}
    text = {r.doc_id: r.kept_text for r in got}
    assert all(hashlib.sha256(b" ".join((text[i] or "").encode().split())).hexdigest() == w[3] for i, w in enumerate(want))


@pytest.mark.parametrize("limit", [1000, 2])
def test_suffix_dedup(spark, texts, limit, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP_LIMIT", limit)
    got = suffixes.suffix_dedup(docs_of(spark, texts)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == dict(enumerate(brute_repeats(texts, 400, False)))


def test_equal_rows_repeat_each_other(spark):
    line = " ".join(f"w{i}" for i in range(50))
    df = docs_of(spark, [line]).unionAll(docs_of(spark, [line]))
    assert [(r.n_words, r.n_removed) for r in substrings.substring_dedup(df).collect()] == [(50, 50)] * 2
    assert substrings.substring_dedup(docs_of(spark, [line]).where("false")).count() == 0


@pytest.mark.parametrize("remover", [substrings.substring_dedup, suffixes.suffix_dedup])
def test_many_equal_rows(spark, remover):
    """2000 rows equal in (null) id and text, and one other that holds the same passage."""
    line = " ".join(f"w{i}" for i in range(1500))
    same = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(line).alias("text"), F.lit("a").alias("k1"))
    df = same.unionAll(spark.createDataFrame([(1, "new " + line[:3000], "b"), (2, None, "c"), (2, None, "c"), (3, "short", "d"), (3, "short", "d")], "doc_id long, text string, k1 string"))
    began = time.monotonic()
    got = Counter((r.doc_id, r[1], r.n_removed, r.kept_text) for r in remover(df, with_text=True).collect())
    assert time.monotonic() - began < 60
    words = remover is substrings.substring_dedup
    n = 1500 if words else len(line)
    rest = "new " + line[:3000]
    want = brute_repeats([line, line, rest], 35 if words else 400, words)[2]
    assert got[(None, n, n, "")] == 2000 and got[(2, 0, 0, None)] == 2 and got[(3, 1 if words else 5, 0, "short")] == 2
    assert [k[1:3] for k in got if k[0] == 1] == [want[:2]]


def test_units_of_a_long_text_take_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(8)
    words = np.char.add("w", rng.integers(0, 10**5, 2_500_000).astype(str))
    text = " ".join(words.tolist()).encode() + b" " + b"x" * 9000
    del words
    for alphabet in (repeats.Alphabet(True, 35, 6), repeats.Alphabet(False, 400, 64)):
        tracemalloc.start()
        first, last, anchor, _ = repeats.units(alphabet, line := alphabet.line(text))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 14 * len(text) and last[-1] == line.n - alphabet.size and (anchor >= last).all()
        assert (first[1:] == last[:-1] + 1).all()


def test_suffix_tree_has_sorted_leaves_and_common_prefixes():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 3, 300)
    starts = rng.permutation(300 - 11)[:200]
    tree = substrings.SuffixTree(words, starts, 11)
    lines = [tuple(words[s : s + 11].tolist()) for s in starts[tree.leaves]]
    assert lines == sorted(lines)
    share = lambda a, b: next((i for i in range(11) if a[i] != b[i]), 11)
    assert tree.common.tolist() == [0, *map(share, lines[:-1], lines[1:])]
    first, last, depth = tree.nodes(5)
    assert all(len({x[:d] for x in lines[a : b + 1]}) == 1 and d >= 5 for a, b, d in zip(first, last, depth))
    assert sum(last - first + 1) == sum(c > 1 for x in lines for c in [sum(y[:5] == x[:5] for y in lines)])
    assert len(substrings.SuffixTree(words, starts[:0], 11).nodes(5)[0]) == 0


def test_suffix_sort_is_lexicographic():
    rng = np.random.default_rng(0)
    parts = [bytes(rng.integers(97, 99, int(n)).astype(np.uint8)) for n in rng.integers(0, 40, 200)]
    group = np.sort(rng.integers(0, 9, 200))
    s = suffixes.Suffixes(parts, 64)
    order, lcp = s.sorted_with_common(group)
    plain, plain_lcp = s._plain(group)
    assert [parts[i] for i in order] == [parts[i] for i in plain] and lcp.tolist() == plain_lcp.tolist()


def test_hashes_do_not_depend_on_place():
    buf = np.frombuffer(b"abc xyz abc", np.uint8)
    s, e = numtext.spans(buf)
    h = numtext.range_hash(numtext.prefix_hash(buf), s, e)
    assert h[0] == h[2] != h[1]
    pieces = list(numtext.pieces([b"aa bb cc", None, b"dd"], limit=3))
    assert b"".join(bytes(p) for p, _ in pieces).split() == [b"aa", b"bb", b"cc", b"dd"]


# SimHash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2 and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def test_simhash(spark, texts):
    fps = [brute_fingerprint(t) for t in texts]
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.simhash_components(docs_of(spark, texts)).collect()}
    assert got == {i: x for i, x in enumerate(zip(fps, brute_components(fps)))}
    kept = simhash.near_duplicates(docs_of(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute_components(fps))) and "row" in kept.columns
    assert simhash.simhash_components(docs_of(spark, texts).where("false")).count() == 0


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_pipeline_near_duplicates(spark, block, monkeypatch):
    """Against all pairs on planted copies, most of them more than two SimHash bits apart."""
    monkeypatch.setattr(similar, "BLOCK_SHINGLES", block)
    rng = np.random.default_rng(4)
    texts = [None, "", " ", "a b", "A  b", "a c"]
    for _ in range(12):
        base = [f"w{n}" for n in rng.integers(0, 5000, 150)]
        texts.append(" ".join(base))
        for edits in (1, 2, 3, 4, 6, 9):
            copy = list(base)
            for at in rng.integers(0, 150, edits):
                copy[at] = f"z{rng.integers(0, 9999)}"
            texts.append(" ".join(copy))
    runs = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    sets = [runs((t or "").lower().split()) for t in texts]
    root = list(range(len(sets)))
    far = 0
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or len(x & y) >= 0.8 * len(x | y):
                far += (simhash.fingerprint(texts[i] and texts[i].encode()) ^ simhash.fingerprint(texts[j] and texts[j].encode())).bit_count() > 2
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    assert far > 12
    kept = corpus_pipeline.near_duplicate(spark, docs_of(spark, texts), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root))
    assert corpus_pipeline.near_duplicate(spark, docs_of(spark, texts).where("false"), "").count() == 0


@pytest.mark.parametrize("limit", [64, 2])
def test_links_find_all_components(spark, limit):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**62, 40)
    fps = set(base.tolist())
    for b in base[:10].tolist():
        at = b
        for _ in range(12):
            at ^= (1 << int(rng.integers(0, 64))) ^ (1 << int(rng.integers(0, 64)))
            fps.add(at)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = {r.node: r.root for r in graph.components(simhash.links(df, 2, limit)).collect()}
    want = brute_components(fps)
    same = lambda xs: {i: frozenset(j for j in range(len(xs)) if xs[j] == xs[i]) for i in range(len(xs))}
    assert same([found.get(s, s) for s in signed]) == same(want)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(5, 5), (None, 3), (100, 99)], "a long, b long")
    roots = {r.node: r.root for r in graph.components(edges).collect()}
    assert roots == {i: 0 for i in range(61)} | {99: 99, 100: 99}
    assert graph.components(edges.where("false")).count() == 0


# Decontamination


def test_decontamination(spark, texts, monkeypatch):
    items = [t[: 40 * (i + 2)] for i, t in enumerate(texts[:12])] + ["the of", None, "", "!!!", (texts[5] or "")[:200]]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(3, items[3])], "item_id long, text string")
    split = lambda t: [w for w in "".join(c if not ord(c) < 128 or c.isalnum() else " " for c in (t or "").translate({x: x + 32 for x in range(65, 91)})).split(" ") if w]
    windows = {}
    for i, t in enumerate(items):
        w = split(t)
        for at in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[at : at + 13]), set()).add(str(i))
    lengths = {len(k) for k in windows}
    want = {}
    for i, t in enumerate(texts):
        w, hit, found = split(t), set(), set()
        for n in lengths:
            for at in range(len(w) - n + 1):
                if (k := tuple(w[at : at + n])) in windows:
                    hit |= set(range(at, at + n))
                    found |= windows[k]
        want[i] = (len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w))
    for rarest, asked, sent in ((3, 1 << 22, 200_000), (1, 1 << 22, 0), (13, 150, 0)):
        monkeypatch.setattr(decontaminate, "RAREST", rarest)
        monkeypatch.setattr(decontaminate, "ASKED_TERMS", asked)
        monkeypatch.setattr(decontaminate, "SENT_DOCUMENTS", sent)
        got = decontaminate.contamination(docs_of(spark, texts), bench).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in got} == want
    monkeypatch.undo()
    assert not any(r.contaminated for r in decontaminate.contamination(docs_of(spark, texts), bench.where("false")).collect())
    assert decontaminate.contamination(docs_of(spark, texts).where("false"), bench).count() == 0


def test_candidates_are_compared_byte_by_byte(spark):
    """What the lists agree on counts only if the words are there: such candidates come from terms of one hash."""
    rows = [(1, 1, b"Delta omega, beta GAMMA", [("w", 0, 0, "delta omega"), ("x", 2, 0, "beta gamma"), ("y", 1, 1, "omega gamma"), ("z", 3, 0, "gamma beta"), ("v", -1, 0, "delta")])]
    df = spark.createDataFrame(rows, "k1 long, k2 long, text binary, asked array<struct<w:string,start:long,at:long,phrase:string>>")
    df = df.withColumn("asked", F.col("asked").cast("array<struct<w:string,start:long,at:long,phrase:binary>>"))
    assert sorted(r.w for r in decontaminate._checked(df, decontaminate._exact).collect()) == ["w", "x"]


def test_one_index_answers_two_benchmarks(spark, monkeypatch):
    df = docs_of(spark, [f"a {i} " + f"{i} " * 12 + "z" for i in range(0, 1500, 50)] + ["7 " * 12, None, ""])
    index = decontaminate.build_index(df, ["doc_id"])
    monkeypatch.setattr(decontaminate, "build_index", lambda *a: pytest.fail("built again"))
    for low, high in ((0, 1500), (400, 700)):
        bench = spark.createDataFrame([(i, f"{i} " * 13 + f"t{i}") for i in range(low, high)], "item_id long, text string")
        got = {r.doc_id: r["items"] for r in decontaminate.matches(df, bench, index=index).collect()}
        assert got == {i: [str(50 * i)] if low <= 50 * i < high else [] for i in range(30)} | {30: [], 31: [], 32: []}
    # Only the folders of the asked terms are opened, and postings are sorted by term, document and place.
    term = decontaminate.postings([b"750"])[0]
    plan = index.folders(term)._jdf.queryExecution().executedPlan().toString()
    part = int(term.view(np.uint64)[0] % np.uint64(64))
    assert re.search(rf"PartitionFilters: \[[^\]]*part#\d+ = {part}\)", plan)
    assert index.lists.select("part").distinct().count() > 10
    found = decontaminate.positions(index, term).collect()
    assert len(found) == 13 and [r.place for r in sorted(found)] == sorted(r.place for r in found)
    for lists in index.lists.collect():
        terms, counts, rows, places = decontaminate.unpacked(*(lists[c] for c in ("terms", "counts", "rows", "places")))
        own = list(zip(np.repeat(terms, counts).tolist(), rows.tolist(), places.tolist(), strict=True))
        assert own == sorted(own)


def test_spans_are_merged_whatever_their_order(spark):
    rows = [([[5, 9], [0, 3], [2, 4], [9, 12], [20, 21]],), ([],), ([[1, 2], [1, 2]],)]
    df = spark.createDataFrame(rows, "s array<array<int>>").select(decontaminate._merged(F.col("s")).alias("m"))
    assert [r.m for r in df.collect()] == [[[0, 4], [5, 12], [20, 21]], [], [[1, 2]]]


def test_proximity(spark):
    bench = spark.createDataFrame([("q", "alpha beta gamma")], "item_id string, text string")
    df = docs_of(spark, ["gamma x beta y alpha", "alpha " + "z " * 50 + "beta gamma", None])
    assert {(r.doc_id, r.item) for r in decontaminate.proximity_matches(df, bench, 5).collect()} == {(0, "q")}


# Mixing


def test_mixing_meets_budgets(spark, texts):
    got = mixing.mix_sources(docs_of(spark, texts)).collect()
    sizes = {i: len((t or "").encode().split()) for i, t in enumerate(texts)}
    assert {r.doc_id: r.size for r in got} == sizes
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
        assert 0 <= r.taken <= 2 * r.size
    total = sum(sizes.values())
    assert abs(sum(rs[0].target for rs in by.values()) - 1.5 * total) < 1e-6 * total
    for rs in by.values():
        assert sum(r.taken for r in rs) == math.floor(rs[0].target + 0.5) and rs[0].target <= 2 * rs[0].source_size
        assert sum(r.cut for r in rs) <= 1
    again = mixing.mix_sources(docs_of(spark, texts).repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_mixing_edges(spark):
    rows = spark.createDataFrame([(1, None, None), (2, "a b", None), (None, "c", "s"), (None, "c", "s")], "doc_id long, text string, source string")
    # Two words in the null source, which weighs 1, and two in "s", which weighs 3 and is full at twice its size.
    got = mixing.mix_sources(rows).collect()
    assert sorted((r.source or "", r.target) for r in got) == [("", 2.0), ("", 2.0), ("s", 4.0), ("s", 4.0)]
    assert sorted((r.source or "", r.taken) for r in got) == [("", 0), ("", 2), ("s", 2), ("s", 2)]
    many = spark.range(300).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("w "), F.col("id")).alias("text"), F.lit("s").alias("source"))
    keys = many.select(mixing.sort_key(F.col("doc_id"), F.col("text"), 17).alias("k")).distinct().count()
    assert keys == 300 and sum(r.taken for r in mixing.mix_sources(many).collect()) == 900
    assert mixing.mix_sources(rows.where("doc_id = 1")).first().taken == 0
    assert mixing.mix_sources(rows.where("false")).count() == 0


# Nearest neighbours


@pytest.mark.parametrize("query_bytes", [32 << 20, 1000])
def test_nearest(spark, query_bytes, monkeypatch):
    rng = np.random.default_rng(4)
    v = np.round(rng.normal(size=(300, 16)), 2).astype(np.float32)
    v[10] = v[20]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (920, [0.0] * 16), (940, [float("nan")] * 16), (960, [1.0, None] * 8), (None, v[0].tolist()), (980, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    monkeypatch.setattr(nearest, "ROW_BLOCK", 64)
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 4)
    monkeypatch.setattr(nearest, "QUERY_BYTES", query_bytes)
    got = nearest.nearest(df, df.where("vec_id % 20 = 0"), 20).collect()
    want = set()
    for q in range(0, 300, 20):
        s = [reduce(lambda t, ab: t + float(ab[0]) * float(ab[1]), zip(v[q], x), 0.0) for x in v]
        best = sorted((i for i in range(300) if i != q), key=lambda i: (-s[i], i))[:20]
        want |= {(q, r + 1, i, s[i]) for r, i in enumerate(best)}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want
    few = nearest.nearest(df.where("vec_id < 3"), df.where("vec_id = 0"), 20)
    assert few.count() == 2 and nearest.nearest(df.where("false"), df.where("false")).count() == 0
    assert nearest.nearest(df, df.where("false")).count() == 0 == nearest.nearest(df.where("false"), df).count()
    # Repeated rows compete each for itself, repeated queries ask once.
    twice = df.unionAll(df.where("vec_id IN (0, 7)").withColumn("note", F.lit(1)).drop("note"))
    best = nearest.nearest(twice, twice.where("vec_id = 0"), 300).collect()
    assert len(best) == 300 and [r["rank"] for r in sorted(best, key=lambda r: r["rank"])] == list(range(1, 301)) and sum(r.vec_id == 7 for r in best) == 2


def test_quantisation_bound_holds():
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(50, 24)), rng.normal(size=(60, 24)) * 10
    (ac, as_, al), (bc, bs, bl) = nearest._quantised(a), nearest._quantised(b)
    mid = (ac.astype(float) @ bc.astype(float).T) * as_[:, None] * bs[None, :]
    bound = 0.5 * (al[:, None] * bs + as_[:, None] * bl) + 0.25 * 24 * as_[:, None] * bs
    assert (np.abs(a @ b.T - mid) <= bound + 1e-12).all()


# Models


@have
def test_language(spark):
    got = queries.queries()["op1_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.9
    odd = docs_of(spark, [None, "", "123 !!", "the"])
    names = [r.lang_pred for r in language.identify(odd, *language.prototypes(odd.where("doc_id = 3"))).orderBy("doc_id").collect()]
    assert names == ["und", "und", "und", "en"]
    assert language.identify(odd, [], np.zeros((0, language.DIM))).first().lang_pred == "und"


def test_trigrams_do_not_depend_on_pieces(monkeypatch):
    text = "Ab, ñandú été " * 40
    whole = language._trigrams(text)
    monkeypatch.setattr(language, "PIECE", 7)
    cut = language._trigrams(text)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


@have
@pytest.mark.parametrize("name,label,fold,held,mod", [("op5_quality_fm", "quality", 4, 2, quality), ("op10_toxicity", "toxic", 5, 0, toxicity)])
def test_classifiers(spark, name, label, fold, held, mod):
    sf = SF.replace("0.001", "0.01")
    got = queries.queries()[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % fold == held) and 0 <= r.score <= 1 for r in got)
    # Toxicity has some forty positive rows to learn from here, quality six times as many.
    assert np.mean([r.predicted == r[label] for r in got if r.held_out]) > 0.85
    plain = docs_of(spark, [None, "", "same words here", "same words here"])
    labels = spark.createDataFrame([(0, None, None)], "doc_id long, quality int, toxic int")
    scorer = quality.quality_scores if mod is quality else toxicity.toxicity_scores
    scores = [r.score for r in scorer(plain, labels).orderBy("doc_id").collect()]
    assert len(scores) == 4 and scores[2] == scores[3] and all(0 <= s <= 1 for s in scores)
    assert scorer(plain.where("false"), labels).count() == 0


def test_language_cosines_against_brute_force():
    """Letter vectors bound and bundled one trigram at a time; few of them kept bound."""
    rng = np.random.default_rng(2)
    protos = rng.normal(size=(3, 64)).astype(np.float32)
    space = language.Space(64)
    for text in ("the ñandú of The", "aaaa", "x"):
        grams = Counter()
        line = [0]
        for ch in text:
            c = language._letter(ord(ch))
            if c or line[-1]:
                line.append(c)
        line += [0] if line[-1] else []
        for a, b, c in zip(line, line[1:], line[2:]):
            grams[(a, b, c)] += 1
        v = np.zeros(64)
        for (a, b, c), n in grams.items():
            v += math.sqrt(n) * np.roll(space.letters[a], 2) * np.roll(space.letters[b], 1) * space.letters[c]
        want = protos @ v / np.linalg.norm(v)
        for room in (1 << 10, 2):
            assert np.allclose(language.Comparer(protos, 64, room)(text), want, atol=1e-5)


def test_toxicity_score_against_brute_force():
    rng = np.random.default_rng(3)
    model = rng.normal(size=toxicity.BUCKETS).astype(np.float32), np.array([-1.0, 0.5, 0.2])
    texts = [b"Some w0rds; here are MORE of them than eight, so two runs, yes", b"one", b"", None]
    got = toxicity.score(model, texts)
    for text, p in zip(texts, got):
        words = [w for w in "".join(c if c.isalnum() or c in "@$*" else " " for c in (text or b"").decode().lower()).split()]
        bags = []
        for w in words:
            buf = np.frombuffer(w.encode(), np.uint8)
            ids, _ = toxicity._bags(buf, np.array([0]), np.array([len(buf)]))
            bags.append(model[0][ids].astype(float))
        logits = []
        for (n, gain), b in zip(toxicity.SCALES, model[1]):
            for at in range(0, max(1, len(words)), n or max(1, len(words))):
                part = np.concatenate([np.zeros(0), *bags[at : at + (n or len(words))]])
                if len(part) or not n:
                    logits.append(gain * (part.mean() if len(part) else 0.0) + b)
        want = 1 / (1 + math.exp(-np.logaddexp.reduce(logits)))
        assert abs(p - want) < 1e-6


@have
def test_toxicity_on_held_out_documents_and_misspellings():
    import duckdb

    sf = SF.replace("0.001", "0.1")
    if not os.path.isdir(sf):
        pytest.skip("no tables here")
    rows = duckdb.sql(f"SELECT d.doc_id, coalesce(text, ''), toxic FROM '{sf}/documents.parquet' d JOIN '{sf}/labels.parquet' USING (doc_id) WHERE toxic IS NOT NULL ORDER BY 1").fetchall()
    held = [zlib.crc32(str(r[0]).encode()) % 5 == 0 for r in rows]
    model = toxicity.fit([r[1].encode() for r, h in zip(rows, held) if not h], [r[2] for r, h in zip(rows, held) if not h], passes=60)
    test = [r for r, h in zip(rows, held) if h]
    p = toxicity.score(model, [r[1].encode() for r in test]) >= 0.5
    y = np.array([r[2] for r in test]) > 0
    assert p[y].mean() > 0.9 and p[~y].mean() < 0.05
    clean = [r[1] for r in test if not r[2] and 200 < len(r[1]) < 2500][:20]
    caught = [np.mean(toxicity.score(model, [(t + " " + w).encode() for t in clean]) >= 0.5) > 0.5 for w in ("stuppid", "disgustin", "moronn", "stup1d", "tra5h", "id1ot", "idiiot", "trrash")]
    assert sum(caught) >= 4, caught


def test_labelled_sample_is_bounded_and_repeatable(spark, monkeypatch):
    docs = docs_of(spark, [f"text number {i} " + "x" * i for i in range(60)])
    docs = docs.unionAll(docs.withColumn("text", F.concat("text", F.lit(" other"))))
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(60)] + [(None, 1, None), (3, 0, None)], "doc_id long, quality int, toxic int")
    texts, y, extra = fitting.labelled_sample(docs, labels, "quality", 4, 2, extra=("n_chars",))
    want = {f"text number {i} ".encode() + b"x" * i: i % 2 for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2}
    assert dict(zip(texts, y)) == want and len(extra["n_chars"]) == len(texts)
    assert fitting.labelled_sample(docs.repartition(5), labels, "quality", 4, 2, extra=("n_chars",))[0] == texts
    monkeypatch.setattr(fitting, "FIT_BYTES", 500)
    few = fitting.labelled_sample(docs, labels, "quality", 4, 2)[0]
    assert 0 < sum(map(len, few)) <= 500 and few == texts[: len(few)]
    assert fitting.labelled_sample(docs, labels, "toxic", 4, 2) == ([], [], {})


def test_factorisation_identity():
    rng = np.random.default_rng(6)
    w, v = rng.normal(size=9), rng.normal(size=(9, 3))
    ids, x = np.array([1, 4, 7]), np.array([0.5, 2.0, 1.0])
    got, _ = quality._raw((0.1, w, v), np.array([0, 3]), ids, x)
    want = 0.1 + w[ids] @ x + sum(v[ids[i]] @ v[ids[j]] * x[i] * x[j] for i in range(3) for j in range(i))
    assert abs(got[0] - want) < 1e-9


def brute_lm(model, counts, texts):
    """log10 probability of each text, token by token, with plain loops over the features' rows."""
    v, out = model.vocabulary, []
    rows = lambda x: ((x * 0x9E3779B97F4A7C15) & (2**64 - 1)) >> (64 - model.bits)
    for t in texts:
        words = (t or "").encode().lower().split()
        line = [v.start, v.start, *[v[w] for w in words], v.end]
        total = 0.0
        for i in range(2, len(line)):
            one, two = line[i - 1], line[i - 2]
            z = model.bias.astype(float) + sum(model.weights[rows(x)].astype(float) for x in (one * 4 + 1, (two * 2**22 + one) * 4 + 2, two * 4 + 3))
            p = np.exp(z - z.max())
            c = int(model.classes_of(np.array([line[i]]))[0])
            n = model.ends if i == len(line) - 1 else counts.get(words[i - 2], 0)
            total += math.log10(p[c] / p.sum()) + math.log10((n + 1) / max(1, model.class_size[c]))
        out.append(total)
    return out


@have
@pytest.mark.parametrize("least_bits", [15, 17])
def test_lm_scores(spark, texts, least_bits, monkeypatch):
    monkeypatch.setattr(langmodel, "FREQUENT", 300)
    monkeypatch.setattr(langmodel, "CLASSED", 200)
    monkeypatch.setattr(langmodel, "LEAST_BITS", least_bits)
    texts = [*texts, "q" * 5000 + " the", "q" * 5000]
    docs = docs_of(spark, texts)
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    learns = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    model, others = langmodel.vocabulary_of(docs.where(learns))
    numbers = langmodel.encoded(docs, model.vocabulary, ["doc_id", "row"], learns)
    langmodel.fit(numbers, model, others)
    got = {r.doc_id: r for r in langmodel.score(numbers, model, others, ["doc_id", "row"]).collect()}
    assert all(r.row == 1 for r in got.values())
    words = [(t or "").encode().lower().split() for t in texts]
    counts = Counter(w for ws, h in zip(words, held) if not h for w in ws)
    ends = held.count(False)
    n, v = sum(counts.values()) + ends, len(counts) + 1
    scores = brute_lm(model, counts, texts)
    for i, ws in enumerate(words):
        base = sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in ws) + math.log10((ends + 1) / (n + v + 1))
        r = got[i]
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.n_tokens == len(ws) + 1 and r.train_tokens == n
        assert r.n_known == sum(w in counts for w in ws) + 1 and abs(r.score - scores[i]) < 1e-4 * max(1, abs(scores[i]))
    assert sum(got[i].score - got[i].base_score for i, h in enumerate(held) if h) > 0
    # All words together, and what is left for unknown ones, have probability one at most.
    share = sum(math.exp(b) for b in model.bias - np.logaddexp.reduce(model.bias))
    assert abs(share - 1) < 1e-4


def test_lm_scores_without_training_or_rows(spark):
    docs = docs_of(spark, ["a b", None, "a b"])
    none = sorted(langmodel.lm_scores(docs, F.lit(False)).collect(), key=lambda r: r.doc_id)
    assert {(r.n_known, r.train_tokens) for r in none} == {(0, 0)} and none[0].score == none[2].score
    assert langmodel.lm_scores(docs.where("false"), F.lit(True)).count() == 0


@have
def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = corpus_pipeline.quality(spark, docs, SF)
    assert first.columns == list(corpus_pipeline.COLUMNS) and 0 < first.count() <= docs.count()
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "text", "size", "taken"} <= set(out.columns) and out.count() > 0
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "substrings", "decontaminate", "mix"]
    left = corpus_pipeline.decontaminate(spark, docs, SF)
    bad = decontaminate.contamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").count()
    assert left.count() == docs.count() - bad


def edge_rows(spark):
    """Nulls in every column, empty and repeated rows, ties, a long text and columns with clashing names."""
    long = " ".join(f"w{i % 700}" for i in range(9000))
    rows = [
        (None, None, None, None, None), (None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "  ", None, "a", 2), (3, "one two", "en", None, 7),
        (4, "one two", "en", None, 7), (None, "one two", "en", "b", 7), (5, long, "en", "b", len(long)), (6, long, "fr", "b", None), (6, long + " end", "fr", "b", 9),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(1) for c in ("k1", "row", "kept", "size", "score", "bucket", "__row", "key")})


def test_pipeline_stages_on_edge_rows(spark, tmp_path):
    spark.createDataFrame([(3, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([("q", "one two"), (None, None)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for df in (edge_rows(spark), edge_rows(spark).select(*corpus_pipeline.COLUMNS)):
        out = {name: stage(spark, df, str(tmp_path)).collect() for name, stage in corpus_pipeline.STAGES}
        n = df.count()
        assert all(list(r.asDict()) == list(corpus_pipeline.COLUMNS) for name, rows in out.items() if name != "mix" for r in rows)
        assert len(out["quality"]) == n and len(out["substrings"]) == n == len(out["mix"])
        # One row without words, one of "one two" and one long one.
        assert sorted((r.text or "").strip()[:7] for r in out["near_duplicates"]) == ["", "one two", "w0 w1 w"]
        assert Counter(r.text for r in out["decontaminate"])["one two"] == 0 and len(out["decontaminate"]) == n - 3
        left = {r.doc_id: r.text for r in out["substrings"] if r.doc_id in (3, 5)}
        assert left == {3: "one two", 5: ""} and sum(r.text is None for r in out["substrings"]) == 2
        assert sum(r.size for r in out["mix"]) == sum(len((r.text or "").split()) for r in df.collect())
        for name, stage in corpus_pipeline.STAGES:
            assert stage(spark, df.where("false"), str(tmp_path)).count() == 0, name


@have
def test_stage_tables_are_deleted(spark):
    folder = common.shared_dir(spark).removeprefix("file://") + "/corpuslake"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    corpus_pipeline.run(spark, SF)
    left = set(os.listdir(folder)) - before
    assert len(left) == 1 and left.pop().startswith("stage-mix")


@pytest.mark.parametrize("name", ["op1", "op2", "op4", "op5", "op7", "op9", "op10"])
def test_operators_on_edge_rows(spark, tmp_path, name):
    """Every operator keeps every row, whatever is null, empty, equal or called like its own columns."""
    labels = spark.createDataFrame([(3, 1, 0), (5, 0, 1), (5, None, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([("q", "one two"), (None, None)], "item_id string, text string")
    run = {
        "op1": lambda d: language.identify(d, *language.prototypes(d), keep=("doc_id", "kept", "row")),
        "op2": lambda d: langmodel.lm_scores(d, F.lit(True), keep=("doc_id", "kept", "row")),
        "op4": lambda d: decontaminate.contamination(d, items, keep=("doc_id", "kept", "__row")),
        "op5": lambda d: quality.quality_scores(d, labels, keep=("doc_id", "kept", "row")),
        "op7": lambda d: suffixes.suffix_dedup(d, keep=("doc_id", "kept", "k1")),
        "op9": lambda d: simhash.simhash_components(d),
        "op10": lambda d: toxicity.toxicity_scores(d, labels, keep=("doc_id", "kept", "row")),
    }[name]
    df = edge_rows(spark)
    got = run(df).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in df.collect())
    assert run(df.where("false")).count() == 0
    bare = edge_rows(spark).drop("n_chars")
    assert len(run(bare).collect()) == len(got)


@have
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_twins(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, SF).toPandas()[list(want.columns)]
    shown = [sorted(map(repr, f.astype(object).values.tolist())) for f in (got, want)]
    assert shown[0] == shown[1] and len(got)
