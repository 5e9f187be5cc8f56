"""Importance resampling, tokenizer alignment and personal data against plain Python, and on nulls,
empty tables, repeated rows, very long texts and extra columns with clashing names."""

import bisect
import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from corpuslake.llm import alignment, personal, resampling

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, kept string, score long, rank long, kind int, hit string, pairs string"
have = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
tokenizers = pytest.mark.skipif(not os.path.exists(alignment.BYTE_LEVEL), reason="no tokenizers here")


def docs_of(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", 1, 2, "k", 3, 4, 5, "h", "p") for i, t in zip(ids, texts, strict=True)], DOCS)


# Resampling.

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def buckets(text, n=10000):
    w = WORD.findall(bytes(text).lower())
    return [zlib.crc32(b" ".join(w[i : i + k])) % n for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute_resampling(rows, target, percent=5, least=20):
    s, t = (Counter(b for x in texts for b in buckets((x or "").encode())) for texts in ([x for _, x in rows], target))
    S, T = sum(s.values()), sum(t.values())
    out = []
    for i, x in rows:
        mine = buckets((x or "").encode())
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in mine)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(mine), weight, score, None, len(WORD.findall((x or "").encode().lower())) >= least])
    drawn = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(drawn[: percent * len(drawn) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def test_grams_of_a_batch_and_of_parts(monkeypatch):
    rng = random.Random(1)
    texts = [b"", b"a", b"a b", b"The cat, sat " * 5 + b"x" * 200 + b" yy", "é ñandú\0ÉX zz".encode(), b"...", b"\0", b"a\0b c"]
    texts += [b" ".join(rng.choice([b"aa", b"B", b"c9", b"z" * 70]) for _ in range(rng.randint(0, 9))) for _ in range(50)]
    found, of, words = resampling.Grams()(texts)
    assert [sorted(found[of == i].tolist()) for i in range(len(texts))] == [sorted(buckets(t)) for t in texts]
    assert words.tolist() == [len(WORD.findall(t.lower())) for t in texts]
    monkeypatch.setattr(resampling, "BATCH_BYTES", 37)
    long = b" ".join(b"w%d" % rng.randint(0, 50) for _ in range(500)) + b" " + b"q" * 200
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([long, b"a b c d"])], names=["k", "t"])
    grams, out = resampling.Grams(), []
    for _, parts, goes_on, _ in resampling._parts(iter([batch]), 1):
        out += grams(parts, goes_on)[0].tolist()
    assert sorted(out) == sorted(buckets(long) + buckets(b"a b c d"))


def test_crc_of_joined_parts():
    rng = np.random.default_rng(2)
    for n in (0, 1, 63, 64, 1000, 70_001):
        a, b = rng.bytes(20), rng.bytes(n)
        made = resampling.crc_shifted(np.array([zlib.crc32(a)], np.uint32), np.array([n]))[0] ^ np.uint32(zlib.crc32(b))
        assert int(made) == zlib.crc32(a + b)


def test_resampling_against_plain_python(spark, monkeypatch):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "x1", "ab,c"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 19, 20, 40, 90]))) for _ in range(240)] + [None, "", "...", texts_long()]
    rows = [*enumerate(texts), (None, texts[0] + " more words"), (7, texts[7])]
    target = [" ".join(rng.choice(vocabulary[:9]) for _ in range(30)) for _ in range(9)] + [None]
    for size in (1 << 20, 300):
        monkeypatch.setattr(resampling, "BATCH_BYTES", size)
        got = resampling.resample(docs_of(spark, [t for _, t in rows], [i for i, _ in rows]), docs_of(spark, target)).select("doc_id", "n_features", "weight", "score", "rank").collect()
        assert Counter(map(tuple, got)) == Counter(brute_resampling(rows, target))
    with_all = resampling.resample(docs_of(spark, texts[:3]), docs_of(spark, target), keep=("doc_id", "row", "kept", "source"))
    assert with_all.columns == ["doc_id", "row", "kept", "source", "n_words", "n_features", "weight", "score", "rank"]


def texts_long():
    return "long word " * 5000 + "y" * 3000


def test_resampling_of_equal_rows_and_empty_tables(spark):
    same = docs_of(spark, ["a b c d e " * 5] * 400, [1] * 400)
    ranks = sorted(r.rank for r in resampling.resample(same, docs_of(spark, ["a b"])).collect() if r.rank)
    assert ranks == list(range(1, 21))
    empty = docs_of(spark, ["x"]).where("false")
    assert resampling.resample(empty, same).count() == 0
    assert {r.weight for r in resampling.resample(docs_of(spark, [None, ""]), empty).collect()} == {0}


# Tokenizer alignment.


@pytest.fixture(scope="module")
def tok():
    files = [open(p, "rb").read() for p in (alignment.BYTE_LEVEL, alignment.PIECES)]
    return alignment.Tokenizers(*files)


def brute_groups(tok, text):
    if not text:
        return None
    want = (" " + text).encode()
    a, b = tok.a.encode(" " + text, add_special_tokens=False).ids, tok.b.encode(text)
    if b"".join(tok.a_bytes[i] for i in a) != want or b"".join(tok.b_bytes[i] for i in b) != want:
        return None
    ends_a, ends_b = (np.cumsum([len(t[i]) for i in ids]).tolist() for t, ids in ((tok.a_bytes, a), (tok.b_bytes, b)))
    cuts = sorted(set(ends_a) & set(ends_b))
    ga, gb = defaultdict(list), defaultdict(list)
    for ids, ends, g in ((a, ends_a, ga), (b, ends_b, gb)):
        for i, e in zip(ids, ends, strict=True):
            g[bisect.bisect_left(cuts, e)].append(i)
    line = ";".join(",".join(map(str, ga[g])) + "|" + ",".join(map(str, gb[g])) for g in range(len(cuts)))
    return len(a), len(b), len(cuts), line, Counter((x, y) for g in range(len(cuts)) for x in ga[g] for y in gb[g])


def brute_alignment(tok, texts):
    found = [brute_groups(tok, t) for t in texts]
    n = Counter(p for g in found if g for p in g[4])
    best = defaultdict(int)
    for (x, _), c in n.items():
        best[x] = max(best[x], c)
    out = []
    for g in found:
        if g is None:
            out.append((0,) * 6 + ("", ""))
            continue
        links = g[4].items()
        out.append((*g[:3], sum(g[4].values()), sum(m for p, m in links if n[p] == best[p[0]]), sum(m * n[p] for p, m in links), hashlib.sha256(g[3].encode()).hexdigest(), g[3]))
    return out


def odd_texts():
    rng = random.Random(3)
    alphabet = "ab éñ你𝄞 \n\t.,1́ ​\xa0▁<>_ "
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    return [
        "a", "", None, "é", " x", "x ", "a  b", "a\nb", "añ 你𝄞 x  y", "é ́x a ́", "a▁b", "<s> </s> <unk> <|endoftext|>", "　x 。y", "👩‍👩‍👧 family 🏳️‍🌈x", "x\xa0y z",
        "don't 's it", "​ a", " ", "  ", "\n\n a", "ﬁ ½ ²x y", "한국어 텍스트 и русский", "x" * 3000, "9" * 50 + " 1 2", "𝄞𝄞 𝄞", "a\x00b c", "\x1c x \x1c", "﻿a b", "_a _b_ c_", "ab " * 3000 + "\t" + "é " * 50, *made,
    ]


@tokenizers
@pytest.mark.parametrize("sent", [1 << 20, 50, 0])
def test_alignment_against_plain_python(spark, tok, sent, monkeypatch):
    monkeypatch.setattr(alignment, "SENT_PAIRS", sent)
    monkeypatch.setattr(alignment, "GROUP_LINKS", 6 if sent == 50 else 1 << 16)
    texts = odd_texts()
    texts += texts[:9]
    got = alignment.align_tokenizers(docs_of(spark, texts).repartition(3), keep=("doc_id", "row", "kept"), groups=True).collect()
    want = brute_alignment(tok, texts)
    assert len(got) == len(texts)
    assert {r.doc_id: tuple(r)[3:] for r in got} == dict(enumerate(want))


@tokenizers
def test_pieces_are_forgotten(tok, monkeypatch):
    monkeypatch.setattr(alignment, "HELD_PIECES", 5)
    held = alignment.Pieces(tok)
    for t in [t or "" for t in odd_texts()[:40]]:
        made = alignment._batch(held, [t], True)
        want = brute_groups(tok, t)
        assert made[5][0].as_py() == ("" if want is None else want[3])
    assert tok.cuts


@tokenizers
def test_alignment_of_empty_tables(spark):
    assert alignment.align_tokenizers(docs_of(spark, ["x"]).where("false")).count() == 0
    assert [tuple(r)[1:] for r in alignment.align_tokenizers(docs_of(spark, [None, ""])).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2


# Personal data.

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_base(text):
    def luhn(d):
        return sum(n - 9 * (n > 9) for n in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0

    def fits(kind, hit):
        d = re.sub("[^0-9]", "", hit)
        return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in hit.split(".")), "card": lambda: 14 <= len(d) <= 19 and luhn(d), "phone": lambda: 10 <= len(d) <= 15}[kind]()

    return sorted((m.start(), i, m.end()) for i, k in enumerate(personal.KINDS) for m in re.finditer(BASE[k], text or "") if fits(k, m[0]))


def spans_of(found, base):
    return [(s.start, personal.KINDS.index(s.kind), s.end) for s in found if s.base or not base]


def test_base_patterns(spark):
    rng = random.Random(5)
    texts = [
        "a@b.c@d.e", "a@b.c_d@e.f x@y..z q@w.e. a@b.c-", "300.1.2.3.4 1.2.3.4.5.6.7.8 01.002.0255.256 1.2.3", " 4041894974608795 4041-8949 7460 8795-40418949746087950 404189497460879",
        "+1 (988) 555-2485 ext +49.30-1234567)( +1234567890123456 +1-", None, "", "é𝄞 4041894974608795 x@y.zz", "𝄞" * 5 + "+1 (988) 555-2485",
    ]
    texts += ["".join(rng.choice("ab1.@4+- _(é𝄞") for _ in range(rng.randint(1, 60))) for _ in range(500)]
    texts += ["".join(rng.choice("0123456789 -.") for _ in range(rng.randint(1, 80))) for _ in range(500)]
    texts += ["x" * 3000 + " a@b.c", "a@b" + ".c" * 30000, "1" * 3000, "1 " * 3000, "+1" + "-" * 100000, "1." * 3000]
    got = personal.personal_data(docs_of(spark, texts).repartition(3), keep=("doc_id", "kind", "hit", "row")).collect()
    assert {r.doc_id: spans_of(r.found, True) for r in got} == {i: brute_base(t) for i, t in enumerate(texts)}
    for r in got:
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in spans_of(r.found, True)) for k in range(4)]
        assert all(texts[r.doc_id][s.start : s.end] == s.text for s in r.found)


def test_hard_texts_take_linear_time(spark):
    texts = ["x" * 2_000_000 + " a@b.c", "a@b" + ".c" * 30000, "1" * 2_000_000, "1 " * 60000, "+1" + "-" * 100000, "1." * 50000, "+1 " * 50000, "1:" * 50000, "a at b dot " * 20000]
    got = {r.doc_id: len(r.found) for r in personal.personal_data(docs_of(spark, texts)).collect()}
    assert [got[0], got[1], got[5]] == [1, 1, 12500]


def bootstrap_texts():
    out = []
    for i in range(12):
        out += [f"filler word {i} please call me at +1 (555) 201-{1000 + i} thanks", f"text {i} write to user{i}@mail.example.com now", f"host {i} logged in from 10.0.{i}.7 today"]
    out += ["please call me at 555 201 9999 thanks", "ok call me at 555-777-1234 and", "nothing 555 888 1234 here", "again 555-201-9999 alone", "text write to joe (at) mail (dot) org now", "look at the dot product at home dot"]
    # A second context becomes a pattern of its own once its instances are likely.
    out += [f"call me at 555 333 10{i}0 please" for i in range(6)] + [f"ring 55533310{i}0 tonight my line 555 333 10{i}0" for i in range(6)] + ["or my line 555 444 9090 instead"]
    return [*out, "version 2.0.1 on 2024-01-15 12:30:45", "random write to 4111 1111 1111 1112 now", None, ""]


def test_contexts_discover_what_the_seeds_miss(spark):
    texts = bootstrap_texts()
    got = {r.doc_id: [s.text for s in r.found if not s.base] for r in personal.personal_data(docs_of(spark, texts)).collect()}
    found = {texts[i]: x for i, x in got.items() if x}
    assert found["please call me at 555 201 9999 thanks"] == ["555 201 9999"] and found["again 555-201-9999 alone"] == ["555-201-9999"]
    assert found["text write to joe (at) mail (dot) org now"] == ["joe (at) mail (dot) org"]
    assert found["or my line 555 444 9090 instead"] == ["555 444 9090"]
    for clean in ("nothing 555 888 1234 here", "look at the dot product at home dot", "version 2.0.1 on 2024-01-15 12:30:45", "random write to 4111 1111 1111 1112 now"):
        assert clean not in found
    once = {r.doc_id: [s.text for s in r.found if not s.base] for r in personal.personal_data(docs_of(spark, texts), rounds=1).collect()}
    assert not once[texts.index("or my line 555 444 9090 instead")]


def test_copies_do_not_make_a_pattern(spark):
    texts = ["see also +1 (555) 201-1000 ok"] * 50 + ["see also 555 201 9999 ok"]
    assert all(s.base for r in personal.personal_data(docs_of(spark, texts)).collect() for s in r.found)
    assert personal.personal_data(docs_of(spark, ["x"]).where("false")).count() == 0


@have
@pytest.mark.parametrize("name", ["op11_importance_resampling"])
def test_sql_twins(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = resampling.op11_importance_resampling(spark, SF).toPandas().fillna(-1).astype(int)
    want = con.sql(resampling.ORACLE).df().fillna(-1).astype(int)[got.columns]
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist()))


@have
def test_registered_queries_return_every_document(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    found = personal.op13_personal_data(spark, SF)
    assert found.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"] and found.count() == n
    if os.path.exists(alignment.BYTE_LEVEL):
        found = alignment.op12_tokenizer_alignment(spark, SF)
        assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"] and found.count() == n


# Repeats with very long words.


def test_windows_of_very_long_words(spark):
    """Words of 30 kB: groups of such units are dealt out by their windows, and what is repeated stays the same."""
    from corpuslake.llm import repeats, substrings

    rng = np.random.default_rng(4)
    long = ["".join(rng.choice(list("abcdef"), 30_000)) for _ in range(12)]
    short = [f"w{i}" for i in range(90)]
    shared = [x for i in range(40) for x in ((long[i % 12],) if i % 4 == 0 else (short[i],))]
    texts = [" ".join([f"a{k}"] * 3 + shared[k : k + 37] + [f"b{k}", long[k]]) for k in range(4)] + [" ".join(shared), " ".join(short), " ".join(short[5:60]), None]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.substring_dedup(docs_of(spark, texts)).collect()}
    lines = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(x[i : i + 35]) for x in lines for i in range(len(x) - 34))
    for k, x in enumerate(lines):
        hit = [False] * len(x)
        for i in range(len(x) - 34):
            if seen[tuple(x[i : i + 35])] > 1:
                hit[i : i + 35] = [True] * 35
        left = b" ".join(w for w, h in zip(x, hit, strict=True) if not h)
        assert got[k] == (len(x), sum(hit), hashlib.sha256(left).hexdigest())
    assert any(n for _, n, _ in got.values())
    for bad in ((True, 4096, 6), (False, 3, 4)):
        with pytest.raises(ValueError, match="windows of"):
            repeats.Alphabet(*bad)
