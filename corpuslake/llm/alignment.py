"""Cross-tokenizer alignment by tokenizer spans.

Two tokenizers cut the same bytes, and the places where both end a token cut the tokens into
groups. The spans that the libraries report (characters for one, bytes for the other, whose immutable
protos the installed version has replaced by offset mappings of the same spans) are the coarse cuts; where they fall short, inside characters of several bytes and runs of byte-fallback
tokens, the bytes that the tokens decode to place the rest.

A single space between two plain characters is a cut of both tokenizers whatever stands around it
(``Tokenizers`` verifies it from the vocabularies), so a text is a sequence of pieces, and each
distinct piece is encoded and aligned once while a task remembers it. A text without such a place
is one piece.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslake.llm.common import finished, slices, table, text_of, written

FOLDER = "/opt/tokenizers"
BYTE_LEVEL, PIECES = f"{FOLDER}/byte_bpe_50k.json", f"{FOLDER}/piece_bpe_32k.model"
#: Bytes of texts that are aligned at a time, and what a task remembers of pieces at most.
BATCH_BYTES, HELD_PIECES, HELD_CHARS = 1 << 20, 400_000, 1 << 26
#: Pieces that the tokenizers get at a time.
LEARNED_AT_ONCE = 8192
#: Pairs whose counts are sent to the tasks at most; the others are joined.
SENT_PAIRS = 1 << 20
#: Links of one group that are written out; those of larger groups are counted by their distinct ids.
GROUP_LINKS = 1 << 16
#: A space between characters that are neither white space nor can melt into their neighbours.
CUT = re.compile(r"(?:(?<=[!-~])|(?<=[^\W_])) (?=[!-~]|[^\W_])")


def byte_alphabet() -> dict[str, int]:
    """The character of each byte in byte-level vocabularies: printable bytes stand for themselves, the
    others for the characters from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}


class Tokenizers:
    """Both tokenizers and the bytes of their entries, from their files' contents."""

    def __init__(self, byte_level: bytes, pieces: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_level.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        alphabet = byte_alphabet()
        self.a_bytes = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        added = {t["content"] for t in json.loads(byte_level).get("added_tokens", [])}
        for entry, i in self.a.get_vocab(with_added_tokens=True).items():
            self.a_bytes[i] = entry.encode() if entry in added else bytes(alphabet[c] for c in entry)
        n = self.b.get_piece_size()
        self.b_single = np.array([self.b.is_byte(i) for i in range(n)])
        names = [self.b.id_to_piece(i) for i in range(n)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if s else p.replace("▁", " ").encode() for p, s in zip(names, self.b_single, strict=True)]
        #: Ids as written before a token of their side, the other side, another group and nothing.
        self.digits = [[f"{i}{mark}" for i in range(max(len(self.a_bytes), n))] for mark in (",", "|", ";", "")]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        # A space ends what stands before it in the first tokenizer if its words are made as byte-level
        # vocabularies make them, and in the second if no piece but those of spaces alone holds one inside.
        made = json.loads(byte_level).get("pre_tokenizer") or {}
        self.cuts = made.get("type") == "ByteLevel" and made.get("use_regex", True) and not made.get("add_prefix_space") and not any(" " in p[1:].replace("▁", " ") and p.strip("▁") for p in names)


class Pieces:
    """What is known of the pieces met so far, by number."""

    def __init__(self, tok: Tokenizers):
        self.tok = tok
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.chars = 0
        self.groups: list[str] = []
        self.sizes = np.zeros((0, 4), np.int64)  # tokens of a and of b, groups, links; all -1: not the same bytes
        self.first, self.pairs, self.links = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def full(self) -> bool:
        return len(self.groups) > HELD_PIECES or self.chars > HELD_CHARS

    def learn(self, new: list[str]) -> None:
        """Align ``new`` pieces, all of them unknown; they get the next numbers."""
        self.number |= {p: len(self.groups) + i for i, p in enumerate(new)}
        made = [align(self.tok, new[i : i + LEARNED_AT_ONCE]) for i in range(0, len(new), LEARNED_AT_ONCE)]
        lines = [line for m in made for line in m[0]]
        self.groups += lines
        self.chars += sum(map(len, new)) + sum(map(len, lines))
        self.sizes = np.concatenate([self.sizes, *[m[1] for m in made]])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.concatenate([m[2] for m in made]))])
        self.pairs, self.links = (np.concatenate([held, *[m[k] for m in made]]) for held, k in ((self.pairs, 3), (self.links, 4)))


def _plain(word: str) -> bool:
    """Whether spaces around a word are cuts on its side: both its ends are characters of CUT."""
    if not word:
        return False
    a, b = word[0], word[-1]
    return ("!" <= a <= "~" or a.isalnum()) and ("!" <= b <= "~" or b.isalnum())


def split(text: str, known: dict[str, int], cuts: bool) -> list[str]:
    """Pieces of a text. Joined by a space they are the text."""
    if not cuts:
        return [text]
    words = text.split(" ")
    for w in words:
        if w not in known and not _plain(w):
            return CUT.split(text)
    return words


def _ends(sizes: np.ndarray, coarse: np.ndarray, clean: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Byte offsets where tokens end: the ``coarse`` one where it is ``clean``, and where it isn't what
    the tokens since the last clean end decode to beyond that. ``first``: where each token's piece begins,
    at the first token of a piece, else -1."""
    total = np.cumsum(sizes)
    ahead = total - sizes
    # The last token before a run begins: a clean end, or the beginning of the piece.
    starts = np.flatnonzero(np.concatenate([[True], clean[:-1]]) | (first >= 0)) if len(sizes) else np.zeros(0, np.int64)
    base = np.where(first[starts] >= 0, first[starts], np.concatenate([[0], coarse[:-1]])[starts])
    run = np.searchsorted(starts, np.arange(len(sizes)), "right") - 1
    refined = base[run] + total - ahead[starts][run]
    return np.where(clean, coarse, refined)


def align(tok: Tokenizers, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each text: its groups as written, (tokens of a, tokens of b, groups, links), distinct id
    pairs; then all pairs (a * size of b's vocabulary + b) and their numbers of links."""
    spaced = [" " + t for t in texts]
    raw = [s.encode() for s in spaced]
    whole = np.frombuffer(b"".join(raw), np.uint8)
    begin = np.cumsum([0] + [len(r) for r in raw])

    enc = tok.a.encode_batch(spaced, add_special_tokens=False)
    na = np.array([len(e.ids) for e in enc], np.int64)
    ids_a = np.fromiter(chain.from_iterable(e.ids for e in enc), np.int64, na.sum())
    spans = np.fromiter(chain.from_iterable(chain.from_iterable(e.offsets for e in enc)), np.int64, 2 * na.sum()).reshape(-1, 2)
    chars = np.flatnonzero((whole & 0xC0) != 0x80)  # the byte where each character begins
    ahead = np.searchsorted(chars, begin[:-1])
    of_a = np.repeat(np.arange(len(texts)), na)
    places = np.append(chars, len(whole))
    coarse = places[ahead[of_a] + spans[:, 1]]
    starts = places[ahead[of_a] + spans[:, 0]]
    last = np.append(of_a[1:] != of_a[:-1], True)[: len(of_a)]
    clean = last | (np.append(starts[1:], 0)[: len(starts)] == coarse)
    first = np.where(np.append(True, last[:-1])[: len(last)], begin[:-1][of_a], -1)
    ends_a = _ends(tok.a_size[ids_a], coarse, clean, first)

    found = tok.b.encode(texts, return_type="offset_mapping", return_bytes=True, num_threads=1)
    nb = np.array([len(f["ids"]) for f in found], np.int64)
    ids_b, of_b = np.fromiter(chain.from_iterable(f["ids"] for f in found), np.int64, nb.sum()), np.repeat(np.arange(len(texts)), nb)
    spans = np.fromiter(chain.from_iterable(chain.from_iterable(f["offsets"] for f in found)), np.int64, 2 * nb.sum()).reshape(-1, 2)
    last = np.append(of_b[1:] != of_b[:-1], True)[: len(of_b)]
    first = np.where(np.append(True, last[:-1])[: len(last)], begin[:-1][of_b], -1)
    ends_b = _ends(tok.b_size[ids_b], begin[:-1][of_b] + 1 + spans[:, 1], ~tok.b_single[ids_b], first)

    bad = _different(tok.a_bytes, tok.a_size, ids_a, na, raw) | _different(tok.b_bytes, tok.b_size, ids_b, nb, raw)
    if bad.any():
        keep_a, keep_b = ~bad[of_a], ~bad[of_b]
        ids_a, of_a, ends_a = ids_a[keep_a], of_a[keep_a], ends_a[keep_a]
        ids_b, of_b, ends_b = ids_b[keep_b], of_b[keep_b], ends_b[keep_b]
    common = np.intersect1d(ends_a, ends_b)
    ga, gb = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
    per_a, per_b = np.bincount(ga, minlength=len(common)), np.bincount(gb, minlength=len(common))
    of_group = np.searchsorted(begin, common, "left") - 1
    n = len(texts)
    sizes = np.stack([np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n), np.bincount(of_group, minlength=n), np.bincount(of_group, weights=per_a * per_b, minlength=n).astype(np.int64)], 1)
    sizes[bad] = -1
    pairs, links, of = _links(ids_a, ids_b, ga, gb, per_a, per_b, of_group, len(tok.b_size))
    return _written(tok.digits, ids_a, ids_b, ga, gb, of_group, n), sizes, np.bincount(of, minlength=n), pairs, links


def _different(entries: list[bytes], sizes: np.ndarray, ids: np.ndarray, counts: np.ndarray, raw: list[bytes]) -> np.ndarray:
    """Which texts the tokens do not give back; mostly none, so all are joined and compared at once first."""
    at, out = 0, np.zeros(len(raw), bool)
    ends = np.concatenate([[0], np.cumsum(sizes[ids])])[np.cumsum(counts)]
    ids = ids.tolist()
    if np.array_equal(ends, np.cumsum([len(r) for r in raw])) and b"".join([entries[i] for i in ids]) == b"".join(raw):
        return out
    for k, n in enumerate(counts.tolist()):
        out[k] = b"".join([entries[i] for i in ids[at : at + n]]) != raw[k]
        at += n
    return out


def _links(ids_a, ids_b, ga, gb, per_a, per_b, of_group, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, pair) with their numbers of links, by text."""
    start_b = np.cumsum(per_b) - per_b
    small = (per_a * per_b)[ga] <= GROUP_LINKS
    a, g = ids_a[small], ga[small]
    times = per_b[g]
    which = np.repeat(np.arange(len(a)), times)
    within = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
    pairs, of, links = [a[which] * width + ids_b[start_b[g[which]] + within]], [of_group[g[which]]], [np.ones(len(which), np.int64)]
    for big in np.unique(ga[~small]):
        (x, m), (y, k) = np.unique(ids_a[ga == big], return_counts=True), np.unique(ids_b[gb == big], return_counts=True)
        pairs.append((x[:, None] * width + y).ravel())
        links.append((m[:, None] * k).ravel())
        of.append(np.full(len(x) * len(y), of_group[big]))
    return distinct_links(np.concatenate(pairs), np.concatenate(links), np.concatenate(of))


def distinct_links(pairs: np.ndarray, links: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((pairs, of))
    pairs, links, of = pairs[order], links[order], of[order]
    first = np.flatnonzero(np.concatenate([[True], (pairs[1:] != pairs[:-1]) | (of[1:] != of[:-1])])) if len(pairs) else np.zeros(0, np.int64)
    return pairs[first], np.add.reduceat(links, first) if len(first) else links, of[first]


def _written(digits: list[list[str]], ids_a, ids_b, ga, gb, of_group, n: int) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` for each text."""
    group, side = np.concatenate([ga, gb]), np.concatenate([np.zeros(len(ga), np.int64), np.ones(len(gb), np.int64)])
    order = np.argsort(group * 2 + side, kind="stable")
    ids, group, side = np.concatenate([ids_a, ids_b])[order], group[order], side[order]
    of = of_group[group]
    follows = np.full(len(ids), 3)
    follows[:-1] = np.where(of[1:] != of[:-1], 3, np.where(group[1:] != group[:-1], 2, np.where(side[1:] != side[:-1], 1, 0)))
    shown = [digits[f][i] for i, f in zip(ids.tolist(), follows.tolist(), strict=True)]
    ends = np.cumsum(np.bincount(of, minlength=n)).tolist()
    return ["".join(shown[b:e]) for b, e in zip([0, *ends[:-1]], ends, strict=True)]


_held: dict[tuple[str, str], Pieces] = {}


def _pieces_of(files: tuple[bytes, bytes]) -> Pieces:
    """Kept in the worker from task to task."""
    key = tuple(hashlib.sha256(f).hexdigest() for f in files)
    if key not in _held:
        _held.clear()
        _held[key] = Pieces(Tokenizers(*files))
    return _held[key]


def _aligned(docs: DataFrame, files, keep, groups: bool) -> DataFrame:
    """kept, row, sizes, groups_sha256, groups (null unless asked for), pairs and links of every row."""
    shown = F.struct(*[F.col(c) for c in keep]).alias("kept")
    rows = docs.select(shown, F.monotonically_increasing_id().alias("row"), text_of(F.col("text")).cast("binary").alias("text"))
    longs = T.ArrayType(T.LongType())
    names = ["kept", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "pairs", "links"]
    kinds = [rows.schema["kept"].dataType, *[T.LongType()] * 5, T.StringType(), T.StringType(), longs, longs]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _pieces_of(files.value)
        for b in slices(batches, 2, BATCH_BYTES):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *_batch(held, [t.decode() for t in b.column(2).to_pylist()], groups)], names=names)

    return rows.mapInArrow(run, schema)


def _batch(held: Pieces, texts: list[str], groups: bool) -> list[pa.Array]:
    if held.full():
        held.clear()
    parts = [split(t, held.number, held.tok.cuts) if t else [] for t in texts]
    if new := list({p: None for p in chain.from_iterable(parts) if p not in held.number}):
        held.learn(new)
    count = np.array([len(p) for p in parts], np.int64)
    idx = np.fromiter(map(held.number.__getitem__, chain.from_iterable(parts)), np.int64, count.sum())
    for p in new:
        if not _plain(p):
            del held.number[p]  # a later text may hold it where it is no piece
    of = np.repeat(np.arange(len(texts)), count)
    sizes = held.sizes[idx]
    bad = np.zeros(len(texts), bool)
    bad[of[sizes[:, 0] < 0]] = True
    kept = ~bad[of]
    sums = np.stack([np.bincount(of[kept], weights=sizes[kept, k], minlength=len(texts)).astype(np.int64) for k in range(4)])
    at, lines, shas = 0, [], []
    for k, n in enumerate(count.tolist()):
        line = ";".join([held.groups[i] for i in idx[at : at + n].tolist()]) if n and not bad[k] else ""
        at += n
        shas.append(hashlib.sha256(line.encode()).hexdigest() if line else "")
        lines.append(line if groups else None)
    # Distinct pieces of a text first, then their pairs.
    piece, times, of = distinct_links(idx[kept], np.ones(kept.sum(), np.int64), of[kept])
    first, n = held.first[piece], held.first[piece + 1] - held.first[piece]
    where = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    pairs, links, of = distinct_links(held.pairs[where], held.links[where] * np.repeat(times, n), np.repeat(of, n))
    ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(texts)))]).astype(np.int32))
    return [*map(pa.array, sums), pa.array(shas), pa.array(lines, pa.string()), pa.ListArray.from_arrays(ends, pa.array(pairs)), pa.ListArray.from_arrays(ends, pa.array(links))]


def _scored(aligned: DataFrame, sent) -> DataFrame:
    """Every row with n_best and count_sum over the pairs that were sent, and its other pairs."""
    slim = [c for c in aligned.columns if c not in ("pairs", "links")]
    rows = aligned.select(*slim, "pairs", "links")
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([rows.schema[c] for c in slim] + [T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()), T.StructField("rest", longs), T.StructField("rest_links", longs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, best = sent.value
        for b in batches:
            links = b.column(len(slim) + 1)
            n = np.diff(links.offsets.to_numpy())
            of = np.repeat(np.arange(b.num_rows), n)
            pairs, links = (c.flatten().to_numpy() for c in (b.column(len(slim)), links))
            at = np.minimum(np.searchsorted(known, pairs), max(0, len(known) - 1))
            hit = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
            sums = [np.bincount(of[hit], weights=w[hit], minlength=b.num_rows).astype(np.int64) for w in ((links * best[at], links * count[at]) if len(known) else (links, links))]
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of[~hit], minlength=b.num_rows))]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(slim)], *map(pa.array, sums), *[pa.ListArray.from_arrays(ends, pa.array(x[~hit])) for x in (pairs, links)]], names=schema.names)

    return rows.mapInArrow(run, schema)


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """(pair, n, best) of all linked id pairs: rows that hold it, and whether no other pair of its first id is held by more."""
    counts = written(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "pair-counts")
    most = counts.groupBy(F.expr(f"pair div {width}").alias("a")).agg(F.max("n").alias("most"))
    # One row for each entry of the first vocabulary at most.
    return counts.join(F.broadcast(most), F.expr(f"pair div {width}") == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align_tokenizers(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES, keep=("doc_id",), groups: bool = False) -> DataFrame:
    """Align two tokenizers over every row of ``docs``.

    Returns the columns ``keep``, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and,
    with ``groups``, the groups themselves as ``a1,a2|b1;a3|b2,b3``. ``byte_level`` is a file of the
    first library (byte-level BPE), ``pieces`` one of the second; both are read by the driver and sent.

    Texts that are null, empty or that either tokenizer does not give back byte by byte have zeros and empty
    strings. Equal rows count as one document each. Empty input gives empty output; other columns
    are ignored.
    """
    spark = docs.sparkSession
    content = []
    for path in (byte_level, pieces):
        with open(path, "rb") as f:
            content.append(f.read())
    files = spark.sparkContext.broadcast(tuple(content))
    width = len(Tokenizers(*content).b_size)
    names = list(dict.fromkeys(keep))
    aligned = written(_aligned(docs, files, names, groups), "aligned")
    counts = written(pair_counts(aligned, width), "pairs")
    # How many pairs have a count from 2^k up to 2^(k+1): some 40 numbers.
    by_size = {r["k"]: r["n"] for r in counts.groupBy((F.length(F.bin("n")) - 1).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    least, room = 1 << (max(by_size, default=0) + 1), SENT_PAIRS
    for k in sorted(by_size, reverse=True):
        if by_size[k] > room:
            break
        room, least = room - by_size[k], 1 << k
    frequent = counts.where(F.col("n") >= least).toArrow()  # SENT_PAIRS rows at most
    order = np.argsort(frequent.column("pair").to_numpy())
    sent = spark.sparkContext.broadcast(tuple(frequent.column(c).to_numpy()[order] for c in ("pair", "n", "best")))
    out = _scored(aligned, sent)
    if any(1 << k < least for k in by_size):
        out = written(out, "scores")
        rest = out.select("row", F.explode(F.arrays_zip("rest", "rest_links")).alias("x")).select("row", F.col("x.rest").alias("pair"), F.col("x.rest_links").alias("links"))
        more = rest.join(counts.where(F.col("n") < least), "pair").groupBy("row").agg(F.sum(F.col("links") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("links") * F.col("n")).alias("more_sum"))
        out = out.join(more, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
    return out.select("kept.*", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *["groups"] * groups)


def op12_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    return finished("alignment", lambda: align_tokenizers(table(spark, sf_dir, "documents")))
