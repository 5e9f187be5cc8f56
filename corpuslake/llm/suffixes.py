"""Suffix-array dedup with a hash-compared suffix sort.

Suffixes begin at anchors (see repeats). Within a group they are sorted by a merge sort whose
comparison finds the longest common extension of two suffixes by binary search over prefix
polynomial hashes, so a comparison takes a logarithmic number of steps; all comparisons of a
merge round run at once in numpy. What stands before the anchors is sorted likewise, read
backwards. Common prefixes of neighbours then tell, for every distance between a window and
its anchor, which windows agree on both sides. Hash agreements of neighbours are verified on
the bytes; should one fail, its batch is sorted by plain byte comparison. Only distinct units
are sorted: units that are equal as a whole, and windows of too large groups, are told apart
by 128-bit BLAKE2 digests (see repeats), not by a polynomial hash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from corpuslake.llm.common import finished, table
from corpuslake.llm.numtext import _power_table, prefix_hash
from corpuslake.llm.repeats import Alphabet, remove_repeats

WINDOW = 400
GRAM = 64


class Suffixes:
    """Byte strings laid end to end, compared by hashes."""

    def __init__(self, parts: list[bytes], longest: int):
        self.parts = parts
        self.data = np.frombuffer(b"".join(parts) + b"\0", np.uint8)
        self.size = np.array([len(p) for p in parts], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.prefix = prefix_hash(self.data)
        self.inverse = _power_table(len(self.prefix))[1]
        self.steps = [1 << i for i in range(max(1, longest).bit_length() - 1, -1, -1)]

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of suffixes x and y, by binary search on hashes."""
        fx, fy, most = self.first[x], self.first[y], np.minimum(self.size[x], self.size[y])
        got = np.zeros(len(x), np.int64)
        for step in self.steps:
            fits = got + step <= most
            a, b = np.where(fits, fx + got, 0), np.where(fits, fy + got, 0)
            same = (self.prefix[a + step * fits] - self.prefix[a]) * self.inverse[a] == (self.prefix[b + step * fits] - self.prefix[b]) * self.inverse[b]
            got += step * (fits & same)
        return got

    def less(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether suffix x stands before suffix y; a proper prefix stands first."""
        n = self.common(x, y)
        ended = (n == self.size[x]) | (n == self.size[y])
        return np.where(ended, self.size[x] < self.size[y], self.data[np.minimum(self.first[x] + n, len(self.data) - 1)] < self.data[np.minimum(self.first[y] + n, len(self.data) - 1)])

    def sort(self, group: np.ndarray) -> np.ndarray:
        """Suffix numbers, sorted within each run of equal ``group``: a merge sort, all merges of a round at once."""
        start = np.flatnonzero(np.diff(group, prepend=group[0] - 1 if len(group) else 0)) if len(group) else np.zeros(0, np.int64)
        length = np.diff(np.append(start, len(group)))
        g0, g1 = np.repeat(start, length), np.repeat(start + length, length)
        order, place = np.arange(len(group)), np.arange(len(group)) - g0
        level = 0
        while (1 << level) < (length.max() if len(length) else 0):
            run = place >> level
            other = g0 + ((run ^ 1) << level)
            some = np.flatnonzero(other < g1)
            base, end = other[some], np.minimum(other[some] + (1 << level), g1[some])
            lo, hi, me, left = base.copy(), end.copy(), order[some], (run[some] & 1) == 0
            while (open_ := np.flatnonzero(lo < hi)).size:
                mid = (lo[open_] + hi[open_]) // 2
                rival, own = order[mid], me[open_]
                # Of equals, those of the left run stay ahead.
                swap = left[open_]
                before = self.less(np.where(swap, rival, own), np.where(swap, own, rival)) == swap
                lo[open_] = np.where(before, mid + 1, lo[open_])
                hi[open_] = np.where(before, hi[open_], mid)
            to = np.arange(len(group))
            to[some] = g0[some] + ((run[some] >> 1) << (level + 1)) + (place[some] & ((1 << level) - 1)) + (lo - base)
            merged = np.empty_like(order)
            merged[to] = order
            order = merged
            level += 1
        return order

    def sorted_with_common(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order, and each one's common prefix with the one before it (0 at a group's first)."""
        order = self.sort(group)
        same = np.zeros(len(order), bool)
        same[1:] = group[order[1:]] == group[order[:-1]]
        lcp = np.zeros(len(order), np.int64)
        at = np.flatnonzero(same)
        lcp[at] = self.common(order[at - 1], order[at])
        for i in at.tolist():
            a, b, n = self.parts[order[i - 1]], self.parts[order[i]], int(lcp[i])
            if a[:n] != b[:n] or a[n:] > b[n:]:
                return self._plain(group)
        return order, lcp

    def _plain(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.array(sorted(range(len(self.parts)), key=lambda i: (group[i], self.parts[i])), np.int64)
        lcp = np.zeros(len(order), np.int64)
        for i in range(1, len(order)):
            a, b = self.parts[order[i - 1]], self.parts[order[i]]
            if group[order[i - 1]] == group[order[i]]:
                m = min(len(a), len(b))
                differ = np.flatnonzero(np.frombuffer(a[:m], np.uint8) != np.frombuffer(b[:m], np.uint8))
                lcp[i] = differ[0] if len(differ) else m
        return order, lcp


def _classes(order: np.ndarray, lcp: np.ndarray, group: np.ndarray, depth: int) -> np.ndarray:
    """Number of each suffix's class of those that agree on ``depth`` bytes."""
    new = lcp < depth
    new[0] = True
    new[1:] |= group[order[1:]] != group[order[:-1]]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def resolver(window: int):
    def resolve(key: np.ndarray, lo: np.ndarray, hi: np.ndarray, body: list[bytes]) -> list[np.ndarray]:
        cut = hi.tolist()
        right = Suffixes([b[c:] for b, c in zip(body, cut, strict=True)], 2 * window).sorted_with_common(key)
        left = Suffixes([b[:c][::-1] for b, c in zip(body, cut, strict=True)], 2 * window).sorted_with_common(key)
        out = [np.zeros(n, bool) for n in (hi - lo + 1).tolist()]
        for d in range(int(lo.min()), int(hi.max()) + 1):
            own = np.flatnonzero((lo <= d) & (d <= hi))
            if len(own) < 2:
                continue
            pair = _classes(*right, key, window - d)[own] * (len(key) + 1) + _classes(*left, key, d)[own]
            by = np.argsort(pair, kind="stable")
            twin = pair[by][1:] == pair[by][:-1]
            hit = np.concatenate((twin, [False])) | np.concatenate(([False], twin))
            for i in own[by[hit]].tolist():
                out[i][d - lo[i]] = True
        return out

    return resolve


def suffix_dedup(docs: DataFrame, window: int = WINDOW, keep=("doc_id",), with_text: bool = False) -> DataFrame:
    """The columns ``keep`` of every row, n_bytes, n_removed, n_spans, kept_sha256 and, if asked
    for, kept_text: the text without each byte that a repeated string of ``window`` bytes covers.

    Null and empty texts have no bytes; a text shorter than a window loses nothing; equal rows
    repeat each other. n_spans counts maximal removed runs. Where a cut splits a character, its
    left-over bytes are dropped from kept_text, not from kept_sha256. Empty input gives empty
    output.
    """
    alphabet = Alphabet(False, window, max(1, min(GRAM, window // 2)))
    return remove_repeats(docs, alphabet, resolver(window), list(keep), with_text).withColumnRenamed("n", "n_bytes")


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = finished("suffix-dedup", lambda: suffix_dedup(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: Bytes are taken in hexadecimal, in pieces, so that a window is found without reading its text from the start.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n
  FROM documents),
pieces AS (
  SELECT r, s, substr(x, 2 * s + 1, 2 * 1399) AS p FROM (SELECT r, x, unnest(range(0, greatest(n - 399, 0), 1000)) AS s FROM d)),
windows AS (
  SELECT r, s + i AS place, md5_number(substr(p, 2 * i + 1, 800)) AS h
  FROM (SELECT r, s, p, unnest(range(0, len(p) // 2 - 399)) AS i FROM pieces)),
repeated AS (SELECT r, place FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)),
numbered AS (
  SELECT r, place, sum(CASE WHEN gap <= 400 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY place) AS run
  FROM (SELECT r, place, place - lag(place) OVER (PARTITION BY r ORDER BY place) AS gap FROM repeated)),
runs AS (SELECT r, run, min(place) AS s, max(place) + 400 AS e FROM numbered GROUP BY r, run),
ends AS (
  SELECT r, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS s, s AS e FROM runs
  UNION ALL SELECT r, max(e), NULL FROM runs GROUP BY r),
kept AS (
  SELECT r, string_agg(substr(x, 2 * ends.s + 1, 2 * (coalesce(ends.e, n) - ends.s)), '' ORDER BY ends.s) AS k
  FROM ends JOIN d USING (r) GROUP BY r),
counts AS (SELECT r, sum(e - s) AS n_removed, count(*) AS n_spans FROM runs GROUP BY r)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k, x))) AS kept_sha256
FROM d LEFT JOIN counts USING (r) LEFT JOIN kept USING (r)
"""
