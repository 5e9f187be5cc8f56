"""Substring dedup with prefix-partitioned suffix trees.

Suffixes begin at words and count for their first 35 words, the window. They are split into
groups by the six words at their anchor (see repeats), or by the whole window where such a
group would be too large for a task. The suffix tree of the groups that a task holds is built from
sorted suffixes: ranks of their first 1, 2, 4, ... words put the leaves in lexicographic
order, the same ranks give the common prefixes of neighbours, and runs of neighbours with a
common prefix are the internal nodes. A node as deep as the window is a repeat, and its leaves
are the places where that occurs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from corpuslake.llm.common import finished, table
from corpuslake.llm.repeats import Alphabet, remove_repeats

WINDOW = 35
GRAM = 6


class SuffixTree:
    """The suffix tree, down to ``depth`` words, of the suffixes of ``words`` at ``starts``.

    ``words`` are numbers in the order of the words; every suffix has ``depth`` words.
    leaves: the suffixes in lexicographic order; common: words that each shares with the leaf
    before it, 0 for the first.
    """

    def __init__(self, words: np.ndarray, starts: np.ndarray, depth: int):
        levels = [words]
        while (length := 1 << len(levels)) <= depth:
            # The rank of twice as many words is that of the first half and of the second.
            half, n = levels[-1], len(words) - length // 2
            pair = half * (len(words) + 1)
            pair[:n] += half[length // 2 :]
            levels.append(np.unique(pair, return_inverse=True)[1].astype(np.int64))
        length = 1 << (len(levels) - 1)
        key = levels[-1][starts] * (len(words) + 1) + levels[-1][starts + depth - length]
        self.depth, self.leaves = depth, np.argsort(key, kind="stable")
        x, y = starts[self.leaves[:-1]], starts[self.leaves[1:]]
        shared = np.zeros(len(x), np.int64)
        same = key[self.leaves[:-1]] == key[self.leaves[1:]]
        for k in range(len(levels) - 1, -1, -1):
            fits = ~same & (shared + (1 << k) <= depth)
            at = np.where(fits, shared, 0)
            shared += (fits & (levels[k][x + at] == levels[k][y + at])) << k
        shared[same] = depth
        self.common = np.append(0, shared) if len(starts) else shared

    def nodes(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First leaf, last leaf and depth of the topmost internal nodes of ``least`` words or more."""
        deep = np.append(self.common >= least, False)
        edge = np.flatnonzero(np.diff(deep.view(np.int8), prepend=np.int8(0)))
        first, last = edge[::2] - 1, edge[1::2] - 1
        return first, last, np.minimum.reduceat(np.append(self.common, 0), edge)[::2] if len(edge) else first


def resolver(window: int):
    def resolve(key: np.ndarray, lo: np.ndarray, hi: np.ndarray, body: list[bytes]) -> list[np.ndarray]:
        split = [b.split(b" ") for b in body]
        sizes = np.array([len(ws) for ws in split])
        flat = [w for ws in split for w in ws]
        number = {w: i for i, w in enumerate(sorted(set(flat)))}
        words = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
        first = np.cumsum(sizes) - sizes
        count = hi - lo + 1
        row = np.repeat(np.arange(len(body)), count)
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        tree = SuffixTree(words, first[row] + nth, window)
        hit = np.zeros(len(row), bool)
        # Equal windows have equal anchors, so no node joins suffixes of two groups.
        for a, b, _ in zip(*tree.nodes(window), strict=True):
            hit[tree.leaves[a : b + 1]] = True
        # Windows stand in text order; distances to the anchor run the other way.
        return [h[::-1] for h in np.split(hit, np.cumsum(count)[:-1])]

    return resolve


def substring_dedup(docs: DataFrame, window: int = WINDOW, keep=("doc_id",), with_text: bool = False) -> DataFrame:
    """The columns ``keep`` of every row, n_words, n_removed, kept_sha256 and, if asked for,
    kept_text: the text without each word that a repeated window of ``window`` words covers.

    Null and empty texts have no words; a text shorter than a window loses nothing; equal rows
    repeat each other, so both lose what windows cover. A text that loses nothing keeps its
    white space in kept_text; else the words left are joined by one space. Windows are judged
    on the input. Empty input gives empty output.
    """
    alphabet = Alphabet(True, window, max(1, min(GRAM, window // 2)))
    found = remove_repeats(docs, alphabet, resolver(window), list(keep), with_text)
    return found.withColumnRenamed("n", "n_words").drop("n_spans")


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = finished("substring-dedup", lambda: substring_dedup(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS p FROM (SELECT r, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35)),
again AS (SELECT p FROM win GROUP BY p HAVING count(*) > 1),
hit AS (SELECT DISTINCT r, unnest(generate_series(i, i + 34)) AS pos FROM win JOIN again USING (p)),
words AS (SELECT r, unnest(w) AS word, unnest(generate_series(1, len(w))) AS pos FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY pos) AS t FROM words ANTI JOIN hit USING (r, pos) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN (SELECT r, count(*) AS n FROM hit GROUP BY r) USING (r)
"""
