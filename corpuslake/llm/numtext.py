"""Text as numpy arrays: words and their hashes for many documents at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes that are held as arrays at a time; longer texts are cut between words.
PIECE = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _power_table(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + 4096)
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)))) for b in (_BASE, _INVERSE)]
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def class_table(separators: bytes) -> np.ndarray:
    """True for bytes that belong to words."""
    t = np.ones(256, bool)
    t[np.frombuffer(separators, np.uint8)] = False
    return t


SPACES = class_table(b" \t\n\x0b\x0c\r")


def spans(buf: np.ndarray, inside: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words in ``buf`` (uint8)."""
    edge = np.flatnonzero(np.diff(inside[buf].view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edge[::2], edge[1::2]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """S with S[i] the polynomial hash of the first i bytes, modulo 2**64."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _power_table(len(buf) + 1)[0][: len(buf)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges [start, end); equal ranges have equal hashes wherever they lie."""
    return mixed((prefix[end] - prefix[start]) * _power_table(len(prefix))[1][start] + (end - start).astype(np.uint64))


def pieces(texts: list[bytes | None], limit: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, row of each byte) for texts joined by line feeds, about ``limit`` bytes at a time.

    A text longer than ``limit`` comes in several pieces, cut at white space where it has any.
    """
    parts: list[bytes] = []
    rows: list[int] = []
    held = 0

    def out():
        buf = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
        return buf, np.repeat(np.array(rows, np.int64), [len(p) + 1 for p in parts])

    for i, t in enumerate(texts):
        t = t or b""
        at = 0
        while at < len(t):
            end = len(t) if len(t) - at <= limit else at + limit
            while end < len(t) and t[end] not in b" \t\n\x0b\x0c\r":
                end += 1
            part = t[at:end]
            if held and held + len(part) > limit:
                yield out()
                parts, rows, held = [], [], 0
            parts.append(part)
            rows.append(i)
            held += len(part) + 1
            at = end
    if parts:
        yield out()
