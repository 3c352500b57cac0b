"""Numpy helpers on batches of texts: words, 64-bit word hashes and word n-grams.

A word is a maximal run of bytes other than space, tab, newline, vertical tab, form feed
and carriage return.  All functions work on whole texts; a null text has no words.  The
hashes depend on the bytes alone, so every executor and every run computes the same ones.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

U64 = np.uint64
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
CHUNK = 1 << 20

_RNG = np.random.Generator(np.random.PCG64(20240607))
BYTE_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Everything but ASCII letters and digits and the bytes of other characters.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[128:] = NOT_ALNUM[48:58] = NOT_ALNUM[65:91] = NOT_ALNUM[97:123] = False


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base & MASK, U64)
    p[:1] = 1
    return np.cumprod(p, dtype=U64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole word."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


class Words:
    """Words of a batch: ``doc`` (index into the batch), byte ``start``/``end`` in ``buf``,
    ``hash``; ``first`` has, per document, the index of its first word (one more at the end)."""

    def __init__(self, texts: list[str | bytes | None], lower: bool = True, gap: np.ndarray = SPACE):
        raw = [b"" if t is None else t if isinstance(t, bytes) else t.encode("utf-8", "replace") for t in texts]
        buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        size = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
        self.doc_start = np.concatenate(([0], np.cumsum(size)))
        self.buf = LOWER[buf] if lower else buf
        space = gap[buf]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        self.hash = self.hashes(self.end)
        self.first = np.searchsorted(self.start, self.doc_start[:-1]) if len(raw) else np.zeros(0, np.int64)
        self.first = np.concatenate((self.first, [len(self.start)]))
        self.doc = np.repeat(np.arange(len(raw)), np.diff(self.first))

    def hashes(self, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes from each word's start to ``end`` (within the word)."""
        out = np.empty(len(self.start), U64)
        i = 0
        while i < len(self.start):  # bounded pieces, so that one long text needs no long arrays
            lo = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.end, lo + CHUNK)))
            hi = self.end[j - 1]
            part = BYTE_VALUE[self.buf[lo:hi]]
            up, down = _table(hi - lo + 1)
            total = np.concatenate((np.zeros(1, U64), np.cumsum(part * up[:len(part)], dtype=U64)))
            s, e = self.start[i:j] - lo, end[i:j] - lo
            out[i:j] = mix((total[e] - total[s]) * down[s])
            i = j
        return out

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


_TABLES: dict[str, np.ndarray] = {}


def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_TABLES.get("up", ())) < n:
        n = max(n, 1 << 16)
        _TABLES["up"], _TABLES["down"] = _powers(BASE, n), _powers(BASE_INV, n)
    return _TABLES["up"], _TABLES["down"]


def ngrams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of every n-word window that lies in one document."""
    k = len(words.hash) - n + 1
    if k <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    at = np.flatnonzero(words.doc[:k] == words.doc[n - 1:])
    h = np.zeros(len(at), U64)
    for j in range(n):
        h = h * U64(BASE) + words.hash[at + j]
    return mix(h), at


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Per text its sorted distinct ``n``-word shingle hashes; a text of fewer words is one
    shingle, a text without words has none."""
    w = Words(texts)
    h, at = ngrams(w, n)
    cut = np.searchsorted(at, w.first)
    out = []
    for i, m in enumerate(w.counts()):
        if m >= n:
            s = np.sort(h[cut[i]:cut[i + 1]])
            keep = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif m:
            x = np.array([m], U64)
            for j in range(w.first[i], w.first[i + 1]):
                x = mix(x * U64(BASE) + w.hash[j:j + 1])
            out.append(x)
        else:
            out.append(np.zeros(0, U64))
    return out


def slices(batches: Iterable, column: str, limit: int = 1 << 20) -> Iterator:
    """Arrow batches cut so that each holds about ``limit`` bytes of ``column`` (or one row)."""
    for b in batches:
        if not b.num_rows:
            continue
        size = [0 if v is None else v for v in _lengths(b.column(b.schema.get_field_index(column)))]
        at = total = 0
        for i, v in enumerate(size):
            total += v
            if total >= limit:
                yield b.slice(at, i + 1 - at)
                at, total = i + 1, 0
        if at < b.num_rows:
            yield b.slice(at)


def _lengths(col) -> list[int | None]:
    import pyarrow.compute as pc
    return pc.binary_length(col).to_pylist()
