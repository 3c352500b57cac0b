"""Canonical length-limited Huffman codes, coded and decoded with numpy.

Codes have at most ``LIMIT`` bits, so a table of ``2 ** LIMIT`` entries decodes a symbol at once.  A
stream is cut every ``STEP`` symbols by a checkpoint that holds its bit offset; all stretches between
checkpoints are decoded side by side.
"""

from __future__ import annotations

import numpy as np

LIMIT, STEP = 16, 64


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for symbols not seen."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts > 0)
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols do not fit codes of {limit} bits")
    if len(used) < 2:
        out[used] = 1
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.float64)
    level, is_leaf = leaf, [np.ones(len(leaf), bool)]
    for _ in range(limit - 1):
        k = len(level) // 2
        both = np.concatenate((leaf, level[0:2 * k:2] + level[1:2 * k:2]))
        at = np.argsort(both, kind="stable")
        is_leaf.append(at < len(leaf))
        level = both[at]
    length, take = np.zeros(len(leaf), np.uint8), 2 * len(leaf) - 2
    for flags in reversed(is_leaf):  # the lightest leaves among the items taken get one bit more
        leaves = int(flags[:take].sum())
        length[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = length
    return out


def canonical(length: np.ndarray) -> np.ndarray:
    """Codes in the order of (length, symbol)."""
    code = np.zeros(len(length), np.uint64)
    used = np.flatnonzero(length)
    used = used[np.lexsort((used, length[used]))]
    # each code is the sum of the spaces of those before it, read at its own length
    space = np.uint64(1) << (LIMIT - length[used].astype(np.uint64))
    start = np.concatenate((np.zeros(1, np.uint64), np.cumsum(space)[:-1]))
    code[used] = start >> (LIMIT - length[used].astype(np.uint64))
    return code


def decode_table(length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, length) by the next ``LIMIT`` bits."""
    used = np.flatnonzero(length)
    used = used[np.lexsort((used, length[used]))]
    space = 1 << (LIMIT - length[used].astype(np.int64))
    symbol = np.zeros(1 << LIMIT, np.uint32)
    size = np.ones(1 << LIMIT, np.int64)
    n = int(space.sum())
    symbol[:n], size[:n] = np.repeat(used, space), np.repeat(length[used], space)
    return symbol, size


def encode(ids: np.ndarray, first: np.ndarray, length: np.ndarray, code: np.ndarray
           ) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Streams of the documents ``ids[first[i]:first[i + 1]]``, each from a byte boundary.

    Returns the bytes, each document's first byte (one more at the end), the checkpoints (bit offsets
    within the document) and each document's first checkpoint (one more at the end).
    """
    bits = length[ids].astype(np.int64)
    total = np.concatenate((np.zeros(1, np.int64), np.cumsum(bits)))
    size = (total[first[1:]] - total[first[:-1]] + 7) // 8
    start = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
    n = np.diff(first)
    at = total[:-1] + np.repeat(start[:-1] * 8 - total[first[:-1]], n)
    word = at >> 5
    place = code[ids] << (np.uint64(64) - (at & 31).astype(np.uint64) - bits.astype(np.uint64))
    words = int(start[-1] + 3) // 4 + 2
    # codes do not overlap, so sums are unions of bits; 32-bit parts are exact in doubles
    out = np.bincount(word, (place >> np.uint64(32)).astype(np.float64), words)
    out[1:] += np.bincount(word, (place & np.uint64(0xFFFFFFFF)).astype(np.float64), words)[:-1]
    stretches = (n + STEP - 1) // STEP
    marks = np.concatenate((np.zeros(1, np.int64), np.cumsum(stretches)))
    cut = np.repeat(first[:-1], stretches) + STEP * (np.arange(int(marks[-1])) - np.repeat(marks[:-1], stretches))
    inside = total[cut] - np.repeat(total[first[:-1]], stretches)
    return out.astype(np.uint32).astype(">u4").tobytes()[:int(start[-1])], start, inside.astype(np.uint32), marks


def decode(data: bytes, start: np.ndarray, n: np.ndarray, mark: np.ndarray, symbol: np.ndarray, size: np.ndarray
           ) -> np.ndarray:
    """Ids of all documents, one after the other; ``start``: first byte and ``n``: ids of each,
    ``mark``: checkpoints of all."""
    buf = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.uint32)
    stretches = (n + STEP - 1) // STEP
    doc = np.repeat(np.arange(len(n)), stretches)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(stretches) - stretches, stretches)
    pos = start[doc] * 8 + mark.astype(np.int64)
    todo = np.minimum(STEP, n[doc] - nth * STEP)
    to = (np.cumsum(n) - n)[doc] + nth * STEP
    out = np.zeros(int(n.sum()), np.uint32)
    order = np.argsort(-todo, kind="stable")
    pos, todo, to = pos[order], todo[order], to[order]
    for k in range(STEP):
        live = int(np.searchsorted(-todo, -k))  # stretches with more than k symbols
        if not live:
            break
        p = pos[:live]
        i = p >> 3
        look = ((buf[i] << 16 | buf[i + 1] << 8 | buf[i + 2]) >> (8 - (p & 7)).astype(np.uint32)) & 0xFFFF
        out[to[:live] + k] = symbol[look]
        pos[:live] += size[look]
    return out
