"""Golomb codes of sorted integers, and fingerprints from digests.

A sorted list without repeats is coded by its gaps.  The parameter of the code is the power of two next
below 0.69 times the mean gap of the range, so the unary parts of n gaps take fewer than 4 n bits whatever
the values.  Quotients (unary) and remainders (fixed width) lie in two streams, one after the other, so that
both are packed and unpacked by numpy as a whole.
"""

from __future__ import annotations

import struct

import numpy as np

U64 = np.uint64


def encode(values: np.ndarray, span: int) -> bytes:
    """Code of strictly rising ``values`` (uint64) from ``range(span)``."""
    n = len(values)
    if not n:
        return struct.pack("<IB", 0, 0)
    width = max(0, int(0.69 * span / n).bit_length() - 1)
    gap = np.diff(values, prepend=U64(0))
    quotient = (gap >> U64(width)).astype(np.int64)
    unary = np.zeros(int(quotient.sum()) + n, np.uint8)
    unary[np.cumsum(quotient + 1) - 1] = 1
    rest = ((gap[:, None] >> np.arange(width, dtype=U64)) & U64(1)).astype(np.uint8)
    return struct.pack("<IB", n, width) + np.packbits(unary).tobytes() + np.packbits(rest.ravel()).tobytes()


def decode(code: bytes) -> np.ndarray:
    """The values of :func:`encode`."""
    n, width = struct.unpack_from("<IB", code)
    if not n:
        return np.zeros(0, U64)
    data = np.frombuffer(code, np.uint8, offset=5)
    tail = (n * width + 7) // 8
    unary = np.unpackbits(data[:len(data) - tail])
    quotient = np.diff(np.flatnonzero(unary)[:n], prepend=-1) - 1
    gap = quotient.astype(U64) << U64(width)
    if width:
        rest = np.unpackbits(data[len(data) - tail:], count=n * width).reshape(n, width).astype(U64)
        gap |= (rest << np.arange(width, dtype=U64)).sum(axis=1, dtype=U64)
    return np.cumsum(gap, dtype=U64)


def fingerprints(digests: bytes, bits: int) -> np.ndarray:
    """First ``bits`` bits of each 32-byte digest."""
    return np.frombuffer(digests, ">u8").reshape(-1, 4)[:, 0].astype(U64) >> U64(64 - bits)
