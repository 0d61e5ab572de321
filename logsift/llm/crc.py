"""CRC-32 of joined byte strings from the CRCs of the parts."""

from __future__ import annotations

import numpy as np

_POLY = 0xEDB88320


def _times(matrix: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    for bit in range(32):
        out ^= np.where(x >> np.uint32(bit) & np.uint32(1), matrix[bit], np.uint32(0))
    return out


def _tables() -> np.ndarray:
    """For each power of two, what so many zero bytes do to a CRC, by its four bytes."""
    one = np.array([_POLY] + [1 << i for i in range(31)], np.uint32)  # one zero bit
    for _ in range(3):
        one = _times(one, one)
    tables, byte = np.empty((44, 4, 256), np.uint32), np.arange(256, dtype=np.uint32)
    for p in range(44):
        for k in range(4):
            tables[p, k] = _times(one, byte << np.uint32(8 * k))
        one = _times(one, one)
    return tables


_TABLES = _tables()


def shift(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """The CRCs with so many zero bytes behind: crc(a + b) == shift(crc(a), len(b)) ^ crc(b)."""
    crc, zeros, p = crc.astype(np.uint32).copy(), zeros.astype(np.int64), 0
    while len(zeros) and (rest := zeros >> p).any():
        on = np.flatnonzero(rest & 1)
        x = crc[on]
        t = _TABLES[p]
        crc[on] = t[0][x & 255] ^ t[1][x >> 8 & 255] ^ t[2][x >> 16 & 255] ^ t[3][x >> 24]
        p += 1
    return crc
