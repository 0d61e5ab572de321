"""Which 3-grams of bytes lines hold, as a set of hashed bits: what a substring needs, all lines with it have."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from logsift.session import ship_package

BITS = 1 << 16
FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint64)  # odd numbers that scatter bytes


def _hashed(folded: np.ndarray) -> np.ndarray:
    """The bit of each run of three bytes."""
    x = folded.astype(np.uint64)
    h = x[:-2] * FACTORS[0] ^ x[1:-1] * FACTORS[1] ^ x[2:] * FACTORS[2]
    return (h * FACTORS[0] >> np.uint64(12) & np.uint64(BITS - 1)).astype(np.int64)


def _folded(data: bytes | np.ndarray) -> np.ndarray:
    x = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
    return np.where((x >= 65) & (x <= 90), x + 32, x)


def gram_bits(literals: list[str]) -> list[int]:
    """Bits that a line with all these substrings (case aside in ASCII) has; none for those under three bytes."""
    found = [_hashed(_folded(v.encode())) for v in literals if len(v.encode()) > 2]
    return sorted({b for h in found for b in h.tolist()})


def _collect(batches):
    seen = np.zeros(BITS, bool)
    for batch in batches:
        for a in range(0, batch.num_rows, 2000):
            part = batch.column(0).slice(a, 2000)
            _, ends, data = pc.take(part, pa.array(np.arange(len(part)))).cast(pa.large_string()).buffers()
            text = np.frombuffer(data, np.uint8)[: np.frombuffer(ends, np.int64)[len(part)]] if data else np.array([], np.uint8)
            if len(text) > 2:  # runs across two lines add bits, which only keeps a part that could go
                seen[_hashed(_folded(text))] = True
    yield pa.RecordBatch.from_arrays([pa.array([np.packbits(seen).tobytes()], pa.binary())], names=["grams"])


def gram_sets(entries: DataFrame) -> bytes:
    """The bits of all lines: one set comes back from each task, and they are joined here."""
    ship_package(entries.sparkSession)
    out = np.zeros(BITS // 8, np.uint8)
    for r in entries.select("data").mapInArrow(_collect, "grams binary").toLocalIterator():
        out |= np.frombuffer(r.grams, np.uint8)
    return out.tobytes()
