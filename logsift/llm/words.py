"""Words of whole texts, as codes into the distinct words of a batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from logsift.llm.tokens import compact


def split_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row offsets, code of each word, distinct words): words are runs of what is none of the
    bytes 32 and 9 to 13, with A-Z lowered; a null text has no words."""
    texts = compact(texts)
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    offsets = parts.offsets.to_numpy().astype(np.int64)
    flat = parts.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    d = flat.dictionary_encode()
    codes = d.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    keep = pc.not_equal(pc.binary_length(d.dictionary), 0).to_numpy(zero_copy_only=False)
    if not keep.all():
        full = keep[codes]
        before = np.concatenate([[0], np.cumsum(full)])
        return before[offsets], codes[full], d.dictionary
    return offsets, codes, d.dictionary


def hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words: bytes times random odd numbers by place, summed and scrambled, all at once."""
    words = compact(words)
    if not len(words):
        return np.array([], np.uint64)
    _, bounds, data = words.buffers()
    bounds = np.frombuffer(bounds, np.int64)[: len(words) + 1]
    size = np.diff(bounds)
    text = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data and bounds[-1] else np.array([], np.uint8)
    with np.errstate(over="ignore"):
        factor = mix(np.arange(int(size.max()), dtype=np.uint64) + np.uint64(0x51ED270B)) | np.uint64(1)
        out = size.astype(np.uint64)
        for a in range(0, len(words), 65_536):  # a bounded number of words at a time
            z = min(a + 65_536, len(words))
            s, b = size[a:z], bounds[a : z + 1] - bounds[0]
            sums = (text[b[0] : b[-1]].astype(np.uint64) + np.uint64(1)) * factor[np.arange(b[-1] - b[0]) - np.repeat(b[:-1] - b[0], s)]
            full = np.flatnonzero(s)
            if len(full):
                out[a:z][full] += np.add.reduceat(sums, (b[:-1] - b[0])[full])
        return mix(out)


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit integers."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Which of so many equal ranges of 64-bit hashes each hash is in."""
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


SHARD_BYTES = 32 << 20  # of input for each shard


def input_bytes(docs: DataFrame) -> int:
    """Bytes of input as Spark knows them; 2^60 or more if it doesn't."""
    return int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def shards_of(docs: DataFrame) -> int:
    """Shards of hashes: as many as the session's partitions, more where the input (if Spark knows its size) is large for them."""
    size = input_bytes(docs)
    return max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 0 if size >= 1 << 60 else size // SHARD_BYTES)
