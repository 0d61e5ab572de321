"""Best-fit-decreasing packing of token sequences, over all documents at once.

Pieces of one length are interchangeable, so the packing works on counts per length: bins of
equal content form a group, and a segment tree over the remaining capacities finds the tightest
capacity that still has an open bin, in logarithmic time. The result is that of placing
every piece singly, and the plan has at most some ranges for each pair of lengths, however many
documents there are. Pieces find their place by their rank among those of their length, which
needs counts per task and no sort of all rows.

Nulls: a null text is an empty one (its end id is still packed); a null doc_id is kept. Repeated
rows are packed each; which of several pieces of one length takes which place is a tie that changes no count. A very
long text is encoded whole by one worker and cut into pieces. Only doc_id and text are read, so other columns
can't clash. An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logsift.llm.tokens import BYTE_BPE, encoder, lean, slices
from logsift.session import shared_dir, ship_package


class CapacityTree:
    """Segment tree over remaining capacities 0..size: how many open bins have each."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, bins: int) -> None:
        i = capacity + self.leaves
        while i:
            self.count[i] += bins
            i //= 2

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least `least` with an open bin."""
        i = least + self.leaves
        if self.count[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.count[i + 1]:
                i += 1
                break
            i //= 2
        else:
            return None
        while i < self.leaves:
            i = 2 * i if self.count[2 * i] else 2 * i + 1
        return i - self.leaves


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int]]:
    """Best-fit decreasing: (length, first rank, first bin, offset) of runs of pieces that go to
    consecutive bins; a run ends where the next of its length starts."""
    tree, open_bins, runs, bins = CapacityTree(size), {}, [], 0
    for length in sorted((k for k in counts if k), reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:  # new bins: as many pieces to each as fit, all open alike afterwards
                fit = size // length
                full, rest = divmod(left, fit)
                for k in range(fit):
                    if n := full + (k < rest):
                        runs.append((length, rank, bins, k * length))
                        rank += n
                groups = [(bins, full, size - fit * length)] * (full > 0) + [(bins + full, 1, size - rest * length)] * (rest > 0)
                bins += full + (rest > 0)
                left = 0
                for first, n, capacity in groups:
                    open_bins.setdefault(capacity, []).append((first, n))
                    tree.add(capacity, n)
                continue
            first, n = open_bins[room].pop()
            used = min(n, left)
            if used < n:
                open_bins[room].append((first + used, n - used))
            tree.add(room, -used)
            runs.append((length, rank, first, size - room))
            rank, left = rank + used, left - used
            open_bins.setdefault(room - length, []).append((first, used))
            tree.add(room - length, used)
    return runs


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, task_rank long"


def _pieces(path: str, spaces: bool, end_id: int, size: int):
    def run(batches):
        from pyspark import TaskContext

        enc, task, seen = encoder(path, spaces), TaskContext.get().partitionId(), {}
        for batch in batches:
            for b in slices(batch, 1):
                ids, off = enc.encode(b.column(1), end_id)
                data, rows = ids.astype("<u4").tobytes(), []
                for doc_id, a, z in zip(b.column(0).to_pylist(), off[:-1].tolist(), off[1:].tolist()):
                    at, piece = a, 0
                    while at < z:
                        end = at + ((z - at) % size or size)  # only the first can be shorter
                        rank = seen.get(end - at, 0)
                        seen[end - at] = rank + 1
                        rows.append((doc_id, piece, at - a, end - at, zlib.crc32(data[4 * at : 4 * end]), task, rank))
                        at, piece = end, piece + 1
                c = list(zip(*rows)) or [()] * 7
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, kinds)], names=[x.split()[0] for x in PIECES.split(", ")])

    return run


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, size: int = 1024, spaces: bool = True) -> DataFrame:
    """Pieces of docs(doc_id, text) with their sequence and place in it."""
    spark = docs.sparkSession
    ship_package(spark)
    path = shared_dir(spark, "packing")
    docs.select("doc_id", "text").mapInArrow(lean(_pieces(tokenizer_path, spaces, end_id, size)), PIECES).write.parquet(path)
    pieces = spark.read.parquet(path)
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    runs = plan(counts, size)
    keys = np.array([(r[0], r[1]) for r in runs] or [(0, 0)], np.int64)
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    keys, runs = keys[order], np.array([runs[i][2:] for i in order] if runs else [(0, 0)], np.int64)
    lengths, firsts = np.unique(keys[:, 0], return_index=True)
    lasts = np.append(firsts[1:], len(keys))

    def place(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            run = np.empty(len(length), np.int64)
            for k in np.unique(length):
                at, mine = np.searchsorted(lengths, k), length == k
                lo, hi = firsts[at], lasts[at]
                run[mine] = lo + np.searchsorted(keys[lo:hi, 1], rank[mine], "right") - 1
            bins = runs[run, 0] + rank - keys[run, 1]
            cols = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(bins), pa.array(runs[run, 1])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    bases = by_task.select("length", "task", F.coalesce(before, F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["length", "task"]).withColumn("rank", F.col("base") + F.col("task_rank"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        lean(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path(BYTE_BPE), end_id=2)
