"""Exact Jaccard self-join of documents on word shingles, by T-occurrence search.

1. One pass over the texts gives each document its set of shingle hashes, a 128-bit digest of the
   set and a bitmap of parities. Documents with equal sets are one class from here on.
2. The lengths of all inverted lists (in how many sets a shingle stands) are counted from packed, sorted
   blobs by hash range, to which each flush of a task adds every shingle once; each flush is told
   the lengths of those of its shingles that stand in two sets or more.
3. T-occurrence: of a set of n shingles, a linked one must share T = ceil(n percent / 100) at least. DivideSkip
   sets the T - 1 longest lists apart; what is left, the n - T + 1 shortest, must hold each linked document
   once at least, under one order for all sets. So only these short lists are built and merged, over class
   representatives; lists of one are none.
4. Every class of a list is searched against one class of it, that of most short lists. What
   links is joined; the bitmaps rule out most that can't be. All that share lists with one class
   include every pair that shares a list; of them, those still in other components search the rest, by
   bitmaps and by what they differ in from that class, in cells of bounded size that give no more links
   than it takes to join components.
5. A search of a set among candidates is DivideSkip again, over the inverted index of the candidates: short
   lists are merged in a heap, long ones are probed by binary search for those candidates that can still
   reach T.

Nothing is dropped: each linked pair shares a short list, and each pair of a list is either
joined already or searched. Nulls: a null text has no words; such documents have the empty set,
are linked with nothing and are their own component; a null doc_id counts as no id in a
component's least. Repeated rows are one class; ties of list lengths go by the hash. A very long
text is one set, held whole by one worker. Only doc_id and text are read, so other columns can't clash; an
empty table gives no rows. Below 50 percent it is refused, as sizes may then lie further apart than bitmaps compare.
"""

from __future__ import annotations

import heapq
import os
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.llm.tokens import lean, slices
from logsift.llm.words import hashes, input_bytes, mix, part_of, shards_of, split_words
from logsift.llm.ngram_lm import _save
from logsift.session import local_path, shared_dir, ship_package

FLUSH = 1_000_000  # pairs of shingle and document that a task holds at once
SPARE = 12  # bits of a hash in lists, over those that count the bytes of the input
LEAST_BITS = 10  # a set's bitmap has 2^10 bits at least
CELL, CELL_BYTES = 256, 4 << 20  # rows that ask, and bytes, in one cell of a search


def required(a: int, b: int, percent: int) -> int:
    """The least overlap of linked sets of sizes a and b: 100 I >= percent (a + b - I)."""
    return -(-percent * (a + b) // (100 + percent))


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes) of each text's distinct shingles, in order within a row."""
    offsets, codes, words = split_words(texts)
    h = mix(hashes(words))[codes] if len(codes) else np.array([], np.uint64)
    sizes = np.diff(offsets)
    n = np.where(sizes >= width, sizes - width + 1, (sizes > 0).astype(np.int64))
    starts = np.concatenate([[0], np.cumsum(n)])
    row = np.repeat(np.arange(len(n)), n)
    first = np.repeat(offsets[:-1] - starts[:-1], n) + np.arange(starts[-1])
    used = np.minimum(sizes, width)[row]
    with np.errstate(over="ignore"):
        out = np.zeros(len(first), np.uint64)
        for k in range(width):
            out = np.where(used > k, mix(out * np.uint64(0x9E3779B97F4A7C15) + h[np.minimum(first + k, max(len(h) - 1, 0))] + np.uint64(k + 1)), out) if len(h) else out
    order = np.lexsort((out, row))
    out, row = out[order], row[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    out, row = out[new], row[new]
    return np.searchsorted(row, np.arange(len(n) + 1)), out


def _planes(*columns: np.ndarray) -> bytes:
    """Columns of numbers, each by byte planes, compressed."""
    data = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.int64(len(c)).tobytes() for c in columns) + data)


def _columns(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    sizes, at, out = raw[: 8 * len(kinds)].view("<i8").tolist(), 8 * len(kinds), []
    for n, kind in zip(sizes, kinds):
        wide = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * wide].reshape(wide, n).T).reshape(-1).view(kind))
        at += n * wide
    return out


STAGED = "kind int, uid long, doc_id long, text_hash long, n long, hi long, lo long, shard int, flush long, data binary"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
_SCHEMA = pa.schema([(n, _KINDS[t]) for n, t in (f.split() for f in STAGED.split(", "))])
DOCUMENT, LENGTHS, FLUSHED, TOLD, STANDS = range(5)  # kinds of staged rows


def _rows(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in _SCHEMA], schema=_SCHEMA)


def _digests(offsets: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = sets.astype("<u8").tobytes()
    d = b"".join(xxhash.xxh3_128_digest(data[8 * a : 8 * z]) for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist()))
    both = np.frombuffer(d, "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _bitmaps(offsets: np.ndarray, sets: np.ndarray) -> pa.Array:
    """Parities of a row's hashes in at least as many bits as it has elements, a power of two: two
    sets differ in no fewer elements than their bitmaps in bits."""
    h, out = mix(sets), []
    for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        k = max(LEAST_BITS, (max(1, z - a) - 1).bit_length())
        odd = np.bincount((h[a:z] >> np.uint64(64 - k)).astype(np.int64), minlength=1 << k) & 1
        out.append(np.packbits(odd.astype(bool)).tobytes())
    return pa.array(out, pa.binary())


def _folded(bitmaps: np.ndarray) -> np.ndarray:
    """Rows of words at half the bits: neighbouring bits are added up."""
    bits = np.unpackbits(bitmaps.view(np.uint8), axis=-1)
    return np.packbits(bits[..., 0::2] ^ bits[..., 1::2], axis=-1).view("<u8")


def _bound(na, nb, percent: int):
    """In how many elements linked sets of these sizes differ at most."""
    return na + nb - 2 * (-(-percent * (na + nb) // (100 + percent)))


def _apart(x: bytes, y: bytes) -> int:
    """In how many bits two bitmaps differ; the larger is folded."""
    a, b = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
    while len(a) != len(b):
        a, b = (_folded(a), b) if len(a) > len(b) else (a, _folded(b))
    return int(np.bitwise_count(a ^ b).sum())


class _Bitmaps:
    """Bitmaps of a cell, to be compared with one of them at a time."""

    def __init__(self, bitmaps: list[bytes]):
        self.bitmaps, sizes = bitmaps, np.fromiter(map(len, bitmaps), np.int64, len(bitmaps))
        self.groups = {}
        for n in np.unique(sizes).tolist():
            mine = np.flatnonzero(sizes == n)
            rows = np.frombuffer(b"".join([bitmaps[i] for i in mine]), "<u8").reshape(len(mine), -1)
            self.groups[n] = (mine, rows, _folded(rows) if n > 8 << LEAST_BITS - 6 else rows)

    def differ(self, k: int) -> np.ndarray:
        """Lower bounds of what each differs in from the k-th; where sizes are too far apart to be linked, many."""
        own = np.frombuffer(self.bitmaps[k], "<u8")
        out, n = np.full(len(self.bitmaps), 1 << 40, np.int64), len(self.bitmaps[k])
        for size, (mine, rows, half) in self.groups.items():
            if size == n:
                out[mine] = np.bitwise_count(rows ^ own).sum(-1)
            elif size == 2 * n:
                out[mine] = np.bitwise_count(half ^ own).sum(-1)
            elif 2 * size == n:
                out[mine] = np.bitwise_count(rows ^ _folded(own)).sum(-1)
        return out


class _Flush:
    """Shingles of some documents of a task: by hash, each with the rows that hold it."""

    def __init__(self, first: int):
        self.first, self.rows, self.hashes, self.owners, self.sizes, self.pairs = first, 0, [], [], [], 0

    def add(self, sets: np.ndarray, owner: np.ndarray, sizes: np.ndarray) -> None:
        self.hashes.append(sets)
        self.owners.append((self.rows + owner).astype(np.int32))
        self.sizes.append(sizes)
        self.rows += len(sizes)
        self.pairs += len(sets)

    def out(self, shards: int, bits: int):
        """Of each range of hashes, cut to so many bits, the distinct ones with their counts, and for this flush's own use the
        rows that hold them, in the same order."""
        h, owner = np.concatenate(self.hashes) >> np.uint64(64 - bits), np.concatenate(self.owners)
        order = np.argsort(h, kind="stable")
        h, owner = h[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.array([], np.int64)
        times = np.diff(np.append(first, len(h))).astype(np.uint32)
        distinct = h[first]
        shard = part_of(distinct << np.uint64(64 - bits), shards)
        at = np.searchsorted(shard, np.arange(shards + 1))
        used = np.flatnonzero(np.diff(at))
        data = [_planes(np.diff(distinct[at[p] : at[p + 1]], prepend=np.uint64(0)), times[at[p] : at[p + 1]]) for p in used.tolist()]
        yield _rows(kind=pa.array([LENGTHS] * len(used)), shard=pa.array(used), flush=pa.array([self.first] * len(used)), data=pa.array(data, pa.binary()))
        own = _planes(times, owner, np.concatenate(self.sizes).astype(np.int64), np.stack([used, at[used]]).reshape(-1))
        yield _rows(kind=pa.array([FLUSHED]), flush=pa.array([self.first]), data=pa.array([own], pa.binary()))


def _stage(width: int, shards: int, bits: int):
    def run(batches):
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 40
        held, seen = _Flush(uid), set()
        for batch in batches:
            for b in slices(batch, 1, 2_000_000):
                offsets, sets = shingle_sets(b.column(1), width)
                hi, lo = _digests(offsets, sets)
                n, own = np.diff(offsets), uid + np.arange(b.num_rows)
                yield _rows(kind=pa.array([DOCUMENT] * b.num_rows), uid=pa.array(own), doc_id=b.column(0), text_hash=b.column(2), n=pa.array(n), hi=pa.array(hi), lo=pa.array(lo), flush=pa.array([held.first] * b.num_rows), data=_bitmaps(offsets, sets))
                if len(seen) > 200_000:
                    seen.clear()
                fresh = np.zeros(b.num_rows, bool)  # a set that this task has met before adds nothing
                for r, d in enumerate(lo.tolist()):
                    if n[r] and (d, hi[r]) not in seen:
                        seen.add((d, hi[r]))
                        fresh[r] = True
                row = np.repeat(np.arange(b.num_rows), n)
                held.add(sets[fresh[row]], row[fresh[row]], n)
                uid += b.num_rows
                if held.pairs > FLUSH:
                    yield from held.out(shards, bits)
                    held = _Flush(uid)
        if held.pairs:
            yield from held.out(shards, bits)

    return run


def _by_shard(batches, column: str, *more: str):
    """(shard, rows of `more`) of batches sorted by a column."""
    at, rows = None, []
    for b in batches:
        for shard, *row in zip(*(b.column(c).to_pylist() for c in (column, *more))):
            if at is not None and shard != at:
                yield at, rows
                rows = []
            at = shard
            rows.append(row)
    if rows:
        yield at, rows


def _lengths(batches):
    """Of blobs sorted by shard: tells every flush which of its shingles stand in two sets or more, and in how many."""
    for shard, blobs in _by_shard(batches, "shard", "flush", "data"):
        flushes, parts, times = [f for f, _ in blobs], [], []
        for _, data in blobs:
            h, t = _columns(data, "<u8", "<u4")
            parts.append(np.cumsum(h, dtype=np.uint64))
            times.append(t)
        sizes = np.array([len(x) for x in parts])
        h, t = np.concatenate(parts), np.concatenate(times)
        del parts, times
        order = np.argsort(h, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
        lengths = np.empty(len(h), np.int64)
        lengths[order] = np.repeat(np.add.reduceat(t[order].astype(np.int64), first), np.diff(np.append(first, len(h))))
        del order, t
        for f, a, z in zip(flushes, np.cumsum(sizes) - sizes, np.cumsum(sizes)):
            some = np.flatnonzero(lengths[a:z] > 1)
            if len(some):
                yield _rows(kind=pa.array([TOLD]), shard=pa.array([shard]), flush=pa.array([f]), data=pa.array([_planes(np.diff(some.astype(np.uint32), prepend=np.uint32(0)), np.diff(h[a:z][some], prepend=np.uint64(0)), lengths[a:z][some])], pa.binary()))


SHORT = "hash long, uid long, times long"


def _short_lists(percent: int):
    """Of rows sorted by flush and kind: (hash, uid) of the shortest lists of each class's set, without those of one, and
    how many of them the class stands in."""

    def run(batches):
        for first, rows in _by_shard(batches, "flush", "kind", "shard", "uid", "data"):
            own = next(data for kind, _, _, data in rows if kind == FLUSHED)
            times, owner, sizes, place = _columns(own, "<u4", "<i4", "<i8", "<i8")
            base = dict(place.reshape(2, -1).T.tolist())
            stands = np.zeros(len(sizes), bool)
            stands[[uid - first for kind, _, uid, _ in rows if kind == STANDS]] = True
            told = [(base[shard], _columns(data, "<u4", "<u8", "<i8")) for kind, shard, _, data in rows if kind == TOLD]
            if not told:
                continue
            which = np.concatenate([b + np.cumsum(c[0], dtype=np.int64) for b, c in told])
            h, length = np.concatenate([np.cumsum(c[1], dtype=np.uint64) for _, c in told]), np.concatenate([c[2] for _, c in told])
            ends = np.cumsum(times, dtype=np.int64)
            many = times[which].astype(np.int64)
            at = np.arange(many.sum()) + np.repeat(ends[which] - times[which] - np.cumsum(many) + many, many)
            row, which = owner[at], np.repeat(np.arange(len(h)), many)
            keep = stands[row]
            row, which = row[keep], which[keep]
            order = np.lexsort((h[which], length[which], row))
            row, which = row[order], which[order]
            shared = np.bincount(row, minlength=len(sizes))
            rank = np.arange(len(row)) - (np.cumsum(shared) - shared)[row]
            short = sizes - -(-percent * sizes // 100) + 1 - (sizes - shared)  # lists of one are the shortest
            keep = rank < short[row]
            row, which = row[keep], which[keep]
            out = np.bincount(row, minlength=len(sizes))
            for a in range(0, len(row), 100_000):
                r, w = row[a : a + 100_000], which[a : a + 100_000]
                yield pa.RecordBatch.from_pydict({"hash": pa.array(h[w].view(np.int64)), "uid": pa.array(first + r.astype(np.int64)), "times": pa.array(out[r])})

    return run


class LongFile:
    """Longs in shards of sorted arrays in the shared folder, each perhaps with a value; mapped by workers."""

    def __init__(self, path: str, shards: int):
        self.path, self.shards = path, shards

    @classmethod
    def write(cls, df: DataFrame, shards: int) -> LongFile:
        """From df(key[, value]) with distinct keys."""
        path = local_path(shared_dir(df.sparkSession, "longs"))

        def save(batches):
            held: dict[int, list] = {}
            for b in batches:
                for p in np.unique(shard := b.column("shard").to_numpy()):
                    held.setdefault(int(p), []).append((b.column("key").to_numpy()[shard == p], b.column("value").to_numpy()[shard == p]))
            for p, parts in held.items():
                key, value = map(np.concatenate, zip(*parts))
                order = np.argsort(key, kind="stable")
                _save(f"{path}/{p}.npy", np.stack([key[order], value[order]]))
                yield pa.RecordBatch.from_pydict({"shard": pa.array([p], pa.int32())})

        value = F.col("value") if "value" in df.columns else F.lit(0)
        rows = df.where("key is not null").select(F.col("key").cast("long").alias("key"), value.cast("long").alias("value"), F.pmod("key", F.lit(shards)).cast("int").alias("shard"))
        rows.repartition(shards, "shard").mapInArrow(save, "shard int").count()
        return cls(path, shards)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each key is there, its value)."""
        known, values, shard = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64), keys % self.shards
        for p in np.unique(shard):
            if os.path.exists(f := f"{self.path}/{p}.npy"):
                table, mine = np.load(f, mmap_mode="r"), np.flatnonzero(shard == p)
                at = np.minimum(np.searchsorted(table[0], keys[mine]), table.shape[1] - 1)
                ok = table[0][at] == keys[mine]
                known[mine], values[mine] = ok, np.where(ok, table[1][at], 0)
        return known, values


class BitmapFile:
    """Sizes and bitmaps of classes by node, in shards in the shared folder; mapped by workers."""

    def __init__(self, path: str, shards: int):
        self.path, self.shards = path, shards

    @classmethod
    def write(cls, classes: DataFrame, shards: int) -> BitmapFile:
        path = local_path(shared_dir(classes.sparkSession, "bitmaps"))

        def save(batches):
            held: dict[int, list] = {}
            for b in batches:
                for node, n, bitmap, shard in zip(*(b.column(c).to_pylist() for c in ("node", "n", "bitmap", "shard"))):
                    held.setdefault(shard, []).append((node, n, bitmap))
            for p, rows in held.items():
                rows.sort()
                ends = np.cumsum([0, *(len(r[2]) for r in rows)])
                _save(f"{path}/{p}.index.npy", np.stack([np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), ends[:-1], ends[1:]]))
                _save(f"{path}/{p}.bits.npy", np.frombuffer(b"".join(r[2] for r in rows), np.uint8))
                yield pa.RecordBatch.from_pydict({"shard": pa.array([p], pa.int32())})

        rows = classes.select("node", "n", "bitmap", F.pmod("node", F.lit(shards)).cast("int").alias("shard"))
        rows.repartition(shards, "shard").mapInArrow(save, "shard int").count()
        return cls(path, shards)

    def find(self, nodes: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """(sizes, bitmaps) of known nodes."""
        sizes, out = np.zeros(len(nodes), np.int64), [b""] * len(nodes)
        shard = nodes % self.shards
        for p in np.unique(shard).tolist():
            index, bits = (np.load(f"{self.path}/{p}.{x}.npy", mmap_mode="r") for x in ("index", "bits"))
            mine = np.flatnonzero(shard == p)
            at = np.searchsorted(index[0], nodes[mine])
            sizes[mine] = index[1][at]
            for i, a, z in zip(mine.tolist(), index[2][at].tolist(), index[3][at].tolist()):
                out[i] = bits[a:z].tobytes()
        return sizes, out


class Lists:
    """The inverted index of some sets: for each element the sets that hold it, in order, as one sorted array."""

    def __init__(self, sets: list[np.ndarray]):
        self.many = max(1, len(sets))
        flat = np.concatenate(sets) if sets else np.array([], np.uint64)
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        order = np.argsort(flat, kind="stable")
        flat, self.owner = flat[order], owner[order]
        self.first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.array([], np.int64)
        self.elements = flat[self.first]
        self.ends = np.append(self.first[1:], len(flat))
        self.places = np.repeat(np.arange(len(self.first)), self.ends - self.first) * self.many + self.owner  # (list, set) in order

    def divide_skip(self, query: np.ndarray, need: list[int]) -> list[int]:
        """Which sets share at least as many elements with the query as each needs."""
        least = np.array(need, np.int64)
        found = np.flatnonzero(least <= 0).tolist()
        if len(found) == len(least):
            return found
        at = np.minimum(np.searchsorted(self.elements, query), max(len(self.elements) - 1, 0))
        lists = at[self.elements[at] == query] if len(self.elements) else at[:0]
        lists = lists[np.argsort(self.first[lists] - self.ends[lists], kind="stable")]  # the longest first
        size = (self.ends - self.first)[lists]
        apart = min(int(least[least > 0].min()) - 1, int((size * 4 > self.many).sum()))  # long lists, fewer than T of them
        longs, shorts = lists[:apart], lists[apart:]
        heap = heapq.merge(*(self.owner[a:z].tolist() for a, z in zip(self.first[shorts].tolist(), self.ends[shorts].tolist())))
        met = [(c, sum(1 for _ in times)) for c, times in groupby(heap)]
        met = [(c, n) for c, n in met if n + apart >= least[c] > 0]
        if not met:
            return found
        c, n = np.array(met).T
        for lo in range(0, apart, 64):  # those that can't reach T any more are left out
            probed = longs[lo : lo + 64][:, None] * self.many + c
            i = np.minimum(np.searchsorted(self.places, probed), len(self.places) - 1)
            n = n + (self.places[i] == probed).sum(0)
            may = n + max(0, apart - lo - 64) >= least[c]
            c, n = c[may], n[may]
        return found + c[n >= least[c]].tolist()


def divide_skip(query: np.ndarray, candidates: list[np.ndarray], need: list[int]) -> list[int]:
    """Which candidates (sorted sets) share at least as many elements with the query as each needs."""
    return Lists(candidates).divide_skip(query, need)


TESTED = "a long, b long, na long, nb long, linked boolean, apart binary"


def _search(percent: int):
    """Rows (a, b, sa, sb), those of one a together, with whether they are linked and what they differ in."""

    def run(batches):
        for batch in batches:
            a, sa, start, out = batch.column("a").to_pylist(), batch.column("sa"), 0, []
            b = batch.column("b").to_pylist()
            for _, rows in groupby(a):
                n = sum(1 for _ in rows)
                query = np.frombuffer(sa[start].as_py(), "<u8")
                sets = [np.frombuffer(x, "<u8") for x in batch.column("sb").slice(start, n).to_pylist()]
                linked = set(divide_skip(query, sets, [required(len(query), len(x), percent) for x in sets]))
                out += [(a[start], b[start + i], len(query), len(x), i in linked, np.setxor1d(query, x, True).tobytes()) for i, x in enumerate(sets)]
                start += n
            c = list(zip(*out)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, kinds)], names=[f.split()[0] for f in TESTED.split(", ")])

    return run


def _split(percent: int, maps: BitmapFile):
    """Pairs (a, b) with the size of b and whether the bitmaps of both allow a link."""

    def run(batches):
        for t in batches:
            a, b = t.column("a").to_numpy(), t.column("b").to_numpy()
            nodes, back = np.unique(np.concatenate([a, b]), return_inverse=True)
            sizes, bitmaps = maps.find(nodes)
            x, y = back[: len(a)], back[len(a) :]
            apart = np.fromiter((_apart(bitmaps[i], bitmaps[j]) for i, j in zip(x.tolist(), y.tolist())), np.int64, len(a))
            may = apart <= _bound(sizes[x], sizes[y], percent)
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b"), pa.array(sizes[y]), pa.array(may)], names=["a", "b", "nb", "may"])

    return run


def _search_apart(percent: int, maps: BitmapFile):
    """One cell of those that share blocks with the same class: searches its rows of other
    components (`asks`) among all of the cell. Where bitmaps allow a link, it is decided by what
    both differ in from that class, or, where that isn't known, left to a search by sets (not `sure`).
    Gives links that join components, no more than it takes to join them."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["b", "nb", "comp", "asks", "apart"]).to_pylist(), key=lambda r: (r["b"], not r["asks"]))
        top: dict[int, int] = {}

        def find(x: int) -> int:
            while top.get(x, x) != x:
                top[x] = x = top.get(top[x], top[x])
            return x

        sets = [None if r["apart"] is None else np.frombuffer(r["apart"], "<u8") for r in rows]
        bitmaps, sizes, comps = _Bitmaps(maps.find(np.array([r["b"] for r in rows], np.int64))[1]), np.array([r["nb"] for r in rows], np.int64), np.array([r["comp"] for r in rows], np.int64)
        left, right, sure = [], [], []
        for k, r in enumerate(rows):
            if not r["asks"]:
                continue
            near = (sizes * 100 >= r["nb"] * percent) & (r["nb"] * 100 >= sizes * percent) & (comps != r["comp"])
            near = np.flatnonzero(near & (bitmaps.differ(k) <= _bound(sizes, r["nb"], percent))).tolist() if near.any() else []
            own = find(r["comp"])
            near = [j for j in near if find(rows[j]["comp"]) != own]
            some = [j for j in near if sets[j] is not None and sets[k] is not None]
            need = [required(r["nb"], rows[j]["nb"], percent) + (len(sets[k]) + len(sets[j]) - r["nb"] - rows[j]["nb"]) // 2 for j in some]
            for i in divide_skip(sets[k], [sets[j] for j in some], need) if some else ():
                x, y = find(r["comp"]), find(rows[some[i]]["comp"])
                if x != y:
                    top[max(x, y)] = min(x, y)
                    left.append(r["b"])
                    right.append(rows[some[i]]["b"])
                    sure.append(True)
            for j in near:
                if (sets[j] is None or sets[k] is None) and find(rows[j]["comp"]) != find(r["comp"]):
                    left.append(min(r["b"], rows[j]["b"]))
                    right.append(max(r["b"], rows[j]["b"]))
                    sure.append(False)
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64()), "sure": pa.array(sure, pa.bool_())})

    return run


def _sets(width: int, ids: LongFile, nulls: bool):
    """Sets of those rows whose doc_id is among `ids` (or null, where that is asked for)."""

    def run(batches):
        for batch in batches:
            doc_id = batch.column(0)
            null = doc_id.is_null().to_numpy(zero_copy_only=False)
            wanted = ids.find(doc_id.fill_null(0).to_numpy(zero_copy_only=False))[0] & ~null | null & nulls
            some = batch.filter(pa.array(wanted))
            for b in slices(some, 1, 2_000_000):
                offsets, sets = shingle_sets(b.column(1), width)
                hi, lo = _digests(offsets, sets)
                data = sets.astype("<u8").tobytes()
                yield pa.RecordBatch.from_pydict({"hi": pa.array(hi), "lo": pa.array(lo), "shingles": pa.array([data[8 * x : 8 * z] for x, z in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.binary())})

    return run


def _kept(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _tested(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """pairs(a, b) of classes, each with whether it is linked and what its sets differ in."""
    needed = _kept(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes, "node"), "join-needed")
    shards = shards_of(docs)
    ids = LongFile.write(needed.select(F.col("doc_id").alias("key")).distinct(), shards)
    nulls = needed.where("doc_id is null").limit(1).count() > 0
    sets = docs.select("doc_id", "text").mapInArrow(lean(_sets(width, ids, nulls)), "hi long, lo long, shingles binary")
    sets = _kept(sets.join(needed, ["hi", "lo"]).groupBy("node").agg(F.first("shingles").alias("shingles")), "join-sets")
    full = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    return _kept(full.select("a", "b", "sa", "sb").sortWithinPartitions("a").mapInArrow(lean(_search(percent)), TESTED), "join-tested")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the least node that each node of edges(a, b) is joined with, by alternating
    large and small stars; every round is written out."""
    now = edges.where("a <> b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct()
    while True:
        both = _kept(now.union(now.select(F.col("u").alias("v"), F.col("v").alias("u"))), "join-edges")
        # least neighbours are written, so that the joins are split where a node has many
        least = _kept(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "join-least")
        large = _kept(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "join-large")
        least = _kept(large.groupBy("u").agg(F.min("v").alias("m")), "join-least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v")))
        after = _kept(small.select("v", "u").distinct(), "join-stars")
        if not after.join(after.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count() and not after.groupBy("u").count().where("count > 1").limit(1).count():
            roots = after.select(F.col("v").alias("node")).distinct()
            return after.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(roots.select("node", F.col("node").alias("comp")))
        now = after


def _bits(docs: DataFrame) -> int:
    """So many bits of a hash that one in 2^SPARE meets another by chance, at most; that makes a list longer and no link wrong."""
    return min(64, max(32, input_bytes(docs).bit_length() + SPARE))


def short_lists(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, classes, short lists) of docs(doc_id, text)."""
    spark, shards = docs.sparkSession, shards_of(docs)
    staged = shared_dir(spark, "join-staged")
    cut = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(lean(_stage(width, shards, _bits(docs))), STAGED)
    cut.write.partitionBy("kind").parquet(staged)
    read = spark.read.schema(STAGED).parquet(staged)
    rows = read.where(F.col("kind") == DOCUMENT).select("uid", "doc_id", "text_hash", "n", "hi", "lo", "flush", F.col("data").alias("bitmap"))
    one = F.min_by(F.struct("doc_id", "n", "flush", "bitmap"), "uid").alias("of")
    classes = _kept(rows.where("n > 0").groupBy("hi", "lo").agg(F.min("uid").alias("node"), one).select("hi", "lo", "node", "of.*"), "join-classes")
    lengths = read.where(F.col("kind") == LENGTHS).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "flush").mapInArrow(lean(_lengths), STAGED)
    own = read.where(F.col("kind") == FLUSHED).select(*_SCHEMA.names)
    stands = classes.select(*(F.lit(STANDS).alias(c) if c == "kind" else F.col("node").alias(c) if c == "uid" else F.col(c) if c == "flush" else F.lit(None).cast(t).alias(c) for c, t in (f.split() for f in STAGED.split(", "))))
    told = own.unionByName(lengths).unionByName(stands).repartition(shards, "flush").sortWithinPartitions("flush", "kind")
    return rows, classes, _kept(told.mapInArrow(lean(_short_lists(percent)), SHORT), "join-lists")


def similar_documents(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, text_hash, uid, n_shingles, component_id, first_uid) of docs(doc_id, text)."""
    if not 50 <= percent <= 100:
        raise ValueError(f"{percent}: a similarity of 50 to 100 percent is needed")
    spark = docs.sparkSession
    ship_package(spark)
    shards = shards_of(docs)
    rows, classes, lists = short_lists(docs, width, percent)
    # the class of most short lists is the likeliest to be what the others were made from
    centres = lists.groupBy("hash").agg(F.max(F.struct("times", (-F.col("uid")).alias("uid"))).alias("top"), F.count("*").alias("all")).where("all > 1")
    centres = _kept(centres.select("hash", (-F.col("top.uid")).alias("a")), "join-centres")
    stars = _kept(lists.join(centres, "hash").where("a <> uid").select("a", F.col("uid").alias("b")).distinct(), "join-pairs")
    identity = classes.select("hi", "lo", "node", "doc_id")
    maps = BitmapFile.write(classes, shards)
    judged = _kept(stars.mapInArrow(lean(_split(percent, maps)), "a long, b long, nb long, may boolean"), "join-judged")
    tested = _tested(judged.where("may").select("a", "b"), identity, docs, width, percent)
    links = tested.where("linked").select("a", "b")
    comps = components(links)
    comp_of = lambda c: comps.select(F.col("node").alias(c), F.col("comp").alias(f"comp_{c}"))
    at = judged.join(tested.select("a", "b", "apart"), ["a", "b"], "left").join(comp_of("a"), "a", "left").join(comp_of("b"), "b", "left")
    at = at.withColumns({"home": F.coalesce("comp_a", "a"), "comp": F.coalesce("comp_b", "b")})
    at = _kept(at.select("a", "b", "nb", "apart", "comp", (F.col("comp") != F.col("home")).alias("asks")), "join-mixed")
    size = F.coalesce(F.length("apart"), F.lit(0)) + F.lit(320)
    cells = at.groupBy("a").agg(
        F.ceil(F.greatest(F.count_if("asks") / CELL, F.sum(F.when(F.col("asks"), size).otherwise(0)) / CELL_BYTES)).cast("int").alias("asking"),
        F.ceil(F.greatest(F.count("*") / (4 * CELL), F.sum(size) / CELL_BYTES)).cast("int").alias("asked"),
        F.count("*").alias("all"),
    ).where("asking > 0 and all > 1")
    placed = at.join(cells, "a")
    i, j = F.pmod(F.hash("b"), F.col("asking")), F.pmod(F.hash("b"), F.col("asked"))
    ask = placed.where("asks").select("a", i.alias("i"), F.explode(F.sequence(F.lit(0), F.col("asked") - 1)).alias("j"), "b", "nb", "comp", "asks", "apart")
    told = placed.select("a", F.explode(F.sequence(F.lit(0), F.col("asking") - 1)).alias("i"), j.alias("j"), "b", "nb", "comp", F.lit(False).alias("asks"), "apart")
    more = ask.unionByName(told).groupBy("a", "i", "j").applyInArrow(_search_apart(percent, maps), "a long, b long, sure boolean")
    more = _kept(more.distinct(), "join-found")
    last = _tested(more.where("not sure").select("a", "b"), identity, docs, width, percent).where("linked").select("a", "b")
    comps = _kept(components(_kept(links.union(more.where("sure").select("a", "b")).union(last), "join-links")), "join-components")
    of_class = classes.join(comps, "node", "left").select("hi", "lo", F.coalesce("comp", "node").alias("comp"))
    joined = _kept(rows.where("n > 0").join(of_class, ["hi", "lo"]).select("uid", "doc_id", "text_hash", "n", "comp"), "join-rows")
    # written, so that the join below is split where a component is large
    least = _kept(joined.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).getField("uid").alias("first_uid")), "join-least")
    out = joined.join(least, "comp").select("doc_id", "text_hash", "uid", F.col("n").alias("n_shingles"), "component_id", "first_uid")
    return out.unionByName(rows.where("n = 0").select("doc_id", "text_hash", "uid", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("uid").alias("first_uid")))


def first_of_each(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """docs with one document of each component, that of the least doc_id; of its repeated rows one
    stays. Documents without words all stay. Rows are told apart by doc_id and text, so one id may have several
    texts; columns of any name stay."""
    found = _kept(similar_documents(docs, width, percent), "join-found")
    own = _unlike(docs.columns, 4)
    stays = found.groupBy(F.col("doc_id").alias(own[0]), F.col("text_hash").alias(own[1])).agg(F.max((F.col("uid") == F.col("first_uid")) | (F.col("n_shingles") == 0)).alias(own[2]), F.count_if(F.col("n_shingles") > 0).alias(own[3]))
    same = docs["doc_id"].eqNullSafe(F.col(own[0])) & (F.xxhash64(docs["text"]) == F.col(own[1]))
    joined = docs.join(stays.where(F.col(own[2])), same)
    twice = joined.where(F.col(own[3]) > 1).select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return joined.where(F.col(own[3]) <= 1).select(*docs.columns).unionByName(twice)


def _unlike(columns: list[str], many: int) -> list[str]:
    """Names that no column has."""
    taken = {c.lower() for c in columns}
    return [n for n in (f"_join_{k}" for k in range(len(columns) + many)) if n not in taken][:many]


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return similar_documents(docs, width=3, percent=90).select("doc_id", "n_shingles", "component_id")
