"""Interpolated modified Kneser-Ney bigram model, counted in Spark and scored from mapped files.

Counting moves packed blobs of sorted keys, not a row for each n-gram: a task adds up what it
has read, cuts the sums by shard, and a reducer merges the sorted runs of a shard and writes
them as sorted arrays to the shared folder. Words are 64-bit hashes in shards of equal
hash ranges, and a word's id is its rank over all shards; a bigram is two ids in 64 bits.
Bigrams lie in the shard of their first word, but for the few words so frequent that their
bigrams are dealt out singly. Workers map the arrays and look up batches of sorted keys.

p(w|v) = max(c(v,w)-D(c),0)/c(v) + g(v) p(w);  p(w) = max(n(w)-D'(n),0)/N + g' /(V+1), where n(w)
counts the distinct words before w and an unknown word has only the last term. A document is
opened by a start context and closed by an end token.

Nulls: a null text is empty (its end is still scored); a null doc_id counts as the empty text
in the split into training and held-out rows. Repeated rows count each. A very long text is counted and scored
whole, in one batch of one worker. Only doc_id and text are read, so other columns can't clash; an empty table
has no scores. The order is 2 and no parameter: keys are two ids in 64 bits. Without training rows
every score is that of the uniform distribution over one unknown word, 0.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.llm.tokens import lean, slices
from logsift.llm.words import hashes, mix, part_of, shards_of, split_words
from logsift.session import local_path, shared_dir, ship_package

END = 0x2545F4914F6CDD1D  # the end token's place among the hashes of words
FLUSH = 3_000_000  # counted tokens that a task holds at most
LOOK = 4_000_000  # characters scored at once


def _save(path: str, array: np.ndarray) -> None:
    """Whole or not at all, whatever becomes of the task; a repeated task writes the same."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        np.save(f, array)
    os.replace(part, path)


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences, by byte planes, and counts."""
    planes = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    small = counts.astype("<u1") if not len(counts) or counts.max() < 256 else counts.astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(len(keys).to_bytes(8, "little") + planes + small.tobytes())


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(raw[:8], "little")
    keys = np.frombuffer(raw, np.uint8, 8 * n, 8).reshape(8, n).T.copy().view("<u8").reshape(n)
    rest = raw[8 + 8 * n :]
    return np.cumsum(keys, dtype=np.uint64), np.frombuffer(rest, "<u1" if len(rest) == n else "<u8").astype(np.int64)


def _merge(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = zip(*map(_unpack, blobs))
    return _sums(np.concatenate(keys), np.concatenate(counts))


def _sums(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of each one's counts."""
    if not len(keys):
        return keys.astype(np.uint64), np.array([], np.int64)
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.diff(np.append(at, len(keys))) if counts is None else np.add.reduceat(counts, at)


def _blobs(keys: np.ndarray, counts: np.ndarray, shards: np.ndarray, kind: int = 0):
    order = np.argsort(shards, kind="stable")
    keys, counts, shards = keys[order], counts[order], shards[order]
    used, at = np.unique(shards, return_index=True)
    data = [_pack(keys[a:z], counts[a:z]) for a, z in zip(at, [*at[1:], len(keys)])]
    return pa.RecordBatch.from_pydict({"kind": pa.array([kind] * len(used), pa.int32()), "shard": pa.array(used, pa.int32()), "data": pa.array(data, pa.binary())})


BLOB = "kind int, shard int, data binary"


class _Vocabulary:
    """The shards of words, mapped; ids are -1 for unknown words."""

    def __init__(self, path: str, sizes: list[int]):
        self.parts = len(sizes)
        self.base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.words = [np.load(f"{path}/words/{p}.npy", mmap_mode="r") if n else np.array([], np.uint64) for p, n in enumerate(sizes)]
        self.counts = [np.load(f"{path}/counts/{p}.npy", mmap_mode="r") if n else np.array([], np.int64) for p, n in enumerate(sizes)]

    def find(self, h: np.ndarray) -> np.ndarray:
        ids, shards = np.full(len(h), -1, np.int64), part_of(h, self.parts)
        for p in np.unique(shards):
            if len(self.words[p]):
                mine = np.flatnonzero(shards == p)
                at = np.searchsorted(self.words[p], h[mine])
                ok = self.words[p][np.minimum(at, len(self.words[p]) - 1)] == h[mine]
                ids[mine[ok]] = self.base[p] + at[ok]
        return ids

    def gather(self, arrays: list, ids: np.ndarray, missing=0) -> np.ndarray:
        """Values of per-word arrays at known ids."""
        out = np.full(len(ids), missing, np.float64 if isinstance(missing, float) else np.int64)
        shards = np.searchsorted(self.base, ids, "right") - 1
        for p in np.unique(shards[ids >= 0]):
            mine = np.flatnonzero((shards == p) & (ids >= 0))
            out[mine] = arrays[p][ids[mine] - self.base[p]]
        return out


def _count_words(shards: int):
    def run(batches):
        kept, size = [], 0
        for batch in batches:
            for b in slices(batch, 0, LOOK):
                _, codes, words = split_words(b.column(0))
                counts = np.bincount(codes, minlength=len(words))
                full = counts > 0
                kept.append((np.append(hashes(words)[full], np.uint64(END)), np.append(counts[full], b.num_rows)))
                size += len(kept[-1][0])
                if size > FLUSH:
                    keys, n = _sums(*map(np.concatenate, zip(*kept)))
                    yield _blobs(keys, n, part_of(keys, shards))
                    kept, size = [], 0
        if kept:
            keys, n = _sums(*map(np.concatenate, zip(*kept)))
            yield _blobs(keys, n, part_of(keys, shards))

    return run


def _by_shard(batches):
    """(kind, shard, all its blobs), for rows sorted by both."""
    at, blobs = None, []
    for b in batches:
        for kind, shard, data in zip(*(b.column(c).to_pylist() for c in ("kind", "shard", "data"))):
            if at != (kind, shard):
                if at:
                    yield *at, blobs
                at, blobs = (kind, shard), []
            blobs.append(data)
    if at:
        yield *at, blobs


def _dealt(blobs: DataFrame, shards: int) -> DataFrame:
    return blobs.repartition(shards, "kind", "shard").sortWithinPartitions("kind", "shard")


def _write_words(path: str):
    def run(batches):
        for _, shard, blobs in _by_shard(batches):
            keys, counts = _merge(blobs)
            _save(f"{path}/words/{shard}.npy", keys)
            _save(f"{path}/counts/{shard}.npy", counts)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n": [len(keys)], "total": [int(counts.sum())]})

    return run


def _pairs(ids: np.ndarray, codes: np.ndarray, offsets: np.ndarray, end: int, start: int) -> tuple[np.ndarray, np.ndarray]:
    """(first ids, second ids) of all bigrams of the rows, each closed by `end`, in order."""
    rows = len(offsets) - 1
    new = offsets + np.arange(rows + 1)
    second = np.empty(new[-1], np.int64)
    word = np.ones(new[-1], bool)
    word[new[1:] - 1] = False
    second[word], second[~word] = ids[codes], end
    first = np.empty_like(second)
    first[1:] = second[:-1]
    first[new[:-1]] = start
    return first, second


def _shard_of(first: np.ndarray, second: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    key = np.where(np.isin(first, hot), first * 0x10001 + second * 0x9E3779B1 + 7, first)
    return part_of(mix(key), shards)


def _count_pairs(path: str, sizes: list[int], hot: np.ndarray, shards: int):
    def run(batches):
        vocabulary = _Vocabulary(path, sizes)
        end, start = int(vocabulary.find(np.array([END], np.uint64))[0]), int(vocabulary.base[-1])
        kept, size = [], 0

        def flush():
            keys, n = _sums(np.concatenate(kept))
            return _blobs(keys, n, _shard_of((keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64), hot, shards))

        for batch in batches:
            for b in slices(batch, 0, LOOK):
                offsets, codes, words = split_words(b.column(0))
                first, second = _pairs(vocabulary.find(hashes(words)), codes, offsets, end, start)
                kept.append(first.astype(np.uint64) << np.uint64(32) | second.astype(np.uint64))
                size += len(first)
                if size > FLUSH:
                    yield flush()
                    kept, size = [], 0
        if kept:
            yield flush()

    return run


def _tally(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def _contexts(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted ids: the distinct ones, and rows (sum, how many of count 1, 2, 3 and more)."""
    at = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.array([], np.int64)
    if not len(at):
        return ids, np.empty((0, 4), np.int64)
    return ids[at], np.stack([np.add.reduceat(x, at) for x in (counts, (counts == 1).astype(np.int64), (counts == 2).astype(np.int64), (counts > 2).astype(np.int64))], 1)


PAIR_SUMS = "kind int, shard int, data binary, id long, total long, n1 long, n2 long, n3 long, n4 long"


def _write_pairs(path: str, base: np.ndarray, hot: np.ndarray):
    """Writes a shard's bigrams and contexts. Gives on: its count of counts (kind 0), the
    contexts that are in several shards (kind 1), and how many words stand before each
    word here (kind 2, packed by the word's shard)."""

    def run(batches):
        kinds = [f.split() for f in PAIR_SUMS.split(", ")]
        schema = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in kinds])
        for _, shard, blobs in _by_shard(batches):
            keys, counts = _merge(blobs)
            first, second = (keys >> np.uint64(32)).astype(np.int64), keys & np.uint64(0xFFFFFFFF)
            _save(f"{path}/pairs/{shard}.npy", keys)
            _save(f"{path}/pair_counts/{shard}.npy", counts.astype(np.uint32) if not len(counts) or counts.max() < 1 << 32 else counts)
            ids, stats = _contexts(first, counts)
            many = np.isin(ids, hot)
            _save(f"{path}/contexts/{shard}.npy", ids[~many])
            _save(f"{path}/context_sums/{shard}.npy", stats[~many])
            rows = [(0, shard, None, len(keys), int(counts.sum()), *_tally(counts))]
            rows += [(1, shard, None, int(i), *map(int, s), 0) for i, s in zip(ids[many], stats[many])]
            seconds, n = _sums(second)
            owner = np.searchsorted(base, seconds.astype(np.int64), "right") - 1
            for blob in _blobs(seconds, n, owner).to_pylist():
                rows.append((2, blob["shard"], blob["data"], 0, 0, 0, 0, 0, 0))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _write_before(path: str, base: np.ndarray):
    def run(batches):
        for _, shard, blobs in _by_shard(batches):
            keys, counts = _merge(blobs)
            out = np.zeros(base[shard + 1] - base[shard], np.int64)
            out[keys.astype(np.int64) - base[shard]] = counts
            _save(f"{path}/before/{shard}.npy", out)
            t = _tally(out)
            yield pa.RecordBatch.from_pydict({"n1": [t[0]], "n2": [t[1]], "n3": [t[2]], "n4": [t[3]], "total": [int(out.sum())], "more": [int((out > 2).sum())]})

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Of counts 0, 1, 2, 3 and more; fixed ones where a count of counts is 0."""
    if min(n1, n2, n3, n4) == 0:
        return [0.0, 0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    d = [0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return d if all(0 <= x <= k for k, x in enumerate(d)) else [0.0, 0.5, 1.0, 1.5]


def train(docs: DataFrame, path: str | None = None) -> dict:
    """Counts docs(text), writes the model's arrays below `path` and returns what else it is."""
    spark = docs.sparkSession
    ship_package(spark)
    path = local_path(path or shared_dir(spark, "ngram-lm"))
    shards = shards_of(docs)
    docs = docs.select("text")
    counted = _dealt(docs.mapInArrow(lean(_count_words(shards)), BLOB), shards)
    got = {r.shard: r for r in counted.mapInArrow(lean(_write_words(path)), "shard int, n long, total long").collect()}
    sizes = [got[p].n if p in got else 0 for p in range(shards)]
    total, base = sum(r.total for r in got.values()), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    model = {"path": path, "sizes": sizes, "tokens": total, "words": int(base[-1]), "shards": shards}
    if not total:
        return model
    if base[-1] >= 1 << 32:
        raise ValueError("over 4 billion distinct words: raise the width of ids")
    hot = [int(base[-1])]  # the start context, and words with so many tokens that a shard of them would stand out
    for p, n in enumerate(sizes):
        if n:
            hot += (base[p] + np.flatnonzero(np.load(f"{path}/counts/{p}.npy", mmap_mode="r") > total / (4 * shards))).tolist()
    hot = np.array(hot, np.int64)  # at most 4 * shards + 1
    pairs = _dealt(docs.mapInArrow(lean(_count_pairs(path, sizes, hot, shards)), BLOB), shards)
    sums_path = shared_dir(spark, "ngram-sums")
    pairs.mapInArrow(lean(_write_pairs(path, base, hot)), PAIR_SUMS).write.partitionBy("kind").parquet(sums_path)
    sums = spark.read.schema(PAIR_SUMS).parquet(sums_path)
    n = sums.where("kind = 0").agg(*(F.sum(c).alias(c) for c in ("id", "n1", "n2", "n3", "n4"))).first()
    model["d"] = discounts(n.n1, n.n2, n.n3, n.n4)
    model["hot"] = {r.id: (r.total, r.n1, r.n2, r.n3) for r in sums.where("kind = 1").groupBy("id").agg(*(F.sum(c).alias(c) for c in ("total", "n1", "n2", "n3"))).collect()}
    before = _dealt(sums.where("kind = 2").select("kind", "shard", "data"), shards)
    b = before.mapInArrow(lean(_write_before(path, base)), "n1 long, n2 long, n3 long, n4 long, total long, more long").agg(*(F.sum(c).alias(c) for c in ("n1", "n2", "n3", "n4", "total", "more"))).first()
    model["d1"] = d = discounts(b.n1, b.n2, b.n3, b.n4)
    model["pairs"] = b.total
    model["left"] = (d[1] * b.n1 + d[2] * b.n2 + d[3] * b.more) / b.total
    return model


class Scorer:
    """Looks up batches in the mapped model."""

    def __init__(self, model: dict):
        self.m, path, shards = model, model["path"], range(model["shards"])
        self.vocabulary = v = _Vocabulary(path, model["sizes"])
        load = lambda what, p: np.load(f, mmap_mode="r") if os.path.exists(f := f"{path}/{what}/{p}.npy") else None
        self.before = [load("before", p) for p in shards]
        self.before = [x if x is not None else np.zeros(n, np.int64) for x, n in zip(self.before, model["sizes"])]
        self.pairs, self.pair_counts, self.contexts, self.sums = ([load(w, p) for p in shards] for w in ("pairs", "pair_counts", "contexts", "context_sums"))
        self.hot = np.array(sorted(model["hot"]), np.int64)
        self.hot_sums = np.array([model["hot"][i] for i in self.hot.tolist()], np.int64).reshape(-1, 4)
        self.end, self.start = int(v.find(np.array([END], np.uint64))[0]), int(v.base[-1])

    @staticmethod
    def _rows(arrays, values, shards: np.ndarray, keys: np.ndarray, out: np.ndarray) -> None:
        order = np.argsort(shards, kind="stable")
        used, at = np.unique(shards[order], return_index=True)
        for p, a, z in zip(used, at, [*at[1:], len(order)]):
            if arrays[p] is None or not len(arrays[p]):
                continue
            mine = order[a:z]
            found = np.searchsorted(arrays[p], keys[mine])
            found = np.minimum(found, len(arrays[p]) - 1)
            ok = arrays[p][found] == keys[mine]
            out[mine[ok]] = values[p][found[ok]]

    def probability(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """p(second|first) of ids; -1 is an unknown word."""
        m, d, d1, shards = self.m, np.array(self.m["d"]), np.array(self.m["d1"]), self.m["shards"]
        ids, back = np.unique(second, return_inverse=True)
        n = self.vocabulary.gather(self.before, ids)
        uni = ((np.maximum(n - d1[np.minimum(n, 3)], 0) / m["pairs"]) + m["left"] / (m["words"] + 1))[back]
        ids, back = np.unique(first, return_inverse=True)
        sums = np.zeros((len(ids), 4), np.int64)
        self._rows(self.contexts, self.sums, part_of(mix(ids), shards), ids, sums)
        hot = np.flatnonzero(np.isin(ids, self.hot))
        sums[hot] = self.hot_sums[np.searchsorted(self.hot, ids[hot])]
        total, weight = sums[:, 0][back], (sums[:, 1:] @ d[1:])[back]
        both = (first >= 0) & (second >= 0)
        key = first[both].astype(np.uint64) << np.uint64(32) | second[both].astype(np.uint64)
        keys, at = np.unique(key, return_inverse=True)
        c = np.zeros(len(keys), np.int64)
        f, s = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self._rows(self.pairs, self.pair_counts, _shard_of(f, s, self.hot, shards), keys, c)
        count = np.zeros(len(first), np.int64)
        count[both] = c[at]
        seen = np.maximum(total, 1)
        return np.where(total > 0, np.maximum(count - d[np.minimum(count, 3)], 0) / seen + weight / seen * uni, uni)


_scorers: dict[str, Scorer] = {}


def _score(model: dict):
    def run(batches):
        total, distinct = model["tokens"], model["words"]
        if total and model["path"] not in _scorers:
            _scorers.clear()
            _scorers[model["path"]] = Scorer(model)
        scorer = _scorers.get(model["path"])
        for batch in batches:
            for b in slices(batch, 1, LOOK):
                offsets, codes, words = split_words(b.column(1))
                ends = offsets + np.arange(len(offsets))
                if scorer:
                    ids = scorer.vocabulary.find(hashes(words))
                    first, second = _pairs(ids, codes, offsets, scorer.end, scorer.start)
                    used, back = np.unique(second, return_inverse=True)
                    c = scorer.vocabulary.gather(scorer.vocabulary.counts, used)[back]
                    p = np.log10(scorer.probability(first, second))
                else:
                    c, p = np.zeros(ends[-1], np.int64), np.zeros(ends[-1])
                low = np.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))
                n = np.diff(ends)
                add = lambda x: np.add.reduceat(x, ends[:-1]) if len(n) else x  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(2), pa.array(n), pa.array(add((c > 0).astype(np.int64))), pa.array(np.full(len(n), total, np.int64)), pa.array(add(low)), pa.array(add(p)), pa.array(10 ** (-add(p) / np.maximum(n, 1)))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
                )

    return run


def score(docs: DataFrame, model: dict, held_out: Column) -> DataFrame:
    """Scores docs(doc_id, text) under a model of train()."""
    ship_package(docs.sparkSession)
    return docs.select("doc_id", "text", held_out.alias("held_out")).mapInArrow(
        lean(_score(model)), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    )


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 1
    return score(docs, train(docs.where(~held_out)), held_out)
