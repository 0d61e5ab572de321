"""Content-addressed store of token ids.

A rolling hash over the ids cuts each document's stream into chunks, so equal passages give
equal chunks wherever they stand. The store has three Parquet tables and a manifest:

* `kind=0`: every distinct chunk once (digest, ids in 2 or 4 bytes each);
* `kind=1`: every distinct recipe once (its root digest, the digests and lengths of its chunks);
* `documents`: in ascending doc_id order, the root of each document, its id count and the
  ids before it; one shard per range of doc_id;
* `manifest`: per shard its rows, ids, first position and Merkle root over the document roots.

Nulls: a null text is an empty one, and a document always has its end id; a null doc_id sorts
first. Repeated rows are kept, each with its own place; ties of doc_id go by the order in which they were read. A very long
text is encoded whole by one worker and stored as many chunks. Only doc_id and text are read, so other columns can't
clash. An empty table gives an empty store. A reader compares all shards with the manifest: one that is lost,
foreign or changed is an error.
Chunks, recipes and prefix sums are made by distributed jobs; the driver holds one row a shard.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.llm.crc import shift
from logsift.llm.tokens import WORD_BPE, encoder, lean, slices
from logsift.session import shared_dir, ship_package

WINDOW, LEAST, MEAN_BITS, MOST = 16, 32, 7, 512
MOST_SEEN = 100_000  # keys that a map task remembers, so as to write them once
_B = np.uint64(0x9E3779B97F4A7C15)


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def cuts(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ends of all chunks (offsets into ids): where the hash of the last WINDOW ids has
    MEAN_BITS leading zeros, no chunk under LEAST but a row's last, none over MOST."""
    with np.errstate(over="ignore"):
        h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        base, k = _B, 1
        while k < WINDOW:
            h[k:] += h[:-k] * base
            base, k = base * base, 2 * k
        h *= np.uint64(0xFF51AFD7ED558CCD)
    marks = np.flatnonzero(h < np.uint64(1 << 64 - MEAN_BITS)) + 1
    lo = np.searchsorted(marks, offsets, "right").tolist()
    marks, ends = marks.tolist(), []
    for r, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        for m in marks[lo[r] : lo[r + 1]]:
            while m - a > MOST:
                a += MOST
                ends.append(a)
            if m - a >= LEAST:
                a = m
                ends.append(a)
        while b - a > MOST:
            a += MOST
            ends.append(a)
        if b > a:
            ends.append(b)
    return np.array(ends, np.int64)


_ENTRY = np.dtype([("key", "V16"), ("n", "<u4")])
STAGED = pa.schema([("kind", pa.int8()), ("key", pa.binary()), ("uid", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("payload", pa.binary())])
DOCUMENTS = "doc_id long, uid long, key binary, n long, pid int, local long"
STAGED_DDL = "kind tinyint, key binary, uid long, doc_id long, n long, payload binary"


def _binary(data: bytes, bounds: np.ndarray) -> pa.Array:
    """data[bounds[i]:bounds[i + 1]] as an array, without a copy."""
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(data)])


def _firsts(keys: list[bytes], seen: set[bytes]) -> np.ndarray:
    """Where each distinct key that isn't in `seen` stands first; all are in it afterwards."""
    if len(seen) > MOST_SEEN:  # those to come may be written again; the aggregation keeps one
        seen.clear()
    first = []
    for i, k in enumerate(keys):
        if k not in seen:
            seen.add(k)
            first.append(i)
    return np.array(first, np.int64)


def _rows(kind: int, **columns: pa.Array) -> pa.RecordBatch:
    n = len(columns["key"])
    columns["kind"] = pa.array(np.full(n, kind, np.int8))
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in STAGED], schema=STAGED)


def _stage(path: str, spaces: bool, end_id: int):
    def run(batches):
        from pyspark import TaskContext

        enc, uid, chunks, wholes = encoder(path, spaces), TaskContext.get().partitionId() << 40, set(), set()
        for batch in batches:
            for b in slices(batch, 1, 9_000_000):  # a whole batch as a rule: its pieces are looked up once
                ids, off = enc.encode(b.column(1), end_id)
                ends = cuts(ids, off)
                bounds = np.concatenate([[0], ends])
                data, w = ids.astype("<u4").tobytes(), 4 if ids.max() > 0xFFFF else 2
                at = bounds.tolist()
                keys = [digest(data[4 * s : 4 * e]) for s, e in zip(at, at[1:])]
                first, sizes = _firsts(keys, chunks), np.diff(bounds)
                all_keys = _binary(joined := b"".join(keys), 16 * np.arange(len(keys) + 1))
                payload = _binary(ids.astype(f"<u{w}").tobytes(), w * bounds)
                yield _rows(0, key=all_keys.take(pa.array(first)), n=pa.array(sizes[first]), payload=payload.take(pa.array(first)))
                entries = np.empty(len(keys), _ENTRY)
                entries["key"], entries["n"] = np.frombuffer(joined, "V16"), sizes
                recipes, per_row = entries.tobytes(), 20 * np.searchsorted(bounds, off)
                at = per_row.tolist()
                roots = [digest(recipes[s:e]) for s, e in zip(at, at[1:])]
                first, n = _firsts(roots, wholes), np.diff(off)
                roots = _binary(b"".join(roots), 16 * np.arange(len(roots) + 1))
                yield _rows(1, key=roots.take(pa.array(first)), n=pa.array(n[first]), payload=_binary(recipes, per_row).take(pa.array(first)))
                yield _rows(2, key=roots, n=pa.array(n), doc_id=b.column(0), uid=pa.array(uid + np.arange(len(n))))
                uid += len(n)

    return run


def _positions(batches):
    """Adds pid and the ids of this shard before each row."""
    from pyspark import TaskContext

    pid, before = TaskContext.get().partitionId(), 0
    for b in batches:
        n = b.column("n").to_numpy().astype(np.int64)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(n), pid, np.int32)), pa.array(before + np.cumsum(n) - n)], names=[*b.schema.names, "pid", "local"])
        before += int(n.sum())


def _shards(batches):
    h, rows, ids, pid = hashlib.blake2b(digest_size=16), 0, 0, None
    for b in batches:
        for p, root, n in zip(b.column("pid").to_pylist(), b.column("key").to_pylist(), b.column("n").to_pylist()):
            if pid is not None and p != pid:
                yield pa.RecordBatch.from_pydict({"pid": pa.array([pid], pa.int32()), "rows": [rows], "ids": [ids], "root": [h.digest()]})
                h, rows, ids = hashlib.blake2b(digest_size=16), 0, 0
            pid = p
            h.update(root)
            rows, ids = rows + 1, ids + n
    if pid is not None:
        yield pa.RecordBatch.from_pydict({"pid": pa.array([pid], pa.int32()), "rows": [rows], "ids": [ids], "root": [h.digest()]})


def _shard_roots(documents: DataFrame) -> list:
    """One row a shard; its rows are hashed in order within one sorted partition."""
    return sorted(
        documents.repartition(F.col("pid")).sortWithinPartitions("pid", "local").select("pid", "key", "n").mapInArrow(lean(_shards), "pid int, rows long, ids long, root binary").collect(),
        key=lambda r: r.pid,
    )


def write_store(docs: DataFrame, tokenizer_path: str, end_id: int, spaces: bool = False, store: str | None = None) -> str:
    """Encodes docs(doc_id, text) and writes the store; returns its path."""
    spark = docs.sparkSession
    ship_package(spark)
    store = store or shared_dir(spark, "token-store")
    staged = docs.select("doc_id", "text").mapInArrow(lean(_stage(tokenizer_path, spaces, end_id)), STAGED_DDL)
    # a chunk that many documents share leaves a map task once, so rows are dealt as they are and sorted once, for the aggregation
    unique = staged.repartition("kind", "key", "uid").groupBy("kind", "key", "uid").agg(F.first("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("payload").alias("payload"))
    unique.write.partitionBy("kind").parquet(f"{store}/staged")
    rows = _part(spark, store, 2).select("doc_id", "uid", "key", "n")
    ordered = rows.repartitionByRange(F.col("doc_id"), F.col("uid")).sortWithinPartitions("doc_id", "uid")
    ordered.mapInArrow(lean(_positions), DOCUMENTS).write.parquet(f"{store}/documents")
    shards, start, out = _shard_roots(spark.read.parquet(f"{store}/documents")), 0, []
    for s in shards:
        out.append((s.pid, s.rows, s.ids, start, bytes(s.root)))
        start += s.ids
    top = digest(b"".join(x[4] for x in out))
    spark.createDataFrame([(*x, top) for x in out], "pid int, rows long, ids long, start long, root binary, store_root binary").coalesce(1).write.parquet(f"{store}/manifest")
    return store


def _part(spark: SparkSession, store: str, kind: int) -> DataFrame:
    return spark.read.schema(STAGED_DDL).option("basePath", f"{store}/staged").parquet(f"{store}/staged").where(F.col("kind") == kind)


def _ids(payload: bytes, n: int) -> np.ndarray:
    return np.frombuffer(payload, "<u2" if len(payload) == 2 * n else "<u4").astype("<u4")


def _check_chunks(batches):
    for b in batches:
        keys, payloads = b.column("key").to_pylist(), b.column("payload").to_pylist()
        n = b.column("n").to_numpy().astype(np.int64)
        width = np.fromiter(map(len, payloads), np.int64, len(payloads)) // np.maximum(n, 1)
        crcs = np.empty(len(n), np.int64)
        for w in (2, 4):
            mine = np.flatnonzero(width == w)
            data = np.frombuffer(b"".join([payloads[i] for i in mine]), f"<u{w}").astype("<u4").tobytes()
            ends = np.cumsum(4 * n[mine]).tolist()
            for i, s, e in zip(mine.tolist(), [0, *ends], ends):
                part = data[s:e]
                if digest(part) != keys[i]:
                    raise ValueError(f"chunk {keys[i].hex()} is damaged")
                crcs[i] = zlib.crc32(part)
        if not np.isin(width, (2, 4)).all():
            raise ValueError("a chunk has another length than it says")
        yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(crcs)], names=["chunk", "crc"])


def _open_recipes(batches):
    for b in batches:
        roots, recipes = b.column("key"), b.column("payload").to_pylist()
        for root, recipe in zip(roots.to_pylist(), recipes):
            if digest(recipe) != root:
                raise ValueError(f"recipe {root.hex()} is damaged")
        n = np.fromiter(map(len, recipes), np.int64, len(recipes)) // 20
        bounds, entries = np.concatenate([[0], np.cumsum(n)]).astype(np.int64), np.frombuffer(b"".join(recipes), _ENTRY)
        size = entries["n"].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(size)])
        row = np.repeat(np.arange(len(n)), n)
        yield pa.RecordBatch.from_arrays(
            [
                roots.take(pa.array(row)),
                _binary(np.ascontiguousarray(entries["key"]).tobytes(), 16 * np.arange(len(entries) + 1)).cast(pa.binary()),
                pa.array(np.arange(len(entries)) - bounds[row]),
                pa.array(size),
                pa.array(total[bounds[row + 1]] - total[1:]),
            ],
            names=["root", "chunk", "seq", "size", "after"],
        )


def _shifted(batches):
    for b in batches:
        crc = shift(b.column("crc").to_numpy().astype(np.uint32), b.column("after").to_numpy() * 4)
        yield pa.RecordBatch.from_arrays([b.column("root"), b.column("size"), pa.array(crc.astype(np.int64))], names=["root", "size", "crc"])


def _entries(spark: SparkSession, store: str) -> DataFrame:
    return _part(spark, store, 1).select("key", "payload").mapInArrow(lean(_open_recipes), "root binary, chunk binary, seq long, size long, after long")


def _verified(spark: SparkSession, store: str) -> tuple[DataFrame, dict]:
    """The store's documents and its manifest by shard; raises where a shard is lost, foreign or damaged."""
    manifest = {r.pid: r for r in spark.read.parquet(f"{store}/manifest").collect()}
    documents = spark.read.schema(DOCUMENTS).parquet(f"{store}/documents")
    shards, start = {s.pid: s for s in _shard_roots(documents)}, 0
    if missing := sorted(shards.keys() ^ manifest.keys()):
        raise ValueError(f"shards {missing} are in the manifest or among the documents, but not in both")
    for pid, s in shards.items():
        if (s.rows, s.ids, s.root, start) != (manifest[pid].rows, manifest[pid].ids, manifest[pid].root, manifest[pid].start):
            raise ValueError(f"shard {pid} doesn't match its manifest")
        start += s.ids
    if any(r.store_root != digest(b"".join(bytes(s.root) for s in shards.values())) for r in manifest.values()):
        raise ValueError("the manifest's root isn't that of its shards")
    return documents, manifest


def read_digests(spark: SparkSession, store: str) -> DataFrame:
    """Verifies the whole store and returns (doc_id, start, n_tokens, ids_crc32, root).

    Each stored chunk is read once, checked against its digest and summed; a document's checksum
    is put together from those of its chunks, so no payload is moved."""
    ship_package(spark)
    documents, manifest = _verified(spark, store)
    chunks = _part(spark, store, 0).select("key", "n", "payload").mapInArrow(lean(_check_chunks), "chunk binary, crc long")
    parts = _entries(spark, store).join(chunks, "chunk").mapInArrow(lean(_shifted), "root binary, size long, crc long")
    recipes = parts.groupBy("root").agg(F.sum("size").alias("size"), F.expr("bit_xor(crc)").alias("crc"))
    starts = spark.createDataFrame([(p, r.start) for p, r in manifest.items()], "pid int, shard_start long")
    whole = documents.join(F.broadcast(starts), "pid").join(recipes, documents["key"] == recipes["root"], "left")
    ok = F.col("size").eqNullSafe(F.col("n"))
    return whole.select(
        "doc_id",
        (F.col("shard_start") + F.col("local")).alias("start"),
        F.when(ok, F.col("n")).otherwise(F.raise_error(F.lit("a document's chunks are missing"))).alias("n_tokens"),
        F.col("crc").alias("ids_crc32"),
        F.lower(F.hex("key")).alias("root"),
    )


def _join_ids(batches):
    for b in batches:
        ids = [np.concatenate([_ids(p["payload"], p["n"]) for p in parts]).tolist() for parts in b.column("parts").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("root"), pa.array(ids, pa.list_(pa.int64()))], names=["root", "ids"])


def read_ids(spark: SparkSession, store: str) -> DataFrame:
    """Reconstructs the documents: (doc_id, uid, ids)."""
    ship_package(spark)
    chunks = _part(spark, store, 0).select(F.col("key").alias("chunk"), "n", "payload")
    parts = _entries(spark, store).join(chunks, "chunk").groupBy("root").agg(F.sort_array(F.collect_list(F.struct("seq", "n", "payload"))).alias("parts"))
    ids = parts.mapInArrow(lean(_join_ids), "root binary, ids array<long>")
    documents, _ = _verified(spark, store)
    whole = documents.join(ids, documents["key"] == ids["root"], "left")
    return whole.select("doc_id", "uid", F.when(F.size("ids").eqNullSafe(F.col("n").cast("int")), F.col("ids")).otherwise(F.raise_error(F.lit("a document's chunks are missing")).cast("array<bigint>")).alias("ids"))


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_digests(spark, write_store(docs, public_tokenizers.path(WORD_BPE), end_id=1))
