"""Media columns: payloads in archives, read by a Spark data source that plans byte ranges.

`write_media` turns each text into bytes, pads them and stores them as the samples of an 8-bit
grey PNG, 192 to a line, in archives of the `mediapack` format: members one after the
other, then a directory (id, place, length and CRC of each member), then an index of the
directory by blocks of bytes, then a fixed footer. Each write task makes one archive under a name of its
own; an archive counts only once the driver has committed a list that names it. A list is a file of its own, so
writes that append leave each other alone, and one that overwrites replaces all lists.

`spark.read.format("mediapack")` reads the committed list and the footers' indexes (not
the members' entries) and plans partitions of whole blocks, of about `rangeBytes` each. A task
reads its own part of the directory and streams its members in Arrow batches; every
member is fetched by its offset and checked by its CRC, and on a failure fetched again alone.

Nulls: a null text is an empty one, padded to one line; a null doc_id is kept. Repeated rows are
members of their own; a very long text is one member, held whole by one worker. Only doc_id and text are
read, so other columns can't clash. An empty table makes archives without members.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import sys
import time
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from logsift.llm.tokens import lean
from logsift.session import local_path, shared_dir, ship_package

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # planning workers may not see this package

LINE = 192
MAGIC, FOOTER, FOOTER_BYTES = b"MPK1", "<QQQ4s", 28  # directory offset, index offset, members
ENTRY = np.dtype([("id", "<i8"), ("known", "u1"), ("n_bytes", "<u8"), ("offset", "<u8"), ("length", "<u8"), ("crc", "<u4")])
BLOCK = np.dtype([("member", "<u8"), ("offset", "<u8")])
BLOCK_BYTES = 1 << 20
SCHEMA = "doc_id long, n_bytes long, media binary"


def encode_png(payload: bytes) -> bytes:
    """The payload as the samples of a grey PNG without line filters."""
    lines = np.frombuffer(payload, np.uint8).reshape(-1, LINE)
    raw = np.zeros((len(lines), LINE + 1), np.uint8)
    raw[:, 1:] = lines
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", LINE, len(lines), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 1)) + chunk(b"IEND", b"")


def decode_png(media: bytes) -> bytes:
    """The samples of such a PNG; raises where it is damaged."""
    if media[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data, lines = 8, [], 0
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError("damaged PNG chunk")
        if kind == b"IHDR":
            lines = struct.unpack_from(">I", body, 4)[0]
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(lines, LINE + 1)
    if raw[:, 0].any():
        raise ValueError("unexpected line filter")
    return raw[:, 1:].tobytes()


class Committed(WriterCommitMessage):
    def __init__(self, name: str):
        self.name = name


class Range(InputPartition):
    """Members first..last of an archive; their entries and bytes lie where it says."""

    def __init__(self, path: str, first: int, last: int, directory: int):
        self.path, self.first, self.last, self.directory = path, first, last, directory


def _lists(path: str) -> list[str]:
    """The committed lists of archives."""
    return sorted(f for f in os.listdir(path) if f.startswith("archives-") and f.endswith(".json"))


def _names(path: str, name: str) -> list[str]:
    with open(f"{path}/{name}") as f:
        return json.load(f)


class MediaWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator):
        name = f"{uuid.uuid4().hex}.mpk"
        os.makedirs(self.path, exist_ok=True)
        entries, blocks, at, count = [], [], 0, 0
        with open(f"{self.path}/.{name}", "wb") as f:
            for batch in iterator:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    data = (text or "").encode()
                    media = encode_png(data + b" " * (-len(data) % LINE if data else LINE))
                    if not blocks or at - blocks[-1][1] >= BLOCK_BYTES:
                        blocks.append((count, at))
                    f.write(media)
                    entries.append((doc_id or 0, doc_id is not None, len(data), at, len(media), zlib.crc32(media)))
                    at, count = at + len(media), count + 1
            f.write(np.array(entries, ENTRY).tobytes())
            index = at + count * ENTRY.itemsize
            f.write(np.array(blocks, BLOCK).tobytes())
            f.write(struct.pack(FOOTER, at, index, count, MAGIC))
        os.replace(f"{self.path}/.{name}", f"{self.path}/{name}")
        return Committed(name)

    def commit(self, messages):
        names = sorted(m.name for m in messages if m)
        os.makedirs(self.path, exist_ok=True)
        old = _lists(self.path) if self.overwrite else []
        gone = [n for f in old for n in _names(self.path, f)]
        name = f"archives-{uuid.uuid4().hex}.json"
        with open(part := f"{self.path}/.{name}", "w") as f:
            json.dump(names, f)
        os.replace(part, f"{self.path}/{name}")
        for f in [*old, *gone]:
            os.remove(f"{self.path}/{f}")

    def abort(self, messages):
        for m in messages:
            if m and os.path.exists(p := f"{self.path}/{m.name}"):
                os.remove(p)


class MediaReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self):
        out = []
        for name in [n for f in _lists(self.path) for n in _names(self.path, f)]:
            with open(path := f"{self.path}/{name}", "rb") as f:
                f.seek(-FOOTER_BYTES, os.SEEK_END)
                directory, index, count, magic = struct.unpack(FOOTER, f.read(FOOTER_BYTES))
                if magic != MAGIC:
                    raise ValueError(f"{path} is no media archive")
                f.seek(index)
                blocks = np.frombuffer(f.read(), BLOCK, (os.path.getsize(path) - FOOTER_BYTES - index) // BLOCK.itemsize)
            start = 0
            for k in range(1, len(blocks) + 1):
                if k == len(blocks) or blocks["offset"][k] - blocks["offset"][start] >= self.range_bytes:
                    last = int(blocks["member"][k]) if k < len(blocks) else count
                    out.append(Range(path, int(blocks["member"][start]), last, directory))
                    start = k
        return out or [Range("", 0, 0, 0)]

    def read(self, partition):
        if partition.first == partition.last:
            return
        with open(partition.path, "rb") as f:
            f.seek(partition.directory + partition.first * ENTRY.itemsize)
            entries = np.frombuffer(f.read((partition.last - partition.first) * ENTRY.itemsize), ENTRY)
            rows, held = [], 0
            for e in entries:
                media = self._member(f, partition.path, int(e["offset"]), int(e["length"]), int(e["crc"]))
                rows.append((int(e["id"]) if e["known"] else None, int(e["n_bytes"]), media))
                held += len(media)
                if held >= 4 << 20:
                    yield self._batch(rows)
                    rows, held = [], 0
            if rows:
                yield self._batch(rows)

    @staticmethod
    def _batch(rows):
        ids, sizes, media = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    @staticmethod
    def _member(f, path: str, offset: int, length: int, crc: int, tries: int = 4) -> bytes:
        for k in range(tries):
            try:
                f.seek(offset)
                media = f.read(length)
                if len(media) == length and zlib.crc32(media) == crc:
                    return media
            except OSError:
                pass
            time.sleep(0.05 * 4**k)
            try:  # on a fresh handle, this member alone
                with open(path, "rb") as g:
                    g.seek(offset)
                    media = g.read(length)
                if len(media) == length and zlib.crc32(media) == crc:
                    return media
            except OSError:
                pass
        raise OSError(f"{path}: the member at {offset} can't be read")


class MediaPack(DataSource):
    """Option `rangeBytes`: about how many bytes of members a partition reads."""

    @classmethod
    def name(cls):
        return "mediapack"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return MediaReader(self.options["path"], int(self.options.get("rangeBytes", 16 << 20)))

    def writer(self, schema, overwrite):
        return MediaWriter(self.options["path"], overwrite)


def write_media(docs: DataFrame, path: str | None = None, mode: str = "append") -> str:
    """Writes archives of docs(doc_id, text), beside those that are there or (mode "overwrite") in their place; returns their folder."""
    spark = docs.sparkSession
    ship_package(spark)
    spark.dataSource.register(MediaPack)
    path = local_path(path or shared_dir(spark, "media"))
    docs.select("doc_id", "text").write.format("mediapack").mode(mode).save(path)
    return path


def read_media(spark: SparkSession, path: str) -> DataFrame:
    """The members of committed archives: (doc_id, n_bytes, media)."""
    spark.dataSource.register(MediaPack)
    return spark.read.format("mediapack").load(path)


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _features(batches):
    for b in batches:
        rows = []
        for doc_id, n, media in zip(*(c.to_pylist() for c in b.columns)):
            payload = decode_png(media)
            x = np.frombuffer(payload, np.uint8)
            counts = np.bincount(x, minlength=256)
            values = np.arange(256)
            total = int(counts @ values)
            p = counts[counts > 0] / len(x)
            mean = total / len(x)
            spread = float(np.sqrt(max(0.0, float(counts @ (values * values)) / len(x) - mean * mean)))
            columns = x.reshape(-1, LINE)[:, ::3].sum(0, dtype=np.int64)
            bits = np.packbits(columns[1:] > columns[:-1]).tobytes().hex()
            feature = f"mean={mean:.4f};sd={spread:.4f};entropy={-float(p @ np.log2(p)):.4f};slope={bits}"
            rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        kinds = {"long": pa.int64(), "string": pa.string()}
        fields = [f.split() for f in FEATURES.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*rows) if rows else [()] * len(fields), fields)], names=[f for f, _ in fields])


def media_features(media: DataFrame) -> DataFrame:
    """Digests and features of members as they were read back."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(lean(_features), FEATURES)


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return media_features(read_media(spark, write_media(docs)))
