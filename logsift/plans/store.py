"""A store of time-sorted parts: Parquet files, an append-only log and an index of labels and tokens.

A write makes its files first and then renames the next entry of the log into place, which fails if it is
there already; readers trust nothing but the log, and pass over an entry that a broken writer left torn. PUT adds a
part, MERGE puts one part in the place of several, INDEX says where the postings of parts are. Every SNAPSHOT_EVERY
entries the state is written as a table, from which replay goes on; entries before it can be truncated.

Searches prune parts before Spark opens a file: by time range; by the few values of `service_name` and `level` that
each part notes; by the 3-grams that a term or literal must have; and by postings where another label must have
a given value. Results depend on the row predicate alone; only the opt-in `token_gate` skips parts that lack a
whole token. Batch ids make repeated writes of the same batch no-ops.

Layout: parts/<id>/ (timestamp, data, labels, service_name, level), postings/<index id>/ (token, data_id),
log/<16 digits>.json, snapshots/<16 digits>/. Rows of a part lie in time order within each file.
"""

from __future__ import annotations

import base64
import json
import time
import uuid
import zlib
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field, fields

import numpy as np
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from logsift.functions.grams import gram_bits, gram_sets
from logsift.functions.labels import labels_column
from logsift.functions.text import token_list, tokens
from logsift.operators import layout, search
from logsift.operators.matcher import Matcher

FAN_IN, SAFE_AGE, BLOCK_ROWS = 4, 300, 512
TOKEN_CAP, VALUE_CAP = 10_000, 100  # tokens of a part that the index has, and values of a column that a part notes; more are not noted at all
SNAPSHOT_EVERY = 64
COLUMNS = ("service_name", "level")  # labels that are columns of their own
TOKEN, CUT = "tok:", "tok-cut"  # postings of whole tokens; a part with more than the cap has CUT alone


@dataclass(frozen=True)
class Part:
    part_id: str
    level: int
    min_timestamp: int
    max_timestamp: int
    count: int
    index_id: str | None = None  # the folder of its postings
    values: str = "{}"  # JSON: the values of COLUMNS, null where there are too many

    @property
    def indexed(self) -> bool:
        return self.index_id is not None

    @property
    def blocks(self) -> int:
        return -(-self.count // BLOCK_ROWS)


PART = "part_id string, level int, min_timestamp long, max_timestamp long, count long, index_id string, values string"
SNAPSHOT = f"{PART}, active boolean, grams binary"


@dataclass
class QueryStats:
    """Counters of one search, under the names that responses carry. Blocks are counted as BLOCK_ROWS rows of a part."""

    parts_total: int = 0
    parts_pruned_by_ts: int = 0
    parts_pruned_by_index: int = 0
    parts_scanned: int = 0
    blocks_total: int = 0
    blocks_pruned_by_ts: int = 0
    blocks_pruned_by_index: int = 0
    blocks_scanned: int = 0
    entries_scanned: int = 0
    entries_matched: int = 0
    used_index: bool = False
    duration_ms: int = 0

    def to_json(self) -> dict:
        return asdict(self)


@dataclass
class Result:
    """A search: `rows` runs when an action does; finished() then has the counters."""

    rows: DataFrame
    stats: QueryStats
    _matched: Observation = field(repr=False)
    _plain: DataFrame = field(repr=False)
    _began: float = field(default_factory=time.monotonic, repr=False)

    def finished(self, matched: int | None = None) -> QueryStats:
        """The counters, once an action such as collect() or a write has run over `rows`."""
        self.stats.entries_matched = self._matched.get["n"] if matched is None else matched
        self.stats.duration_ms = int((time.monotonic() - self._began) * 1000)
        return self.stats

    def to_json(self):
        """The response, piece by piece; rows stream from the executors."""
        yield '{"data":['
        n = 0
        for r in self._plain.toLocalIterator():  # which observations don't see
            yield ("," if n else "") + json.dumps({"timestamp": r.timestamp, "data": r.data}, ensure_ascii=False)
            n += 1
        yield f'],"stats":{json.dumps(self.finished(n).to_json())}}}'


def _union(values: Iterable[str]) -> str:
    """Noted values of several parts, as those of one."""
    out: dict = {c: set() for c in COLUMNS}
    for v in map(json.loads, values):
        for c in COLUMNS:
            out[c] = None if out[c] is None or v.get(c) is None else out[c] | set(v[c])
    return json.dumps({c: None if v is None or len(v) > VALUE_CAP else sorted(v) for c, v in out.items()})


class LogStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)
        self._parsed: dict[int, str] = {}  # entries never change, and an index is never used twice

    # The log

    def _list(self, folder: str) -> list:
        path = self._path(f"{self.root}/{folder}")
        return list(self._fs.listStatus(path)) if self._fs.exists(path) else []

    def _read(self, path) -> str:
        stream = self._fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _entries(self) -> list[tuple[int, object]]:
        """(index, path) of the log's entries, in order."""
        return sorted(((int(n[:-5]), s.getPath()) for s in self._list("log") if (n := s.getPath().getName()).endswith(".json") and n[:-5].isdigit()), key=lambda x: x[0])

    def log(self, after: int = -1) -> list[dict]:
        """Entries after an index, in order; one that a writer left torn was never committed."""
        out = []
        for index, path in self._entries():
            if index > after:
                try:
                    body = self._parsed.get(index) or self._read(path)
                    out.append(json.loads(body))
                    self._parsed[index] = body
                except ValueError:
                    continue
        self._parsed = {i: b for i, b in self._parsed.items() if i > after}
        return out

    def _append(self, op: str, **entry) -> int:
        """Commits an entry under the next index: written aside, then renamed, which fails if another was first."""
        jvm = self.spark._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        for _ in range(100):
            index = max([self._snapshot(), *(i for i, _ in self._entries())]) + 1
            aside, path = self._path(f"{self.root}/log/.{uuid.uuid4().hex}"), self._path(f"{self.root}/log/{index:016d}.json")
            out = self._fs.create(aside, False)
            try:
                out.write(json.dumps({"index": index, "op": op, **entry}).encode())
            finally:
                out.close()
            try:
                files.rename(aside, path, none)
            except Exception as e:
                self._fs.delete(aside, False)
                if "AlreadyExists" in str(e):
                    continue  # another writer was first
                raise
            if index - self._snapshot() >= SNAPSHOT_EVERY:
                self.snapshot()
            return index
        raise RuntimeError("the log is written to by too many at once")

    # Snapshots of the log

    def _snapshot(self) -> int:
        """The index of the last entry in the last snapshot, -1 if there is none. A snapshot is renamed into place when it is whole."""
        return max((int(n) for s in self._list("snapshots") if (n := s.getPath().getName()).isdigit()), default=-1)

    def _base(self, at: int) -> DataFrame | None:
        return self.spark.read.schema(SNAPSHOT).parquet(f"{self.root}/snapshots/{at:016d}") if at >= 0 else None

    def snapshot(self) -> int:
        """Writes the state after the last entry as a table, one row for each part there ever was; the index of that entry."""
        at, base = self._snapshot(), None
        tail = self.log(at)
        if not tail:
            return at
        base, last = self._base(at), tail[-1]["index"]
        gone = {p for e in tail for p in e.get("old_parts", ())}
        new = [e for e in tail if "part" in e]
        rows = [(*(e["part"].get(f.split()[0]) for f in PART.split(", ")), e["part"]["part_id"] not in gone, base64.b64decode(e["grams"]) if e.get("grams") else None) for e in new]
        out = self.spark.createDataFrame(rows, SNAPSHOT)
        if base is not None:
            old = self.spark.createDataFrame([(p,) for p in sorted(gone)], "gone string")
            kept = base.join(F.broadcast(old), base["part_id"] == old["gone"], "left").withColumn("active", F.col("active") & F.col("gone").isNull()).drop("gone")
            out = kept.unionByName(out)
        moves = {p: e["index_id"] for e in tail if e["op"] == "INDEX" for p in e["part_ids"]}
        if moves:
            moved = self.spark.createDataFrame(list(moves.items()), "moved string, index string")
            out = out.join(moved, out["part_id"] == moved["moved"], "left").withColumn("index_id", F.coalesce("index", "index_id")).drop("moved", "index")
        aside = f"{self.root}/snapshots/.{uuid.uuid4().hex}"
        out.select(*(f.split()[0] for f in SNAPSHOT.split(", "))).write.parquet(aside)
        if not self._fs.rename(self._path(aside), self._path(f"{self.root}/snapshots/{last:016d}")):
            self._fs.delete(self._path(aside), True)  # another writer's says the same
        return last

    def truncate_log(self, pointer: int | None = None) -> int:
        """Deletes entries that the last snapshot holds and (where given) a reader at `pointer` has passed, and older snapshots; how many entries."""
        at, gone = self._snapshot(), 0
        for index, path in self._entries():
            if index <= at and (pointer is None or index < pointer):
                self._fs.delete(path, False)
                gone += 1
        for s in self._list("snapshots"):
            if (n := s.getPath().getName()).isdigit() and int(n) < at:
                self._fs.delete(s.getPath(), True)
        return gone

    def _state(self) -> tuple[list[Part], DataFrame | None, dict[str, bytes]]:
        """(active parts, the snapshot, 3-gram sets of parts since): replay of the log; a part that a MERGE replaced doesn't come back."""
        at = self._snapshot()
        base, tail = self._base(at), self.log(at)
        names = [f.name for f in fields(Part)]
        active = {r.part_id: r.asDict() for r in base.where("active").select(*names).collect()} if base is not None else {}
        grams: dict[str, bytes] = {}
        for e in tail:
            if "part" in e:
                active[e["part"]["part_id"]] = {k: v for k, v in e["part"].items() if k in names}
                if e.get("grams"):
                    grams[e["part"]["part_id"]] = zlib.decompress(base64.b64decode(e["grams"]))
            for p in e.get("part_ids", ()):
                if p in active:
                    active[p]["index_id"] = e["index_id"]
        gone = {p for e in tail for p in e.get("old_parts", ())}
        return sorted((Part(**p) for p in active.values() if p["part_id"] not in gone), key=lambda p: (p.min_timestamp, p.part_id)), base, grams

    def parts(self) -> list[Part]:
        """Active parts."""
        return self._state()[0]

    # Writes

    def _save(self, entries: DataFrame, part_id: str) -> tuple[int, int, int] | None:
        """(least, greatest timestamp, rows) of a written part."""
        path, seen = f"{self.root}/parts/{part_id}", Observation()
        label = lambda k: F.element_at("labels", k)
        full = entries.select("timestamp", "data").withColumn("labels", labels_column(entries)) if "labels" not in entries.columns else entries.select("timestamp", "data", "labels")
        full = full.withColumns({c: label(c) for c in COLUMNS}).observe(seen, F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"), F.count("*").alias("n"))
        out = full.sortWithinPartitions("timestamp").write.mode("overwrite").option("compression", "zstd")
        for c in COLUMNS:  # whole row groups are skipped where a value can't be
            out = out.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", "1000")
        out.parquet(path)
        m = seen.get
        if not m["n"]:
            self._fs.delete(self._path(path), True)
            return None
        return m["lo"], m["hi"], m["n"]

    def _values(self, written: DataFrame) -> str:
        """The distinct values of COLUMNS, at most VALUE_CAP of each."""
        out = {}
        for c in COLUMNS:
            found = [r[0] for r in written.select(F.coalesce(c, F.lit("")).alias(c)).distinct().limit(VALUE_CAP + 1).collect()]
            out[c] = None if len(found) > VALUE_CAP else sorted(found)
        return json.dumps(out)

    def _postings(self, written: DataFrame, part_id: str) -> DataFrame:
        """(token, data_id) of the labels and of the whole tokens of a part, these up to TOKEN_CAP."""
        labels = layout.postings(written.withColumn("part", F.lit(part_id)), "part", F.col("labels"))
        found = [r[0] for r in written.select(F.explode(tokens(F.col("data"))).alias("t")).distinct().limit(TOKEN_CAP + 1).collect()]
        return labels.unionByName(self._tokens(found, part_id))

    def _tokens(self, found: list[str], part_id: str) -> DataFrame:
        rows = [(CUT, part_id)] if len(found) > TOKEN_CAP else [(TOKEN + t, part_id) for t in found]
        return self.spark.createDataFrame(rows, "token string, data_id string")

    def _index(self, rows: DataFrame, index_id: str) -> None:
        rows.sortWithinPartitions("token").write.mode("overwrite").parquet(f"{self.root}/postings/{index_id}")

    def append(self, entries: DataFrame, batch_id: str, index: bool = True) -> Part | None:
        """Flushes entries(timestamp, data) as a part of level 0; a batch that was flushed already is left alone."""
        part_id, at = f"b-{batch_id}", self._snapshot()
        done = [e["part"] for e in self.log(at) if "part" in e and e["part"]["part_id"] == part_id]
        if not done and at >= 0:
            done = [r.asDict() for r in self._base(at).where(F.col("part_id") == part_id).drop("active", "grams").limit(1).collect()]
        if done:
            return Part(**done[0])
        if not (saved := self._save(entries, part_id)):
            return None
        written = self.spark.read.parquet(f"{self.root}/parts/{part_id}")
        if index:
            self._index(self._postings(written, part_id), part_id)
        part = Part(part_id, 0, *saved, part_id if index else None, self._values(written))
        self._append("PUT", part=asdict(part), old_parts=[], grams=self._packed(gram_sets(written)))
        return part

    @staticmethod
    def _packed(grams: bytes | None) -> str | None:
        return base64.b64encode(zlib.compress(grams)).decode() if grams else None

    def ingest(self, entries: DataFrame, batch_id: str) -> Part:
        """append() for request bodies: refuses a batch without entries."""
        if not (part := self.append(entries, batch_id)):
            raise ValueError("empty block")
        return part

    def verify(self, part_ids: Iterable[str] | None = None) -> dict[str, str]:
        """What is wrong with parts (all active ones, if none are named): every row is read, and counts, times and order are compared."""
        wanted, wrong = set(part_ids) if part_ids is not None else None, {}
        for p in self.parts():
            if wanted is not None and p.part_id not in wanted:
                continue
            try:
                rows = self.spark.read.parquet(f"{self.root}/parts/{p.part_id}")
                m = rows.agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"), F.count("*").alias("n"), F.sum(F.length("data")).alias("read")).first()
            except Exception as e:
                wrong[p.part_id] = f"unreadable: {str(e).splitlines()[0][:200]}"
                continue
            if (m.lo, m.hi, m.n) != (p.min_timestamp, p.max_timestamp, p.count):
                wrong[p.part_id] = f"has {m.n} rows of {m.lo} to {m.hi}, not {p.count} of {p.min_timestamp} to {p.max_timestamp}"
        return wrong

    def compact(self, force: bool = False) -> list[Part]:
        """Merges the oldest parts of each level that has FAN_IN of them into one of the next level; `force` also does with
        fewer at level 0. A part that isn't what the log says is an error, and nothing is merged."""
        made = []
        for level in sorted({p.level for p in self.parts()}):
            everything, base, grams = self._state()
            old = [p for p in everything if p.level == level][:FAN_IN]
            if not old or len(old) < FAN_IN and not (force and level == 0):
                continue
            rows, total = self._open(old), sum(p.count for p in old)
            ordered = rows.repartitionByRange(max(1, total // 1_000_000 + 1), "timestamp")
            part_id = f"c-{level + 1}-{old[0].part_id[-12:]}-{time.time_ns()}"
            saved = self._save(ordered, part_id)
            if saved != (min(p.min_timestamp for p in old), max(p.max_timestamp for p in old), total):
                raise ValueError(f"parts {[p.part_id for p in old]} hold {saved}, which is not what the log says")
            ids = [p.part_id for p in old]
            if all(p.indexed for p in old):  # the postings of the old parts say it all
                posted = self._postings_of(old).where(F.col("data_id").isin(ids)).select("token", F.lit(part_id).alias("data_id"))
                is_token = F.col("token").startswith(TOKEN) | (F.col("token") == CUT)
                found = [r.token for r in posted.where(is_token).select("token").distinct().limit(TOKEN_CAP + 2).collect()]
                kept = [CUT] * (TOKEN_CAP + 1) if CUT in found else [t.removeprefix(TOKEN) for t in found]
                postings = posted.where(~is_token).distinct().unionByName(self._tokens(kept, part_id))
            else:
                postings = self._postings(self.spark.read.parquet(f"{self.root}/parts/{part_id}"), part_id)
            self._index(postings, part_id)
            part = Part(part_id, level + 1, *saved, part_id, _union(p.values for p in old))
            self._append("MERGE", part=asdict(part), old_parts=ids, grams=self._packed(self._merged(ids, base, grams)))
            made.append(part)
        return made

    def _merged(self, ids: list[str], base: DataFrame | None, grams: dict[str, bytes]) -> bytes | None:
        """The 3-grams of several parts; None if those of one aren't known."""
        found = {i: grams[i] for i in ids if i in grams}
        if base is not None and len(found) < len(ids):
            found |= {r.part_id: zlib.decompress(r.grams) for r in base.where(F.col("part_id").isin(ids) & F.col("grams").isNotNull()).select("part_id", "grams").collect()}
        return np.bitwise_or.reduce([np.frombuffer(found[i], np.uint8) for i in ids]).tobytes() if len(found) == len(ids) else None

    def reindex(self) -> list[str]:
        """Builds the postings of parts that have none."""
        todo = [p.part_id for p in self.parts() if not p.indexed]
        for part_id in todo:
            self._index(self._postings(self.spark.read.parquet(f"{self.root}/parts/{part_id}"), part_id), part_id)
            self._append("INDEX", index_id=part_id, part_ids=[part_id])
        return todo

    def compact_index(self, least: int = 2) -> str | None:
        """Merges the postings of all indexed parts, where they lie in `least` folders or more, into one folder sorted by token;
        postings of parts that are no longer active go. Returns its id."""
        some = [p for p in self.parts() if p.indexed]
        if len({p.index_id for p in some}) < least:
            return None
        ids = self.spark.createDataFrame([(p.part_id,) for p in some], "data_id string")
        index_id = f"x-{time.time_ns()}"
        self._index(self._postings_of(some).join(F.broadcast(ids), "data_id", "left_semi").select("token", "data_id").distinct().repartitionByRange("token"), index_id)
        self._append("INDEX", index_id=index_id, part_ids=[p.part_id for p in some])
        return index_id

    def vacuum(self, age: float = SAFE_AGE, now: float | None = None) -> list[str]:
        """Deletes files of no active part that haven't changed for `age` seconds; a folder is as old as the newest file in it,
        so one that is being written stays."""
        active, limit, gone = self.parts(), ((now or time.time()) - age) * 1000, []
        for folder, kept in (("parts", {p.part_id for p in active}), ("postings", {p.index_id for p in active})):
            for s in self._list(folder):
                if (name := s.getPath().getName()) not in kept and self._changed(s) < limit:
                    self._fs.delete(s.getPath(), True)
                    gone.append(f"{folder}/{name}")
        return sorted(gone)

    def _changed(self, status) -> int:
        """When something in a folder was last changed."""
        inner = [self._changed(s) for s in self._fs.listStatus(status.getPath())] if status.isDirectory() else []
        return max([status.getModificationTime(), *inner])

    # Searches

    def _open(self, parts: list[Part]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], "timestamp long, data string, labels map<string,string>, service_name string, level string")
        return self.spark.read.schema("timestamp long, data string, labels map<string,string>, service_name string, level string").parquet(*[f"{self.root}/parts/{p.part_id}" for p in parts])

    def _postings_of(self, parts: list[Part]) -> DataFrame:
        return self.spark.read.schema("token string, data_id string").parquet(*sorted({f"{self.root}/postings/{p.index_id}" for p in parts}))

    def _posted(self, parts: list[Part], wanted: list[str]) -> set[str]:
        """Indexed parts that the index has under all wanted tokens."""
        return {r.data_id for r in layout.parts_with_all(self._postings_of(parts), wanted).collect()}  # no more than there are parts

    def _with_grams(self, parts: list[Part], base: DataFrame | None, grams: dict[str, bytes], bits: list[int]) -> list[Part]:
        """Parts that may hold all of some 3-grams; those whose 3-grams aren't known may."""
        lacks = {i for i, g in grams.items() if any(not g[b >> 3] >> (7 - (b & 7)) & 1 for b in bits)}
        ids = {p.part_id for p in parts} - grams.keys()
        if base is not None and ids:  # the sets stay with Spark; only ids come back, no more than there are parts
            known = base.where("active and grams is not null").select("part_id", "grams").mapInArrow(_lacking(bits), "part_id string")
            lacks |= {r.part_id for r in known.collect()}
        return [p for p in parts if p.part_id not in lacks]

    def search(self, start: int | None = None, end: int | None = None, term: str | None = None, q: str | Matcher | None = None, use_index: bool = True, token_gate: bool = False, hot: DataFrame | None = None) -> Result:
        """Rows of all parts, and of `hot` (timestamp, data), not yet flushed. `token_gate` skips indexed parts that lack a whole
        token of the term, as a token index does that knows no parts of tokens."""
        m = (q if isinstance(q, Matcher) else Matcher.from_json(q)) if q else None
        lo, hi = 0 if start is None else start, 1 << 62 if end is None else end
        everything, base, grams = self._state()
        near = [p for p in everything if p.max_timestamp >= lo and p.min_timestamp <= hi]
        stats = QueryStats(parts_total=len(everything), parts_pruned_by_ts=len(everything) - len(near), blocks_total=sum(p.blocks for p in near))
        kept = near
        if use_index:
            wanted = m.equalities() if m else []
            noted = [(k, v) for k, v in wanted if k in COLUMNS]
            for k, v in noted:
                kept = [p for p in kept if (known := json.loads(p.values).get(k)) is None or v in known]
            bits = gram_bits([term.lower()] if term and not m else [f.value for f in m.lines if f.op in ("|=", "eq")] if m else [])
            if bits and kept:
                kept = self._with_grams(kept, base, grams, bits)
            posted = [f"lbl:{k}={v}" for k, v in wanted if k not in COLUMNS]
            if posted and kept and all(p.indexed for p in kept):
                found = self._posted(kept, posted)
                kept = [p for p in kept if p.part_id in found]
            stats.used_index = bool(wanted or bits) and bool(near)
        if token_gate and term and not m and (words := token_list(term)):
            known = [p for p in kept if p.indexed]
            found = self._posted(known, [TOKEN + t for t in words]) | self._posted(known, [CUT]) if known else set()
            kept = [p for p in kept if not p.indexed or p.part_id in found]
        stats.parts_pruned_by_index, stats.parts_scanned = len(near) - len(kept), len(kept)
        stats.blocks_pruned_by_index, stats.blocks_scanned = sum(p.blocks for p in near) - sum(p.blocks for p in kept), sum(p.blocks for p in kept)
        stats.entries_scanned = sum(p.count for p in kept)
        matched = Observation()
        columns = {c: F.col(c) for c in COLUMNS}
        rows = search.matching(self._open(kept), start=start, end=end, term=term, q=m, label_of=lambda k: columns.get(k, F.element_at("labels", k))).select("timestamp", "data")
        if hot is not None:
            rows = rows.unionByName(search.search(hot, start=start, end=end, term=term, q=m))
        return Result(rows.observe(matched, F.count("*").alias("n")), stats, matched, rows)


def _lacking(bits: list[int]):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            sets = [zlib.decompress(g) for g in b.column(1).to_pylist()]
            ids = [i for i, g in zip(b.column(0).to_pylist(), sets) if any(not g[k >> 3] >> (7 - (k & 7)) & 1 for k in bits)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string())], names=["part_id"])

    return run

