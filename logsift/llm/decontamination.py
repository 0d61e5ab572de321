"""Benchmark passages in documents, up to edits, by CGK embedding and bit-sampling LSH.

Texts are lists of words (runs of letters and digits, lower case; of scripts that don't set words
apart each character). A passage is a part of a text that turns into the item by at most a fifth of the item's
words inserted, deleted or replaced.

1. Items are searched by probes: whole, or, over LONG words, by even blocks, of which one has at most its share of the edits.
2. A probe of n words and k edits is cut into m pieces of PIECE words or less; m - k of them stand whole in a passage, at
   places that differ by at most k. Only item-sized windows around such places are looked at, where a probe is long enough
   around two pieces or more; none within the bound is lost.
3. Each window and each probe walks through its words under shared random bits (Chakraborty, Goldenberg and
   Koucky: a step stays or goes on, as the bit of step and word says), which turns edits into few differing
   places. A walk of n steps doesn't leave the n words, so no place is padding. Two sampled places of a walk make a
   bucket key, over as many repetitions as the target recall needs.
4. Windows and probes that meet in a bucket are verified by the exact edit distance of the whole item within the text around.

Items come in blocks of at most ITEMS items and ITEM_BYTES of text (one item may be longer), each held by the workers
while they pass over all texts: nothing is shuffled. Items of fewer than LEAST words allow for no edit: they match
where they stand exactly. An item of fewer than FEWEST words matches nothing. Of equal distances the first place
in the text counts. Nulls: null texts and null items hold no words; a null doc_id or item_id is kept. Repeated
rows and repeated items are reported each. Empty texts hold nothing; very long texts and items are searched whole, an item by
probes of bounded length. Of the input only doc_id and text are read, and the filter keeps all columns under any
names. Empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.llm.tokens import LETTERS, MARKS_TEXT, lean, slices
from logsift.llm.words import hashes, mix, split_words
from logsift.session import ship_package

ITEMS, ITEM_BYTES, FEWEST, LEAST, EDITS = 20_000, 16 << 20, 2, 5, 0.2
LONG, PIECE = 64, 3  # words of a probe and of a piece, at most
WALKS, SAMPLED, RECALL, AGREE = 8, 2, 0.999, 0.45  # AGREE: the least share of equal places expected within the bound
HELD = 1 << 21  # words of embedded windows at a time
# Thai, Lao, Burmese, Khmer, kana, and Chinese characters.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3041-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
WORD = re.compile(rf"[{UNSPACED}]|[^\W_{UNSPACED}]+")


#: Chunks that are one word, and stay so in lower case letter by letter: of ASCII, Latin and Cyrillic letters and digits.
ONE_WORD = rf"^[0-9{LETTERS}]+$"


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row offsets, hash of each word)."""
    offsets, codes, chunks = split_words(texts)
    if not len(chunks):
        return offsets, np.array([], np.uint64)
    cores = pc.utf8_trim(chunks, MARKS_TEXT)
    one = pc.match_substring_regex(cores, ONE_WORD)
    plain = one.to_numpy(zero_copy_only=False)
    other = [WORD.findall(x.lower()) for x in chunks.filter(pc.invert(one)).to_pylist()]
    n = np.ones(len(chunks), np.int64)
    n[~plain] = np.fromiter(map(len, other), np.int64, len(other))
    start = np.cumsum(n) - n
    h = np.empty(int(n.sum()), np.uint64)
    mine = np.repeat(plain, n)
    h[mine] = hashes(pc.utf8_lower(cores.filter(one)))
    h[~mine] = hashes(pa.array([w for f in other for w in f], pa.large_string()))
    size = n[codes]
    to = np.concatenate([[0], np.cumsum(size)])
    return to[offsets], h[np.arange(to[-1]) + np.repeat(start[codes] - to[:-1], size)]


def edits_of(n: int) -> int:
    return int(EDITS * n + 1e-9)


def repetitions() -> int:
    """How many keys of SAMPLED places reach RECALL."""
    return math.ceil(math.log(1 - RECALL) / math.log(1 - AGREE**SAMPLED))


@lru_cache(maxsize=WALKS)
def _bits(walk: int) -> np.ndarray:
    """Odd multipliers of the steps: the top bit of a word times that of a step says whether the walk goes on."""
    return mix(np.arange(LONG, dtype=np.uint64) + np.uint64(walk << 32 | 1)) | np.uint64(1)


def embed(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int, walk: int) -> np.ndarray:
    """CGK embedding of the windows of n words from `starts`, cut at `ends`: rows of n words, 0 beyond the end."""
    out, place, last = np.empty((n, len(starts)), np.uint64), starts.astype(np.int64), len(words) - 1
    for t, bit in enumerate(_bits(walk)[:n]):
        x = words[np.minimum(place, last)]
        x[place >= ends] = 0
        out[t] = x
        place = place + (x * bit >> np.uint64(63)).astype(np.int64)
    return out.T


def _places(n: int) -> list[tuple[int, np.ndarray]]:
    """(walk, sampled places) of each repetition for probes of n words."""
    draw = np.random.default_rng(n)
    return [(r % WALKS, draw.choice(n, SAMPLED, replace=False)) for r in range(repetitions())]


def _keys(embedded: np.ndarray, places: np.ndarray, repetition: int) -> np.ndarray:
    key = np.full(len(embedded), repetition + 1, np.uint64)
    for p in places:
        key = mix(key ^ embedded[:, p])
    return key


def best_alignment(item: list[int], region: list[int]) -> tuple[int, int]:
    """(edit distance, end) of the best match of an item with any part of a region, by
    bit-parallel dynamic programming."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << len(item)) - 1, 1 << (len(item) - 1)
    plus, minus, score, best, end = full, 0, len(item), len(item), 0
    for j, w in enumerate(region):
        eq = masks.get(w, 0)
        d = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        hp, hm = minus | ~(d | plus) & full, plus & d
        if hp & top:
            score += 1
        elif hm & top:
            score -= 1
        hp, hm = hp << 1 & full, hm << 1 & full
        plus, minus = hm | ~(d | hp) & full, hp & d
        if score < best:
            best, end = score, j + 1
    return best, end


def _piece(n: int) -> tuple[int, int]:
    """(words of a piece, how many pieces stand whole) for probes of n words."""
    k = edits_of(n)
    for size in range(PIECE, 2, -1):
        if n // size - k > 1:
            return size, n // size - k
    size = n // (k + 1)
    return size, n // size - k


def _blocks_of(n: int) -> list[tuple[int, int]]:
    """(start, end) of the probes of an item."""
    many = -(-n // LONG) if n >= LEAST else 1
    return [(n * j // many, n * (j + 1) // many) for j in range(many)]


class Matcher:
    """A block of items, ready to be searched for."""

    def __init__(self, items: list[tuple[int, str]]):
        offsets, words = word_hashes(pa.array([t for _, t in items], pa.string()))
        self.items = [(i, words[a:z]) for (i, _), a, z in zip(items, offsets[:-1], offsets[1:]) if z - a >= FEWEST]
        self.probes = [(k, a, z) for k, (_, w) in enumerate(self.items) for a, z in _blocks_of(len(w))]
        self.item = np.array([k for k, _, _ in self.probes], np.int64)
        self.start = np.array([a for _, a, _ in self.probes], np.int64)
        self.size = np.array([z - a for _, a, z in self.probes], np.int64)
        self.edits = np.array([edits_of(n) for n in self.size.tolist()], np.int64)
        self.whole = np.array([_piece(n)[1] for n in self.size.tolist()], np.int64)
        text = [self.items[k][1][a:z] for k, a, z in self.probes]
        self.groups: dict[int, tuple] = {}  # by length: bucket keys, probes, places
        for n in sorted({int(x) for x in self.size if x >= LEAST}):
            mine = np.flatnonzero(self.size == n)
            flat, places, keys = np.concatenate([text[p] for p in mine]), _places(n), []
            walks = [embed(flat, np.arange(len(mine)) * n, (np.arange(len(mine)) + 1) * n, n, w) for w in range(WALKS)]
            for r, (w, at) in enumerate(places):
                keys.append(_keys(walks[w], at, r))
            key, owner = np.concatenate(keys), np.tile(mine, len(places))
            order = np.argsort(key, kind="stable")
            self.groups[n] = (key[order], owner[order], places)
        self.pieces = {}  # by size: hashes, probes, places in them
        for size in sorted({_piece(int(n))[0] for n in np.unique(self.size)}):
            rows = [(_rolled(w, size)[: len(w) // size * size : size], p) for p, w in enumerate(text) if _piece(len(w))[0] == size]
            h, probe = np.concatenate([x for x, _ in rows]), np.repeat([p for _, p in rows], [len(x) for x, _ in rows])
            place = np.concatenate([np.arange(len(x)) * size for x, _ in rows])
            order = np.argsort(h, kind="stable")
            filled = np.zeros(1 << 22, bool)
            filled[(h >> np.uint64(42)).astype(np.int64)] = True
            self.pieces[size] = (h[order], probe[order], place[order], filled)

    def find(self, offsets: np.ndarray, words: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item, first word, words, edit distance) of the best match of each row and item."""
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        for size, (h, probe, place, filled) in self.pieces.items():
            if len(words) < size:
                continue
            rolled = _rolled(words, size)
            at = np.flatnonzero(filled[(rolled >> np.uint64(42)).astype(np.int64)])
            at = at[row_of[at] == row_of[at + size - 1]]
            lo, hi = np.searchsorted(h, rolled[at]), np.searchsorted(h, rolled[at], "right")
            at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
            for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(np.cumsum(hi - lo) // HELD)) + 1):
                if len(part):
                    part = part if part[0] == 0 or len(part) == len(at) else np.arange(np.searchsorted(row_of[at], row_of[at[part[0]]]), part[-1] + 1)  # rows stay whole
                    times = (hi - lo)[part]
                    which = np.arange(times.sum()) + np.repeat(lo[part] - np.cumsum(times) + times, times)
                    self._windows(row_of[np.repeat(at[part], times)], probe[which], np.repeat(at[part], times) - place[which], offsets, words, found)
        return [(r, i, s, n, d) for (r, i), (d, s, n) in sorted(found.items())]

    def _windows(self, row, probe, start, offsets, words, found) -> None:
        """Of places where pieces stand: windows around enough pieces of one probe."""
        order = np.lexsort((start, probe, row))
        row, probe, start = row[order], probe[order], start[order]
        need = self.whole[probe] - 1
        last = np.arange(len(row)) + need
        ok = last < len(row)
        last = np.minimum(last, len(row) - 1)
        ok &= (row[last] == row) & (probe[last] == probe) & (start[last] - start <= self.edits[probe])
        row, probe, lo, hi = row[ok], probe[ok], (start[last] - self.edits[probe])[ok], (start + self.edits[probe])[ok]
        short = self.size[probe] < LEAST
        for r, p, s in np.unique(np.stack([row[short], probe[short], lo[short]], 1), axis=0).tolist():
            item = self.items[self.item[p]][1]
            if s >= offsets[r] and s + len(item) <= offsets[r + 1] and (r, self.item[p]) not in found and (words[s : s + len(item)] == item).all():
                found[r, int(self.item[p])] = (0, s - int(offsets[r]), len(item))
        for n in np.unique(self.size[probe[~short]]).tolist():
            mine = self.size[probe] == n
            many = (hi - lo + 1)[mine]
            at = np.repeat(lo[mine] - np.cumsum(many) + many, many) + np.arange(many.sum())
            r = np.repeat(row[mine], many)
            keep = (at >= offsets[r]) & (at < offsets[r + 1])
            near = np.unique(np.stack([r[keep], at[keep]], 1), axis=0)
            step = max(1, HELD // (WALKS * n))
            for a in range(0, len(near), step):
                self._bucket(n, near[a : a + step, 0], near[a : a + step, 1], offsets, words, found)

    def _bucket(self, n, row, start, offsets, words, found) -> None:
        keys, owner, places = self.groups[n]
        walks, met = {}, []
        ends = offsets[row + 1]
        for r, (w, at) in enumerate(places):
            if w not in walks:
                walks[w] = embed(words, start, ends, n, w)
            own = _keys(walks[w], at, r)
            lo, hi = np.searchsorted(keys, own), np.searchsorted(keys, own, "right")
            times = hi - lo
            which = np.arange(times.sum()) + np.repeat(lo - np.cumsum(times) + times, times)
            met.append(np.stack([np.repeat(row, times), owner[which], np.repeat(start, times)], 1))
        met = np.concatenate(met)
        met = np.unique(np.stack([met[:, 0], self.item[met[:, 1]], met[:, 2] - self.start[met[:, 1]]], 1), axis=0)
        done: tuple[int, int, int] | None = None
        for r, i, s in met.tolist():
            if done and done[:2] == (r, i) and s <= done[2]:
                continue  # within the part that was verified last
            item = self.items[i][1].tolist()
            k, size = edits_of(len(item)), len(item)
            a, z = max(int(offsets[r]), s - k), min(int(offsets[r + 1]), s + size + 3 * k)
            if a >= z:
                continue
            region = words[a:z].tolist()
            d, end = best_alignment(item, region)
            done = (r, i, s + k)
            if d <= k and d <= found.get((r, i), (k,))[0]:
                back, length = best_alignment(item[::-1], region[:end][::-1])
                length = length if back == d else size
                place = a + end - length - int(offsets[r])
                if (r, i) not in found or (d, place) < found[r, i][:2]:
                    found[r, i] = (d, place, length)


def _rolled(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words."""
    n = len(words) - size + 1
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for k in range(size):
            h = h * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
        return mix(h)


def _blocks(items: DataFrame):
    """The items in blocks of at most ITEMS items and ITEM_BYTES of text, in order of item_id."""
    block: list[tuple[int, str]] = []
    held = 0
    for r in items.where("text is not null").select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        size = len(r.text.encode())
        if block and (len(block) == ITEMS or held + size > ITEM_BYTES):
            yield block
            block, held = [], 0
        block.append((r.item_id, r.text))
        held += size
    if block:
        yield block


_matchers: dict[int, Matcher] = {}


def _matcher(block: list[tuple[int, str]]) -> Matcher:
    key = hash(tuple(block))
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(block)
    return _matchers[key]


MATCHES = "doc_id long, item_id long, start_word long, n_words long, distance long, similarity double"


def _matches(block: list[tuple[int, str]]):
    def run(batches):
        matcher = _matcher(block)
        for batch in batches:
            for b in slices(batch, 1, 4_000_000):
                ids, rows = b.column(0).to_pylist(), []
                for r, i, s, n, d in matcher.find(*word_hashes(b.column(1))):
                    item, words = matcher.items[i]
                    rows.append((ids[r], item, s, n, d, 1 - d / len(words)))
                c = list(zip(*rows)) or [()] * 6
                kinds = [pa.int64()] * 5 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, kinds)], names=[f.split()[0] for f in MATCHES.split(", ")])

    return run


def find_passages(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The best match of each document and item of items(item_id, text) within the bound of edits."""
    ship_package(docs.sparkSession)
    out = None
    for block in _blocks(items):
        part = docs.select("doc_id", "text").mapInArrow(lean(_matches(block)), MATCHES)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], MATCHES)


def _flags(block: list[tuple[int, str]], column: int, names: list[str]):
    def run(batches):
        matcher = _matcher(block)
        for batch in batches:
            for b in slices(batch, column, 4_000_000):
                hit = np.zeros(b.num_rows, bool)
                hit[[x[0] for x in matcher.find(*word_hashes(b.column(column)))]] = True
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hit)], names=names)

    return run


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without those that hold an item's passage; all columns stay."""
    ship_package(docs.sparkSession)
    out, flag = docs, "_leaks"
    while flag in docs.columns:
        flag += "_"
    for block in _blocks(items):
        schema = T.StructType([*out.schema.fields, T.StructField(flag, T.BooleanType())])
        out = out.mapInArrow(lean(_flags(block, out.columns.index("text"), [*out.columns, flag])), schema).where(~F.col(flag)).drop(flag)
    return out


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
