"""Toxicity by noisy-channel deobfuscation and words learned from labels.

A chunk with a digit, sign or separator that looks like a letter or stands between letters, or with
a letter doubled, becomes a lattice: every character may stand for itself, for the letters it looks
like, or be left out. Viterbi decoding under a character trigram model picks the likeliest plain
spelling; runs of single letters set apart by spaces are joined first. Any other neighbouring chunks
are joined where one way through their lattices is a heavy word as a whole, and so is a chunk with doubled
letters by itself. A chunk of plain letters, none doubled, has one path and is its own decoding. The features of a word, as written and as restored, are the word and its first 4,
5 and 6 letters; each weighs what share of the labelled documents that hold it are toxic, as a
lower confidence bound. A logistic model of the heaviest weights, of how many distinct chunks
weigh much, absolutely and by the length, turns them into the document's score; in fitting it, a document's
own label is taken out of its weights.

The character model counts all documents it is given; a trigram that is less than LEAST_SHARE of all is left
to its backoff, so there are at most 1 / LEAST_SHARE of them. Weights and the logistic model are fitted on
at most MAX_LABELLED labelled doc_ids (those with the smallest hashes), one text each (the least), which are written once.
A feature counts that stands in LEAST_TOXIC toxic documents of them and weighs LEAST_WEIGHT; there is no other limit to features.

Nulls: a null text is empty and gets the floor score; null labels and null doc_ids teach nothing.
Of several labels of a doc_id the largest counts. Repeated rows are scored each, ties alike. A very long text is split into words
like any other, by one worker. Other columns stay, under any names. Without labels every document gets the
floor; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.llm.tokens import lean, slices
from logsift.llm.words import split_words
from logsift.session import shared_dir, ship_package

MAX_LABELLED, LEAST_SHARE, LEAST_WEIGHT = 30_000, 1e-6, 0.01
LEAST_TOXIC, CONFIDENCE, FLOOR, THRESHOLD, SPACED = 5, 3.3, 0.001, 0.3, 4
HEAVY = 0.2  # the least weight that a summary counts
REMEMBERED = 100_000  # decoded chunks that a worker keeps
# Letters that digits and signs stand for.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "<": "c", "¡": "i"}
LETTERS = re.compile(r"[^\W\d_]+")
REPEAT = re.compile(r"(.)\1", re.DOTALL)
DOUBLED = re.compile(r"([^\W\d_])\1")
LOOK = re.compile(f"[{re.escape(''.join(LOOKS))}]")
EDGE = ".,;:?\"'()[]{}…»«“”‘’`*_-~"


class CharacterModel:
    """Interpolated trigram model of letters in words."""

    def __init__(self, trigrams: dict[str, int]):
        self.c3, self.c2, self.c1, self.x3, self.x2 = Counter(), Counter(), Counter(), Counter(), Counter()
        for t, n in trigrams.items():
            self.c3[t] += n
            self.x3[t[:2]] += n
            self.c2[t[1:]] += n
            self.x2[t[1]] += n
            self.c1[t[2]] += n
        self.n, self.known = sum(self.c1.values()), len(self.c1) + 1
        self.cache: dict[str, float] = {}

    def cost(self, t: str) -> float:
        """-log p of the third character of t after the first two."""
        if t not in self.cache:
            p = (self.c1[t[2]] + 0.1) / (self.n + 0.1 * self.known)
            p = (self.c2[t[1:]] + 5 * p) / (self.x2[t[1]] + 5)
            p = (self.c3[t] + 5 * p) / (self.x3[t[:2]] + 5)
            if len(self.cache) > REMEMBERED:
                self.cache = {}
            self.cache[t] = -math.log(p)
        return self.cache[t]

    def decode(self, chunk: str, swap: float = 1.0, drop: float = 0.7, keep: float = 12.0) -> str:
        """The likeliest plain spelling of a chunk: Viterbi over its lattice of characters, with
        the last two letters as the state."""
        if not LOOK.search(chunk) and not DOUBLED.search(chunk):  # one way: all that are no letters are left out
            return "".join(filter(str.isalpha, chunk))
        best = {"^^": (0.0, "")}
        for i, ch in enumerate(chunk):
            ways = []
            if ch.isalpha():
                ways.append((ch, 0.0))
                if i and chunk[i - 1] == ch:
                    ways.append(("", drop))
            else:
                ways += [(x, swap) for x in LOOKS.get(ch, "")]
                ways.append(("", drop if ch not in LOOKS else keep))
            if len(ways) == len(best) == 1:  # a letter as it is
                (state, (cost, out)), (x, more) = *best.items(), ways[0]
                best = {state[1] + x: (cost + more + self.cost(state + x), out + x)} if x else {state: (cost + more, out)}
                continue
            step: dict[str, tuple[float, str]] = {}
            for state, (cost, out) in best.items():
                for x, more in ways:
                    to = state[1] + x if x else state
                    c = cost + more + (self.cost(state + x) if x else 0.0)
                    if to not in step or c < step[to][0]:
                        step[to] = (c, out + x)
            best = step
        return min((c + self.cost(s + "$"), out) for s, (c, out) in best.items())[1]


def is_plain(chunk: str) -> bool:
    return chunk.isalpha() and not REPEAT.search(chunk)


TWICE = "|".join(f"{c}{c}" for c in "abcdefghijklmnopqrstuvwxyz")


def _plain(cores: pa.Array, words: list[str]) -> np.ndarray:
    """is_plain() of all; those of ASCII letters at once."""
    known = pc.match_substring_regex(cores, "^[a-z]+$").to_numpy(zero_copy_only=False)
    out = known & ~pc.match_substring_regex(cores, TWICE).to_numpy(zero_copy_only=False)
    for c in np.flatnonzero(~known).tolist():
        out[c] = is_plain(words[c])
    return out


def spellings(core: str, model: CharacterModel | None) -> set[str]:
    """The words of a lower-cased chunk without marks at its edges, as written and as restored."""
    if is_plain(core):
        return {core}
    words = set(LETTERS.findall(core))
    core = core.rstrip("!") or core
    if model and (words or LOOK.search(core)) and (not core.isalpha() or REPEAT.search(core)):
        words.add(model.decode(core))
    return words


def features(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in (4, 5, 6) if len(word) > k)]


def _sets(batch: pa.RecordBatch, column: int):
    """For each slice: (slice, row offsets, codes, distinct chunks in lower case without marks at their edges)."""
    for b in slices(batch, column, 3_000_000):
        offsets, codes, words = split_words(b.column(column))
        cores = pc.utf8_lower(pc.utf8_trim(words, EDGE)).dictionary_encode()
        codes = cores.indices.to_numpy(zero_copy_only=False).astype(np.int64)[codes]
        yield b, offsets, codes, cores.dictionary


def _trigrams(batches):
    """(trigram, count) of the words of all texts: three characters of 21 bits, 1 for what is before a word, 2 for its end."""
    for batch in batches:
        for _, _, codes, cores in _sets(batch, 0):
            if not (words := cores.to_pylist()):
                continue
            x = np.frombuffer(("\0\0" + "\0".join(words) + "\0").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
            known = np.array([0, 1, 2, *(c for c in np.flatnonzero(np.bincount(x)).tolist() if chr(c).isalnum() and not chr(c).isdecimal())])
            number = np.zeros(max(int(x.max()), int(known.max())) + 1, np.int64)
            number[known[3:]] = np.arange(3, len(known))  # of each letter; 0 is none
            times = np.repeat(np.bincount(codes, minlength=len(words)), np.fromiter(map(len, words), np.int64, len(words)) + 1)
            x = number[x]
            letter = x > 0
            one, two = np.where(letter, x, 1)[1:-1], np.where(letter[1:-1] & letter[:-2], x[:-2], 1)
            used = letter[2:] | letter[1:-1]
            id_, k = ((two * len(known) + one) * len(known) + np.where(letter[2:], x[2:], 2))[used], len(known)
            if k**3 <= 1 << 22:
                n = np.bincount(id_, times[used]).astype(np.int64)
                ids = np.flatnonzero(n)
                n = n[ids]
            else:
                ids, which = np.unique(id_, return_inverse=True)
                n = np.bincount(which, times[used]).astype(np.int64)
            ids = known[ids // k // k] << 42 | known[ids // k % k] << 21 | known[ids % k]
            yield pa.RecordBatch.from_pydict({"key": pa.array(ids), "n": pa.array(n)})


def _text_of(trigram: int) -> str:
    return "".join({1: "^", 2: "$"}.get(c) or chr(c) for c in (trigram >> 42, trigram >> 21 & 0x1FFFFF, trigram & 0x1FFFFF))


def _learn(batches):
    """Features of toxic documents, with counts."""
    for batch in batches:
        toxic = Counter()
        for b, offsets, codes, cores in _sets(batch, 0):
            words = cores.to_pylist()
            for r, label in enumerate(b.column(1).to_pylist()):
                if label == 1:
                    toxic.update({f for c in np.unique(codes[offsets[r] : offsets[r + 1]]).tolist() for w in spellings(words[c], None) for f in features(w)})
        yield pa.RecordBatch.from_pydict({"key": pa.array(list(toxic), pa.string()), "n": pa.array(list(toxic.values()), pa.int64())})


def _clean_counts(candidates: frozenset):
    def run(batches):
        for batch in batches:
            clean = Counter()
            for b, offsets, codes, cores in _sets(batch, 0):
                own = [{f for w in spellings(x, None) for f in features(w) if f in candidates} for x in cores.to_pylist()]
                for r, label in enumerate(b.column(1).to_pylist()):
                    if label != 1:
                        clean.update(set().union(*(own[c] for c in np.unique(codes[offsets[r] : offsets[r + 1]]).tolist())))
            yield pa.RecordBatch.from_pydict({"key": pa.array(list(clean), pa.string()), "n": pa.array(list(clean.values()), pa.int64())})

    return run


def bound(toxic: int, clean: int, z: float = CONFIDENCE) -> float:
    """Wilson's lower bound of the share of toxic documents."""
    n = toxic + clean
    p = toxic / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of at most MAX_LABELLED labelled doc_ids, the documented bound, in the shared folder."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    path = shared_dir(docs.sparkSession, "toxicity-sample")
    rows.select("text", "toxic").write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """Learns from docs(doc_id, text) and labels(doc_id, toxic): feature weights and trigrams."""
    ship_package(docs.sparkSession)
    sample = _sample(docs, labels)
    seen = sample.mapInArrow(lean(_learn), "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))
    toxic = {r.key: r.n for r in seen.where(F.col("n") >= LEAST_TOXIC).collect()}  # of the sample
    path = shared_dir(docs.sparkSession, "toxicity-trigrams")
    docs.select("text").mapInArrow(lean(_trigrams), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).write.parquet(path)
    counted = docs.sparkSession.read.parquet(path)
    least = (counted.agg(F.sum("n")).first()[0] or 0) * LEAST_SHARE
    trigrams = {_text_of(r.key): r.n for r in counted.where(F.col("n") >= least).collect()}  # 1 / LEAST_SHARE at most
    clean = {}
    if toxic:
        found = sample.mapInArrow(lean(_clean_counts(frozenset(toxic))), "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))
        clean = {r.key: r.n for r in found.collect()}  # no more keys than `toxic` has
    counts = {k: (n, clean.get(k, 0)) for k, n in sorted(toxic.items()) if bound(n, clean.get(k, 0)) >= LEAST_WEIGHT}
    model = {"weights": {k: bound(*n) for k, n in counts.items()}, "trigrams": trigrams, "logistic": None}
    if counts:
        without = {1: {k: bound(n - 1, c) if n + c > 1 else FLOOR for k, (n, c) in counts.items()}, 0: {k: bound(n, c - 1) if c else w for (k, (n, c)), w in zip(counts.items(), model["weights"].values())}}
        rows = sample.mapInArrow(lean(_summaries(model, without)), f"label int, {', '.join(f'x{i} double' for i in range(SUMMARY))}").toPandas()  # MAX_LABELLED rows at most
        rows = rows.sort_values(list(rows.columns)).to_numpy(np.float64)
        model["logistic"] = _logistic(rows[:, 1:], rows[:, 0])
    return model


SUMMARY = 8


def _summary(own: np.ndarray) -> list[float]:
    """What the logistic model knows of a document: of the weights of its distinct chunks."""
    n = len(own)
    top = np.sort(own)[::-1][:3] if n else np.array([])
    top = np.concatenate([top, np.full(3 - len(top), FLOOR)])
    many, some, few = (int((own >= w).sum()) for w in (0.5, 0.3, 0.2))
    return [*top.tolist(), math.log1p(many), math.log1p(some), math.log1p(few), some / (n + 20), few / (n + 20)]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[list[float], list[float], list[float]]:
    """(means, scales, coefficients and the constant) by Newton's method; no coefficient is negative, so
    that more evidence never lowers a score."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    full = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    used = np.arange(x.shape[1])
    while True:
        z = full[:, [*used, -1]]
        b, penalty = np.zeros(z.shape[1]), np.diag([ridge] * len(used) + [1e-6])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
            step = np.linalg.solve((z.T * (p * (1 - p))) @ z + penalty, z.T @ (y - p) - penalty @ b)
            b += step
            if np.abs(step).max() < 1e-9:
                break
        if (b[:-1] >= 0).all():
            out = np.zeros(x.shape[1])
            out[used] = b[:-1]
            return mean.tolist(), scale.tolist(), [*out.tolist(), float(b[-1])]
        used = used[b[:-1] >= 0]


def _runs(offsets: np.ndarray, single: np.ndarray):
    """(row, first, end) of runs of at least SPACED single characters within a row."""
    edges = np.zeros(len(single) + 1, bool)
    edges[offsets] = True
    padded = np.concatenate([[False], single, [False]])
    starts = np.flatnonzero(padded[1:-1] & (~padded[:-2] | edges[:-1]))
    for a in starts.tolist():
        z = a + 1
        while z < len(single) and single[z] and not edges[z]:
            z += 1
        if z - a >= SPACED:
            yield int(np.searchsorted(offsets, a, "right")) - 1, a, z


class _Weigher:
    """Weights of chunks; what was spelled is remembered, within a bound."""

    def __init__(self, weights: dict[str, float], characters: CharacterModel):
        self.weights, self.characters, self.spelled = weights, characters, {}
        self.heavy = {k: w for k, w in weights.items() if w >= HEAVY and len(k) >= 3 and k.isalpha()}
        self.prefixes = {k[:i] for k in self.heavy for i in range(1, len(k) + 1)}
        self.inner = {k[i:j] for k in self.heavy for i in range(len(k)) for j in range(i + 1, len(k) + 1)}
        self.longest = max(map(len, self.heavy), default=0)
        self.starts = {k[:i] for k in (x.rstrip("*") for x, w in weights.items() if w >= HEAVY) for i in range(1, 5)}
        self.short = {x for x in self.starts if len(x) < 4 and weights.get(x, FLOOR) >= HEAVY}
        self.tables = [(pa.array(list(part), pa.large_string()), np.array([*part.values(), FLOOR])) for part in ({k: w for k, w in weights.items() if k[-1:] != "*"}, {k[:-1]: w for k, w in weights.items() if k[-1:] == "*"})]

    def word(self, word: str) -> float:
        get = self.weights.get
        if len(word) < 4:
            return get(word, FLOOR)
        return max(get(word, FLOOR), get(word[:4] + "*", FLOOR), get(word[:5] + "*", FLOOR), get(word[:6] + "*", FLOOR))

    def chunks(self, cores: pa.Array, words: list[str], plain: np.ndarray) -> np.ndarray:
        """The weights of distinct chunks: word() of all at once, and of those that aren't plain what they may spell."""
        look = lambda texts, table: table[1][pc.fill_null(pc.index_in(texts, table[0]), len(table[0])).to_numpy(zero_copy_only=False)]
        out, some = look(cores, self.tables[0]), np.flatnonzero(pc.greater(pc.utf8_length(cores), 3).to_numpy(zero_copy_only=False))
        long = cores.take(pa.array(some))
        for k in (4, 5, 6):
            out[some] = np.maximum(out[some], look(pc.utf8_slice_codeunits(long, 0, k), self.tables[1]))
        for c in np.flatnonzero(~plain).tolist():
            chunk = words[c]
            if self.may(chunk):
                out[c] = self._chunk(chunk)
            elif not chunk.isalpha():
                out[c] = max(map(self.word, LETTERS.findall(chunk)), default=FLOOR)
        return out

    def may(self, chunk: str) -> bool:
        """Whether a way through the lattice of a chunk starts as a heavy feature does; others are worth no decoding."""
        ways, starts, before = {""}, self.starts, ""
        for i, ch in enumerate(chunk):
            if ch.isalpha():
                more = {x + ch for x in ways if x + ch in starts}
                ways = more | ways if ch == before else more
            else:
                letters = LOOKS.get(ch, "")
                ways = ways | {x + c for x in ways for c in letters if x + c in starts}
            if not ways:
                return False
            if i > 2 and max(map(len, ways)) == 4:
                return True
            before = ch
        return not ways.isdisjoint(self.short)

    def _chunk(self, chunk: str) -> float:
        if chunk.isalpha():
            a = REPEAT.search(chunk).start()
            other = chunk[:a] + chunk[a + 1 :]
            if not REPEAT.search(other):  # two ways in all: decoding is of use only if the other weighs more
                weight, more = self.word(chunk), self.word(other)
                if more <= weight or self.heavy.get(other) == more:
                    return max(weight, more)
        whole = [self.heavy[x] for x in self.parts(chunk) if x in self.heavy]
        return max([*map(self.word, spellings(chunk, self.characters)), *whole], default=FLOOR)

    def parts(self, chunk: str) -> tuple[str, ...]:
        """The parts of heavy words that ways through the lattice of a chunk that isn't plain spell."""
        start = chunk[:3]
        if start not in self.inner and len(start) == 3 and is_plain(start):
            return ()
        if chunk not in self.spelled:
            if len(self.spelled) > REMEMBERED:
                self.spelled.clear()
            ways = {""}
            for i, ch in enumerate(chunk):
                letters = ch if ch.isalpha() else LOOKS.get(ch, "")
                stays = not letters or i and chunk[i - 1] == ch and ch.isalpha()
                ways = {y for x in ways for y in ((x,) if stays else ()) + tuple(x + c for c in letters) if not y or y in self.inner}
                if not ways:
                    break
            self.spelled[chunk] = tuple(sorted(ways - {""}))
        return self.spelled[chunk]

    def joined(self, offsets: np.ndarray, codes: np.ndarray, cores: pa.Array, words: list[str], plain: np.ndarray) -> dict[int, dict[str, float]]:
        """By row the heavy words that neighbouring chunks spell together, from the start of one to the end of another."""
        out: dict[int, dict[str, float]] = {}
        if len(codes) < 2 or not self.heavy:
            return out
        inner = self.inner
        parts = {c: (words[c],) for c in np.flatnonzero(plain & pc.less_equal(pc.utf8_length(cores), self.longest).to_numpy(zero_copy_only=False)).tolist() if words[c] in inner}
        parts.update((c, p) for c in np.flatnonzero(~plain).tolist() if (p := self.parts(words[c])))
        head, more = np.zeros(len(words), bool), np.zeros(len(words), bool)
        more[list(parts)] = True
        head[[c for c, p in parts.items() if any(x in self.prefixes for x in p)]] = True
        last = np.zeros(len(codes) + 1, bool)
        last[offsets] = True
        at = np.flatnonzero(head[codes[:-1]] & more[codes[1:]] & ~last[1:-1])
        pair, which = np.unique(codes[at] * len(words) + codes[at + 1], return_inverse=True)
        fits = np.fromiter((any(x + y in self.prefixes for x in parts[p // len(words)] for y in parts[p % len(words)]) for p in pair.tolist()), bool, len(pair))
        for a in at[fits[which]].tolist():
            ways, z = {x for x in parts[codes[a]] if x in self.prefixes}, a + 1
            while ways and z < len(codes) and not last[z]:
                ways = {x + y for x in ways for y in parts.get(codes[z], ()) if x + y in self.prefixes}
                for x in ways & self.heavy.keys():
                    out.setdefault(int(np.searchsorted(offsets, a, "right")) - 1, {})[x] = self.heavy[x]
                z += 1
        return out

    def spaced(self, line: str) -> float:
        """The heaviest word in letters that stood apart."""
        return max((self.word(text[i : i + k]) for text in {line, self.characters.decode(line)} for i in range(len(text) - 2) for k in range(3, 13)), default=FLOOR)


def _documents(offsets: np.ndarray, codes: np.ndarray, cores: pa.Array, weighers: list[_Weigher]):
    """For each row the weights of its distinct chunks, under the weigher of its place in `weighers`."""
    words = cores.to_pylist()
    plain = _plain(cores, words)
    one = pc.equal(pc.utf8_length(cores), 1).to_numpy(zero_copy_only=False)
    spaced: dict[int, list[str]] = {}
    for r, a, z in _runs(offsets, one[codes] if len(codes) else np.array([], bool)):
        spaced.setdefault(r, []).append("".join(words[c] for c in codes[a:z].tolist()))
    joined = {id(w): w.joined(offsets, codes, cores, words, plain) for w in set(weighers)}
    own = {id(w): w.chunks(cores, words, plain) for w in set(weighers)}
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    pairs = np.unique(row * max(1, len(words)) + codes)
    row, codes = pairs // max(1, len(words)), pairs % max(1, len(words))
    at = np.searchsorted(row, np.arange(len(offsets)))
    for r, w in enumerate(weighers):
        mine = own[id(w)][codes[at[r] : at[r + 1]]]
        more = [*map(w.spaced, spaced.get(r, [])), *joined[id(w)].get(r, {}).values()]
        yield np.append(mine, more) if more else mine


def _summaries(model: dict, without: dict[int, dict[str, float]]):
    def run(batches):
        characters = CharacterModel(model["trigrams"])
        weighers = {label: _Weigher(w, characters) for label, w in without.items()}
        for batch in batches:
            for b, offsets, codes, cores in _sets(batch, 0):
                labels = [int(x == 1) for x in b.column(1).to_pylist()]
                rows = [_summary(x) for x in _documents(offsets, codes, cores, [weighers[x] for x in labels])]
                yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), *(pa.array(c, pa.float64()) for c in zip(*rows))], names=["label", *(f"x{i}" for i in range(SUMMARY))])

    return run


def _score(model: dict, column: int, kept: list[int], names: list[str]):
    """Columns `kept` of each batch, and the score of the texts in `column`."""

    def run(batches):
        weigher = _Weigher(model["weights"], CharacterModel(model["trigrams"]))
        for batch in batches:
            for b, offsets, codes, cores in _sets(batch, column):
                score = np.full(b.num_rows, FLOOR)
                if model["logistic"]:
                    mean, scale, coefficients = map(np.array, model["logistic"])
                    x = np.array([_summary(x) for x in _documents(offsets, codes, cores, [weigher] * b.num_rows)])
                    z = ((x - mean) / scale) @ coefficients[:-1] + coefficients[-1]
                    score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), pa.array(score)], names=names)

    return run


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) of docs(doc_id, text)."""
    ship_package(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(lean(_score(model, 1, [0], ["doc_id", "score"])), "doc_id long, score double")


def clean_documents(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that score `threshold` or more; all columns stay."""
    ship_package(docs.sparkSession)
    name = "_toxicity"
    while name in docs.columns:
        name += "_"
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    scored = docs.mapInArrow(lean(_score(model, docs.columns.index("text"), list(range(len(docs.columns))), [*docs.columns, name])), schema)
    return scored.where(F.col(name) < threshold).drop(name)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = score(docs, fit(docs.where(~held_out()), labels.where(~held_out())))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
