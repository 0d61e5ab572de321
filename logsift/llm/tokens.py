"""Whole texts to token ids, fast: every distinct space-delimited piece is encoded once.

A text's ids are the ids of its pieces in order. That is exact for both supported
vocabularies: `word_bpe` drops white space, and in `byte_bpe` a token always starts at a
space that stands before a character that is no white space. Texts with a space before more
white space go to the tokenizer whole.
"""

from __future__ import annotations

import ctypes
import gc
import os
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

pa.set_memory_pool(pa.system_memory_pool())  # in workers, which import this: memory goes back between batches
try:
    _libc = ctypes.CDLL(None)
    _libc.mallopt(-3, 8 << 20)  # M_MMAP_THRESHOLD: else it grows, and large arrays stay with the process when they are freed
    _libc.mallopt(-1, 32 << 20)  # M_TRIM_THRESHOLD
except (AttributeError, OSError):  # another C library
    _libc = None

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"


END_MARKS = frozenset(".,;:!?")


def give_back() -> None:
    """Returns free memory of this process to the machine."""
    gc.collect()
    if _libc and hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def lean(run):
    """A function over batches whose worker gives its memory back when the task ends: workers outlive tasks and stages."""

    def guarded(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return guarded


def compact(texts: pa.Array) -> pa.Array:
    """A copy as large strings from offset 0, nulls as empty texts: string kernels read a
    cast slice at the wrong place."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return pc.fill_null(pc.take(texts, pa.array(np.arange(len(texts)))), "").cast(pa.large_string())


def strings(values: pa.Array) -> list[str]:
    """to_pylist of strings without nulls, in a fifth of its time."""
    return values.to_numpy(zero_copy_only=False).tolist()


def slices(batch: pa.RecordBatch, column: int, chars: int = 5_000_000):
    """Slices of a batch with about so many bytes of text each; one row at least."""
    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + chars, "right")))
        yield batch.slice(at, end - at)
        at = end


#: Marks whose runs behind letters are always apart from them, by both vocabularies' rules: ASCII's but the apostrophe.
MARKS_TEXT = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
MARKS = "".join("\\" + c for c in MARKS_TEXT)
#: Letters of Latin and Cyrillic scripts that stay single letters under NFC and in lower case (U+0130 doesn't).
LETTERS = r"A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{17f}\x{400}-\x{45f}"
#: White space that isn't a single space or line break between two other characters, and what stands for "no space before".
UNEVEN = r"  | \n|\n |\n\n|^[ \n]|[ \n]$|[\t\x0b-\x0d\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _bounds(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _pick(values: np.ndarray, bounds: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the runs values[bounds[i] : bounds[i + 1]] for each i of which, joined; their bounds)."""
    if not len(which):
        return values[:0], np.zeros(1, np.int64)
    runs = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(4 * bounds), pa.py_buffer(values)]).take(pa.array(which))
    at = np.frombuffer(runs.buffers()[1], "<i8", len(which) + 1) // 4
    return np.frombuffer(runs.buffers()[2], "<u4", at[-1]) if at[-1] else values[:0], at


class _Runs:
    """Ids of strings: those of string s are ids[bounds[i] : bounds[i + 1]] with i = at[s]. Place 0 is an empty run."""

    def __init__(self):
        self.at: dict[str, int] = {}
        self.ids, self.bounds = np.empty(0, "<u4"), np.zeros(2, np.int64)

    def find(self, keys: list[str]) -> np.ndarray:
        """The place of each key; -1 where there is none."""
        return np.fromiter(map(self.at.get, keys, repeat(-1)), np.int64, len(keys))

    def add(self, keys: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        first = len(self.bounds) - 1
        self.at.update(zip(keys, range(first, first + len(keys))))
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, ids])


class PieceEncoder:
    """Ids of texts under one tokenizers file; pieces met among the last `max_cached` to twice as many are remembered.

    Marks behind letters are looked up alone. Runs of letters are encoded many at a time: with a separator between
    them that has an id of its own, or with what the rules leave of them where the last id of a word shows that it ends."""

    def __init__(self, path: str, spaces: bool, max_cached: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.spaces, self.max_cached = spaces, max_cached
        self.between = "\r" if spaces else " \x01 "
        (self.mark,) = self._ids([self.between])[0]
        self.light = []
        if not spaces:  # of lower-case LETTERS the rules leave each run as one word: of ASCII as it is, of others in bytes
            cut, to_bytes = pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            for rules in (cut, pre_tokenizers.Sequence([cut, to_bytes])):
                self.light.append(light := Tokenizer.from_file(path))
                light.normalizer, light.pre_tokenizer = normalizers.Sequence([]), rules
            vocabulary, suffix = self.tok.get_vocab(), self.tok.model.end_of_word_suffix
            self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
            self.closes[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.runs, self.before = _Runs(), _Runs()  # those of the time before are kept as long as they are met again

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch(texts, add_special_tokens=False)] if texts else []

    def _learn(self, pieces: list[str]) -> None:
        rest = pieces
        if self.light:
            words = pa.array(pieces, pa.large_string())
            simple = pc.match_substring_regex(words, rf"^[{LETTERS}]+$")
            runs, rest = words.filter(simple), words.filter(pc.invert(simple)).to_pylist()
            for light, mine in zip(self.light, (pc.string_is_ascii(runs), pc.invert(pc.string_is_ascii(runs)))):
                part = runs.filter(mine)
                self._learn_runs(light, strings(part), strings(pc.utf8_lower(part)), " ")
        plain, other = [], []
        for p in rest:
            (plain if p[p[:1] == " " :].isalpha() else other).append(p)
        self._learn_runs(self.tok, plain, plain, self.between)
        ids = self._ids(other)
        self.runs.add(other, np.array([i for x in ids for i in x], "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)))

    def _learn_runs(self, tokenizer, keys: list[str], runs: list[str], between: str) -> None:
        ids, sizes = [], []
        for lo in range(0, len(runs), 500):
            part = runs[lo : lo + 500]
            got = np.array(tokenizer.encode_batch_fast([between.join(part)], add_special_tokens=False)[0].ids, "<u4")
            if tokenizer is self.tok:
                apart = got != self.mark
                ends = np.append(np.flatnonzero(~apart) - np.arange(len(got) - apart.sum()), apart.sum())
                got = got[apart]
            else:
                ends = np.flatnonzero(self.closes[got]) + 1
            if len(ends) != len(part):
                raise ValueError("a run of letters holds the separator")
            ids.append(got)
            sizes.append(np.diff(ends, prepend=0))
        if runs:
            self.runs.add(keys, np.concatenate(ids), np.concatenate(sizes))

    def _places(self, keys: list[str]) -> np.ndarray:
        """Where the ids of each key are in self.runs."""
        if len(self.runs.at) > self.max_cached:
            self.before, self.runs = self.runs, _Runs()
        at = self.runs.find(keys)
        if len(new := np.flatnonzero(at < 0)):
            missing = [keys[i] for i in new.tolist()]
            old = self.before.find(missing)
            ids, bounds = _pick(self.before.ids, self.before.bounds, old[old >= 0])
            self.runs.add([k for k, i in zip(missing, old.tolist()) if i >= 0], ids, np.diff(bounds))
            if (old < 0).any():
                self._learn([k for k, i in zip(missing, old.tolist()) if i < 0])
            at[new] = self.runs.find(missing)
        return at

    def _table(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of distinct pieces, bounds of each)."""
        if not self.spaces:  # the tokenizer lowers letters itself
            pieces = pc.if_else(pc.match_substring_regex(pieces, rf"^[A-Za-z]+[{MARKS}]*$"), pc.ascii_lower(pieces), pieces)
        marked = pc.match_substring_regex(pieces, rf"^\x1f?[{LETTERS}]+[{MARKS}]+$")
        heads = pc.if_else(marked, pc.utf8_rtrim(pieces, MARKS_TEXT), pieces)
        d, which = heads.dictionary_encode(), np.flatnonzero(marked.to_numpy(zero_copy_only=False))
        words = strings(d.dictionary)
        if self.spaces:
            words = [w[1:] if w[:1] == "\x1f" else w if w == "\n" else " " + w for w in words]
        some = pa.array(which)
        tails = pc.replace_substring_regex(pieces.take(some), rf"^\x1f?[{LETTERS}]+", "")
        t = tails.dictionary_encode()
        at = self._places(words + strings(t.dictionary))
        both = np.zeros((len(pieces), 2), np.int64)  # each piece is its head and, perhaps, its marks
        both[:, 0] = at[d.indices.to_numpy(zero_copy_only=False)]
        both[which, 1] = at[len(words) :][t.indices.to_numpy(zero_copy_only=False)]
        ids, bounds = _pick(self.runs.ids, self.runs.bounds, both.reshape(-1))
        return ids, bounds[::2]

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, row offsets); a null text is empty, `end_id` closes each row."""
        texts, whole = compact(texts), np.array([], np.int64)
        if self.spaces:
            uneven = pc.match_substring_regex(texts, UNEVEN)
            whole = np.flatnonzero(uneven.to_numpy(zero_copy_only=False))
            even = pc.if_else(uneven, pa.scalar("", texts.type), texts) if len(whole) else texts
            cut = pc.binary_join_element_wise(pa.scalar("\x1f", texts.type), pc.replace_substring(even, "\n", " \n \x1f"), pa.scalar("", texts.type))
        else:  # one white-space character is as good as another
            cut = pc.replace_substring(texts, "\n", " ")
        parts = pc.split_pattern(cut, " ")
        offsets = parts.offsets.to_numpy().astype(np.int64)
        d = parts.values.dictionary_encode()
        ids, bounds = self._table(d.dictionary)
        more = [np.array([end_id], "<u4")]
        starts = offsets + np.arange(len(offsets))  # with a piece at the end of each row that is the end id
        codes = np.insert(d.indices.to_numpy(zero_copy_only=False), offsets[1:], len(bounds) - 1)
        if len(whole):  # such a row is one piece, and gets the ids of its whole text
            more += [np.array(x, "<u4") for x in self._ids(pc.take(texts, pa.array(whole)).to_pylist())]
            codes[starts[whole]] = len(bounds) + np.arange(len(whole))
        ids, bounds = np.concatenate([ids, *more]), np.concatenate([bounds, bounds[-1] + np.cumsum([len(x) for x in more])])
        out, ends = _pick(ids, bounds, codes)
        return out, ends[starts]


_encoders: dict[tuple, PieceEncoder] = {}


def encoder(path: str, spaces: bool) -> PieceEncoder:
    """The encoder of this worker process; it outlives a task."""
    if (path, spaces) not in _encoders:
        _encoders[path, spaces] = PieceEncoder(path, spaces)
    return _encoders[path, spaces]
