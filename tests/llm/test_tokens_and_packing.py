import re
import zlib
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from logsift.llm import token_store
from logsift.llm.crc import shift
from logsift.llm.packing import CapacityTree, pack, plan
from logsift.llm.token_store import LEAST, MOST, cuts, read_digests, read_ids, write_store
from logsift.llm.tokens import BYTE_BPE, WORD_BPE, PieceEncoder

FILES = {WORD_BPE: False, BYTE_BPE: True}
ENCODERS = {f: (PieceEncoder(public_tokenizers.path(f), s), Tokenizer.from_file(public_tokenizers.path(f))) for f, s in FILES.items()}
TEXTS = ["", " ", "  a  b ", "a \n b\n", " x", "x \n\n y\t z ", "don't stop 12 34 ...!", "é è  q  z \x1c y", "a\n b", None, "tail ", "\n", "WORD!! A&&& b's", "ÀÉ ÇA É", "İstanbul ẞ ǅ", "e\u0301 x", "<|endoftext|> a", "日本 語。", "a\u00a0b", "x" * 3000]


def same(file, texts):
    enc, tok = ENCODERS[file]
    ids, off = enc.encode(pa.array(texts, pa.string()), 7)
    for i, t in enumerate(texts):
        assert ids[off[i] : off[i + 1]].tolist() == [*tok.encode(t or "", add_special_tokens=False).ids, 7], (file, t)


@pytest.mark.parametrize("file", FILES)
def test_known_texts(file):
    same(file, TEXTS)
    enc, _ = ENCODERS[file]
    whole, _ = enc.encode(pa.array(TEXTS, pa.string()), 7)
    cut, off = enc.encode(pa.array(TEXTS, pa.string()).slice(5, 9), 7)  # a slice reads its own rows
    assert cut.tolist() == enc.encode(pa.array(TEXTS[5:14], pa.string()), 7)[0].tolist()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abT'é.,!?\n\t 12&<|İ") + ["\u0301"]), max_size=30), max_size=5))
def test_any_text(texts):
    for file in FILES:
        same(file, texts)


def test_small_caches_forget_and_learn_again():
    enc, tok = PieceEncoder(public_tokenizers.path(WORD_BPE), False, max_cached=3), ENCODERS[WORD_BPE][1]
    for text in ("one two three four five", "six seven one eight", "one two nine"):
        assert enc.encode(pa.array([text]), 1)[0].tolist() == [*tok.encode(text, add_special_tokens=False).ids, 1]


class OnlyOddPieces:
    """A tokenizer that refuses runs of common letters, which are to be encoded without the rules."""

    def __init__(self, tok):
        self.tok = tok

    def _seen(self, texts):
        assert not [w for t in texts for w in t.split() if re.fullmatch("[A-Za-zÀ-ÖØ-öø-įı-ſЀ-џ]+", w)]
        return texts

    def encode_batch(self, texts, **kw):
        return self.tok.encode_batch(self._seen(texts), **kw)

    def encode_batch_fast(self, texts, **kw):
        return self.tok.encode_batch_fast(self._seen(texts), **kw)


def test_words_of_common_letters_skip_the_rules():
    letters = [chr(c) for c in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x180), *range(0x400, 0x460)) if c not in (0xD7, 0xF7, 0x130)]
    words = [*letters, *(f"a{x}B" for x in letters), *(f"{x}é{x}," for x in letters), "École", "GRÖSSE", "Straße!?", "Привет", "wordÀÉ" * 40]
    enc, tok = PieceEncoder(public_tokenizers.path(WORD_BPE), False), ENCODERS[WORD_BPE][1]
    enc.tok = OnlyOddPieces(enc.tok)
    texts = [" ".join(words), *words, "日本 x1 e\u0301"]
    ids, off = enc.encode(pa.array(texts), 1)
    for i, t in enumerate(texts):
        assert ids[off[i] : off[i + 1]].tolist() == [*tok.encode(t, add_special_tokens=False).ids, 1], t


def test_a_map_task_writes_a_chunk_once(monkeypatch):
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: SimpleNamespace(partitionId=lambda: 3))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["some words " * 300, "other words " * 300]})
    run = token_store._stage(public_tokenizers.path(WORD_BPE), False, 1)
    rows = [r for b in run([batch, batch, batch]) for r in b.to_pylist()]
    keys = [(r["kind"], r["key"]) for r in rows if r["kind"] < 2]
    assert len(keys) == len(set(keys))
    assert len([r for r in rows if r["kind"] == 2]) == len({r["uid"] for r in rows if r["kind"] == 2}) == 6
    monkeypatch.setattr(token_store, "MOST_SEEN", 0)  # what is forgotten is written again, and nothing is lost
    again = [(r["kind"], r["key"]) for b in run([batch, batch, batch]) for r in b.to_pylist() if r["kind"] < 2]
    assert set(again) == set(keys) and len(again) == 3 * len(keys)


@given(st.binary(max_size=50), st.binary(max_size=300))
def test_crc_of_joined_parts(a, b):
    assert int(shift(np.array([zlib.crc32(a)], np.uint32), np.array([len(b)]))[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_cuts_keep_bounds_and_meet_again():
    draw = np.random.default_rng(1)
    ids = draw.integers(0, 40_000, 20_000).astype(np.uint32)
    ends = cuts(ids, np.array([0, len(ids)]))
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(ids) and sizes.max() <= MOST and sizes[:-1].min() >= LEAST
    moved = cuts(np.concatenate([ids[:50], ids]), np.array([0, len(ids) + 50]))
    assert len(set(ends.tolist()) & set((moved - 50).tolist())) > 0.8 * len(ends)


DOCS = [(5, "hello world " * 80), (1, None), (None, "no id"), (3, ""), (5, "hello world " * 80), (2, "hello world " * 80 + "tail"), (9, "x" * 5000)]


def test_store_round_trip(spark):
    docs = spark.createDataFrame([(*d, "clash") for d in DOCS], "doc_id long, text string, uid string")
    store = write_store(docs, public_tokenizers.path(WORD_BPE), end_id=1)
    tok = ENCODERS[WORD_BPE][1]
    expected, start = [], 0
    for i, t in sorted(DOCS, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = read_digests(spark, store).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected
    whole = sorted(((r.doc_id, r.ids) for r in read_ids(spark, store).collect()), key=repr)
    assert whole == sorted(((i, [*tok.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in DOCS), key=repr)
    chunks = spark.read.parquet(f"{store}/staged").where("kind = 0")
    assert chunks.count() == chunks.select("key").distinct().count()


def test_damage_is_found(spark):
    store = write_store(spark.createDataFrame(DOCS, "doc_id long, text string"), public_tokenizers.path(WORD_BPE), end_id=1)
    rows = spark.read.parquet(f"{store}/staged").where("kind = 0").drop("kind").selectExpr("key", "uid", "doc_id", "n", "reverse(hex(payload)) as p", "payload").selectExpr("key", "uid", "doc_id", "n", "unhex(p) as payload")
    broken = rows.collect()
    spark.createDataFrame(broken, rows.schema).write.mode("overwrite").parquet(f"{store}/staged/kind=0")
    with pytest.raises(Exception, match="damaged"):
        read_digests(spark, store).collect()


def test_lost_shards_and_chunks_are_found(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text number {i} " * 30) for i in range(200)], "doc_id long, text string").repartition(4)
    for folder, kept in (("documents", ""), ("staged/kind=0", "")):
        store = write_store(docs, public_tokenizers.path(WORD_BPE), end_id=1)
        assert read_digests(spark, store).count() == read_ids(spark, store).count() == 200
        files = sorted(Path(store.removeprefix("file://")).glob(f"{folder}/part-*"), key=lambda f: -f.stat().st_size)
        files[0].unlink()
        for read in (read_digests, read_ids):
            with pytest.raises(Exception, match="shards|missing|match"):
                read(spark, store).collect()


def test_every_piece_has_its_place(spark):
    draw = np.random.default_rng(2)
    docs = [(int(i), " ".join(draw.choice(["a", "word", "Größe", "x1", "?!"], draw.integers(0, 900)))) for i in range(150)]
    rows = pack(spark.createDataFrame(docs, "doc_id long, text string"), public_tokenizers.path(BYTE_BPE), end_id=2).collect()
    tokenizer, sequences = Tokenizer.from_file(public_tokenizers.path(BYTE_BPE)), {}
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for i, t in docs}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) == best_fit([r.length for r in rows], 1024)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert read_digests(spark, write_store(docs, public_tokenizers.path(WORD_BPE), end_id=1)).count() == 0
    assert pack(docs, public_tokenizers.path(BYTE_BPE), end_id=2).count() == 0


def best_fit(lengths, size):
    import bisect

    rooms, bins = [], 0
    for n in sorted(lengths, reverse=True):
        k = bisect.bisect_left(rooms, n)
        if k == len(rooms):
            bins += 1
            bisect.insort(rooms, size - n)
        else:
            bisect.insort(rooms, rooms.pop(k) - n)
    return bins


@settings(deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plan_is_best_fit_decreasing(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    bins: dict[int, list] = {}
    runs = sorted(plan(counts, 40))
    for k, (n, rank, first, offset) in enumerate(runs):
        end = runs[k + 1][1] if k + 1 < len(runs) and runs[k + 1][0] == n else counts[n]
        for i in range(end - rank):
            bins.setdefault(first + i, []).append((offset, n))
    assert sorted(n for b in bins.values() for _, n in b) == sorted(lengths)
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 40
    assert len(bins) == best_fit(lengths, 40)


def test_tree_finds_the_tightest():
    t = CapacityTree(1024)
    for c in (3, 700, 1024):
        t.add(c, 1)
    assert [t.tightest(x) for x in (1, 3, 4, 700, 701, 1024)] == [3, 3, 700, 700, 1024, 1024]
    t.add(1024, -1)
    assert t.tightest(701) is None


def test_pieces_of_long_documents(spark):
    rows = pack(spark.createDataFrame([(1, "word " * 3000), (2, None), (2, None)], "doc_id long, text string"), public_tokenizers.path(BYTE_BPE), end_id=2).collect()
    long = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == 1)
    assert all(n == 1024 for _, _, n in long[1:]) and long[0][2] <= 1024 and sum(n for *_, n in long) == long[-1][1] + 1024
    assert sum(r.doc_id == 2 and r.length == 1 for r in rows) == 2
