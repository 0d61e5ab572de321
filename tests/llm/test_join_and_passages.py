import collections
import random

import numpy as np
import pytest

from logsift.llm import decontamination as D
from logsift.llm.jaccard_join import components, divide_skip, first_of_each, short_lists, similar_documents

WORDS = [f"w{i}" for i in range(400)]


def shingles(text, k):
    w = [x for x in (text or "").lower().split()]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent):
    sets, top = [shingles(t, k) for _, t in rows], list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                top[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def corpus(seed, n=260):
    draw, rows = random.Random(seed), []
    bases = [[draw.choice(WORDS) for _ in range(draw.randrange(1, 120))] for _ in range(25)]
    for i in range(n):
        b = list(draw.choice(bases[:4] if draw.random() < 0.5 else bases))
        for _ in range(draw.choice([0, 0, 1, 2, 3, 5, 8])):
            b[draw.randrange(len(b))] = draw.choice(WORDS)
        rows.append((i, " ".join(b)))
    return [*rows, (900, ""), (901, None), (902, " \n"), (903, rows[0][1]), (903, rows[0][1])]


@pytest.mark.parametrize("seed,k,percent", [(1, 3, 90), (2, 5, 80), (3, 1, 50)])
def test_same_as_brute_force(spark, seed, k, percent):
    rows = corpus(seed)
    got = similar_documents(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, uid string"), k, percent).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect())) == brute(rows, k, percent)


def test_first_of_each(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "other words in this one here"), (4, ""), (5, None), (2, "a b c d e f")]
    got = first_of_each(spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, n long"), 5, 80)
    assert got.columns == ["doc_id", "text", "n"] and sorted(r.doc_id for r in got.collect()) == [1, 3, 4, 5]


def test_empty_table(spark):
    assert similar_documents(spark.createDataFrame([], "doc_id long, text string"), 3, 90).count() == 0


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80), (1, 50)])
def test_short_lists_hold_all_links(spark, k, percent):
    rows = corpus(7)
    texts = dict((d, t) for d, t in rows)
    found, classes, lists = short_lists(spark.createDataFrame(rows, "doc_id long, text string"), k, percent)
    doc_of = {r.node: r.doc_id for r in classes.collect()}
    by_hash = collections.defaultdict(set)
    for r in lists.collect():
        by_hash[r.hash].add(doc_of[r.uid])
    met = {(x, y) for ids in by_hash.values() for x in ids for y in ids if x < y}
    sets = {d: shingles(texts[d], k) for d in doc_of.values()}
    for x in sets:
        for y in sets:
            n = len(sets[x] & sets[y])
            if x < y and sets[x] != sets[y] and 100 * n >= percent * (len(sets[x]) + len(sets[y]) - n):
                assert (x, y) in met


def test_one_id_with_several_texts_and_clashing_names(spark):
    a, b = "one two three four five six seven", "quite another text that is not like it"
    rows = [(1, a), (5, a), (5, b), (6, b), (None, a), (None, "a text of its own without any id"), (7, b)]
    df = spark.createDataFrame([(i, t, *"xyzuvw") for i, t in rows], "doc_id long, text string, _times string, _stays string, _id string, uid string, comp string, text_hash string")
    got = first_of_each(df, 5, 80)
    assert got.columns == df.columns and sorted((r.doc_id or 0, r.text) for r in got.collect()) == [(0, "a text of its own without any id"), (1, a), (5, b)]


def test_long_texts_and_many_copies(spark):
    draw = random.Random(5)
    long = " ".join(draw.choice(WORDS) for _ in range(300_000))
    group = " ".join(f"g{i}" for i in range(200))
    rows = [(1, long), (2, long + " end"), *((10 + i, group.replace("g7 ", f"x{i} ") if i % 3 else group) for i in range(300))]
    got = {r.doc_id: r.component_id for r in similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()}
    assert got == {1: 1, 2: 1, **{10 + i: 10 for i in range(300)}}


def test_divide_skip():
    draw = np.random.default_rng(3)
    for _ in range(40):
        q = np.unique(draw.integers(0, 60, 30)).astype(np.uint64)
        c = [np.unique(draw.integers(0, 60, draw.integers(0, 40))).astype(np.uint64) for _ in range(30)]
        need = draw.integers(-1, 20, 30).tolist()
        assert sorted(divide_skip(q, c, need)) == [i for i, (x, t) in enumerate(zip(c, need)) if len(np.intersect1d(q, x)) >= t]


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 40), (40, 60), (7, 7)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 40: 40, 60: 40, 100: 40}


def distance(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_alignment_is_exact():
    draw = random.Random(5)
    for _ in range(300):
        item, text = ([draw.randrange(4) for _ in range(draw.randrange(1, n))] for n in (9, 25))
        assert D.best_alignment(item, text)[0] == distance(item, text)


def test_edited_passages_are_found(spark):
    draw = random.Random(7)
    items = [(i, " ".join(draw.choice(WORDS) for _ in range(draw.randrange(5, 60)))) for i in range(40)]
    rows, truth = [], {}
    for n in range(300):
        i, text = draw.choice(items)
        w = text.split()
        for _ in range(draw.randrange(0, D.edits_of(len(w)) + 2)):
            p, what = draw.randrange(len(w)), draw.randrange(3)
            w[p : p + (what > 0)] = ["zz"] if what < 2 else []
        full = [draw.choice(WORDS) for _ in range(draw.randrange(40))] + w + ["yy"] * draw.randrange(30)
        rows.append((n, ", ".join(full).upper()))
        truth.update({(n, j): d for j, t in items if (d := distance(t.split(), full)) <= D.edits_of(len(t.split()))})
    got = {(r.doc_id, r.item_id): r.distance for r in D.find_passages(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) <= set(truth) and len(got) >= 0.99 * len(truth)
    assert all(truth[k] == d for k, d in got.items())


def test_passages_of_odd_rows(spark):
    items = spark.createDataFrame([(1, "one two three four five six"), (2, None), (3, ""), (4, "the")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x ONE, two three\nfour five six!", 0), (2, None, 0), (3, "", 0), (None, "one two three four five six", 0), (5, "the", 0)], "doc_id long, text string, _leaks int")
    assert sorted(((r.doc_id, r.item_id, r.distance) for r in D.find_passages(docs, items).collect()), key=repr) == [(1, 1, 0), (None, 1, 0)]
    clean = D.clean_documents(docs, items)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [2, 3, 5]
    assert D.find_passages(docs, items.where("1 = 0")).count() == 0 and D.find_passages(docs.where("1 = 0"), items).count() == 0


def test_short_items_and_scripts_without_spaces(spark):
    items = spark.createDataFrame([(1, "Why not?"), (2, "what is it"), (3, "首都是哪里"), (4, "富士山"), (5, "สวัสดีชาวโลก"), (6, "one two three four"), (7, "..."), (8, None), (9, "一二三四五六七八九十"), (10, "why NOT")], "item_id long, text string")
    texts = ["so, WHY not; why not", "What is. it?", "what was it", "中国的首都是哪里？", "我看富士山和富士", "เขาพูดว่าสวัสดีชาวโลกครับ", "one two three", "one two three four", "whys", "", None, "前一二三四五X七八九十后", "富士", "山"]
    got = {(r.doc_id, r.item_id): (r.start_word, r.n_words, r.distance) for r in D.find_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), items).collect()}
    assert set(got) == {(0, 1), (0, 10), (1, 2), (3, 3), (4, 4), (5, 5), (7, 6), (11, 9)}, got
    assert got[0, 1] == (1, 2, 0) and got[1, 2] == (0, 3, 0) and got[3, 3] == (3, 5, 0) and got[4, 4] == (2, 3, 0) and got[11, 9][2] <= 2


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(D, "ITEMS", 2)
    items = [(i, f"a{i} b{i} c{i} d{i} e{i}") for i in range(5)]
    docs = spark.createDataFrame([(i, f"x {t} y") for i, t in items], "doc_id long, text string")
    assert D.find_passages(docs, spark.createDataFrame(items, "item_id long, text string")).count() == 5


def test_long_items_ties_and_many_items(spark):
    draw = random.Random(11)
    words = [f"v{i}" for i in range(3000)]
    long = [draw.choice(words) for _ in range(1500)]
    items = [(0, " ".join(long)), (1, " ".join(long[:9])), (2, " ".join(long[:9]))] + [(10 + i, " ".join(draw.choice(words) for _ in range(draw.randrange(5, 40)))) for i in range(800)]
    edited = list(long)
    for _ in range(280):
        at = draw.randrange(len(edited))
        edited[at : at + 1] = draw.choice([[], ["new"], [edited[at], "more"]])
    twice = " ".join(["x", *long[:9], "y", *long[:9]])
    docs = [(0, "before " + " ".join(edited) + " after"), (1, twice), (2, twice), (3, " ".join(draw.choice(words) for _ in range(50_000))), (None, items[5][1]), (5, None), (6, "")]
    got = {(r.doc_id, r.item_id): r for r in D.find_passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert distance(long, edited) <= 300 and (0, 0) in got and got[0, 0].distance == distance(long, ["before", *edited, "after"])
    assert {k for k in got if k[0] in (1, 2)} == {(d, i) for d in (1, 2) for i in (1, 2)} and got[1, 1].start_word == got[1, 2].start_word == 1
    assert (None, items[5][0]) in got and not any(d in (3, 5, 6) for d, _ in got)


def test_counts_of_brute_force_are_not_trivial():
    assert len({c for *_, c in brute(corpus(1), 3, 90)}) < 250 and collections.Counter(t for _, t in corpus(1)).most_common(1)[0][1] > 1
