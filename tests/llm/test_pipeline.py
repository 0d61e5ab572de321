import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as c
from logsift.llm import queries
from logsift.llm.tokens import BYTE_BPE
from logsift.session import shared_dir
from tests.llm.test_join_and_passages import brute, distance, shingles
from tests.llm.test_tokens_and_packing import best_fit

SF = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, _toxicity string, _leaks int, n_entities long, `row` string, uid string"


def test_stages(spark):
    docs = raw = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for name, stage in c.STAGES:
        path = shared_dir(spark, f"test-{name}")
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == raw.columns
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append({r[0] for r in docs.select("doc_id").collect()})
    assert kept[0] >= kept[1] >= kept[2] == kept[3] == kept[4] and len(kept[4]) > 100
    assert c.run(spark, SF).count() == docs.count()


@pytest.fixture(scope="module")
def fixture(spark, tmp_path_factory):
    """Documents of all odd kinds, with toxic ones, copies, passages and addresses among them."""
    at, draw = tmp_path_factory.mktemp("sf"), random.Random(3)
    words = [f"{a}{b}{d}" for a in "bdfglmnprst" for b in "aeiou" for d in "ckmnrst"]
    text = lambda n: " ".join(draw.choice(words) for _ in range(n))
    items = [(i, text(draw.randrange(8, 30))) for i in range(12)] + [(90, None), (91, ""), (92, "one")]
    rows, labels = [], []
    for i in range(330):
        t = text(draw.randrange(3, 60))
        toxic = i % 5 == 0
        if toxic:
            t = f"{t} vilegrub {draw.choice(['you vilegrub', 'v1legrub', 'v i l e g r u b'])} {text(4)}"
        elif i % 7 == 1:
            w = items[i % 12][1].split()
            w[3:4] = draw.choice([[], ["other"], [w[3]]])
            t = f"{t} {' '.join(w)} {text(5)}"
        elif i % 7 == 2:
            t = f"{t} write to {draw.choice(words)}{i}@mail.{draw.choice(words)}.com or Mr. Hans Keller"
        rows.append((i, t))
        if i % 4:
            labels.append((i, int(toxic)))
    rows += [(1000 + i, t if i % 2 else t + " once more") for i, t in rows[1:200:6]]
    rows += [rows[3], rows[3], (None, text(9)), (None, None), (2000, None), (2001, ""), (2001, " \n"), (2002, text(9000)), (3, text(12)), (2003, "?")]
    n = lambda t: None if t is None else len(t)
    full = [(i, t, "en", "s", n(t), "x", 1, 5, "r", "u") for i, t in rows]
    spark.createDataFrame(full, DOCUMENTS).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels + [(None, 1), (7, None)], "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), rows, items


def test_stages_equal_brute_force(spark, fixture):
    sf_dir, rows, items = fixture
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[1] is None)
    seen = sorted(rows, key=key)
    for name, stage in c.STAGES[:-1]:
        path = shared_dir(spark, f"brute-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.dtypes == spark.read.parquet(f"{sf_dir}/documents.parquet").dtypes, name
        got = sorted(((r.doc_id, r.text) for r in docs.collect()), key=key)
        if name == "toxicity":
            assert got == [r for r in seen if "legrub" not in (r[1] or "").replace(" ", "").replace("1", "i")]
        elif name == "jaccard_join":
            with_ids = [(i, *r) for i, r in enumerate(sorted(seen, key=lambda r: (r[0] is None, r[0] or 0)))]
            groups = {i: g for i, _, g in brute([(i, t) for i, _, t in with_ids], 5, 80)}
            kept = sorted(((d, t) for i, d, t in with_ids if groups[i] == i or not shingles(t, 5)), key=key)
            assert [r[0] for r in got] == [r[0] for r in kept] and {r for r in got if rows.count(r) < 2 and r[0] is not None} == {r for r in kept if rows.count(r) < 2 and r[0] is not None}
            assert any(groups[i] != i for i, *_ in with_ids)
        elif name == "decontamination":
            split = [w for _, t in items if len(w := (t or "").split()) > 1]
            leaks = lambda t: any(distance(w, (t or "").lower().split()) <= len(w) // 5 for w in split)
            assert got == [r for r in seen if not leaks(r[1])] and len(got) < len(seen)
        else:
            assert [r[0] for r in got] == [r[0] for r in seen] and not any("@mail." in (t or "") or "Keller" in (t or "") for _, t in got)
            plain = [r for r in seen if not any(x in (r[1] or "") for x in ("@", "Hans", "Keller"))]
            assert set(plain) <= set(got)
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in docs.collect())
        seen = got
    tokenizer = Tokenizer.from_file(public_tokenizers.path(BYTE_BPE))
    pieces = [min(1024, n - a) for _, t in seen for n in [len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1] for a in range(0, n, 1024)]
    packed = c.run(spark, sf_dir).collect()
    assert sorted(r.length for r in packed) == sorted(pieces) and len({r.sequence_id for r in packed}) == best_fit(pieces, 1024)


def test_stages_of_an_empty_table(spark, fixture, tmp_path):
    sf_dir, *_ = fixture
    for table in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").where("1 = 0").write.parquet(f"{tmp_path}/{table}.parquet")
    assert c.run(spark, str(tmp_path)).count() == 0


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    scored = queries.QUERIES["op10_toxicity"](spark, sf).where("held_out")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = np.array([(r.predicted, r.toxic) for r in scored.join(labels, "doc_id").collect()])
    toxic, clean = rows[rows[:, 1] == 1, 0], rows[rows[:, 1] == 0, 0]
    assert len(toxic) > 50 and toxic.mean() >= 0.9 and clean.mean() <= 0.01


def test_queries_return_a_row_for_each_document(spark):
    ids = sorted(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
    for name in ("op1_token_store", "op2_lm_scoring", "op4_pii_surrogates", "op7_media_columns", "op9_jaccard_join", "op10_toxicity"):
        assert sorted(r.doc_id for r in queries.QUERIES[name](spark, SF).select("doc_id").collect()) == ids, name
