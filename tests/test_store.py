import json
import os
import time

import pytest

from logsift.operators import layout as L
from logsift.operators.search import search
from logsift.plans.store import LogStore
from logsift.sources import ingest
from logsift.streaming.flush import envelope_stream, flush_stream

ROWS = [(t, json.dumps({"severity_text": "ERROR" if t % 5 == 0 else "INFO", "body": f"line {t} word{t}", "resource": {"service.name": f"svc-{t % 3}"}})) for t in range(1, 41)]
QUERIES = [{}, {"term": "word7"}, {"term": "ord1"}, {"start": 10, "end": 20}, {"q": '{"labels":[{"l":"level","op":"eq","v":"ERROR"}]}'}, {"q": '{"labels":[{"l":"service_name","op":"eq","v":"svc-2"},{"l":"none","op":"eq","v":""}]}'}, {"q": '{"line":[{"op":"|~","v":"line 1.? "}],"labels":[{"l":"level","op":"re","v":"IN.*"}]}'}]


@pytest.fixture
def store(spark, tmp_path):
    return LogStore(spark, f"file://{tmp_path}/store")


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "timestamp long, data string")


def got(df):
    return sorted(map(tuple, df.collect()))


def test_results_do_not_depend_on_layout(spark, store, rows):
    for k in range(5):
        store.append(rows.where(f"timestamp % 5 = {k}"), str(k), index=k != 4)
    expected = [got(search(rows, **q)) for q in QUERIES]
    check = lambda: [got(store.search(**q, use_index=i).rows) for q in QUERIES for i in (True, False)]
    twice = [x for x in expected for _ in range(2)]
    assert check() == twice
    assert store.reindex() == ["b-4"]
    assert check() == twice
    made = store.compact()
    assert [(p.level, p.count, p.min_timestamp) for p in made] == [(1, 32, 1)]
    assert check() == twice
    assert len(store.compact(force=True)) == 1
    assert check() == twice


def test_batches_are_written_once(store, rows):
    a = store.append(rows, "x")
    assert store.append(rows, "x") == a and len(store.parts()) == 1
    assert store.append(rows.where("1 = 0"), "y") is None and len(store.log()) == 1


def test_stats_and_pruning(store, rows):
    store.append(rows.where("timestamp <= 20"), "a")
    store.append(rows.where("timestamp > 20"), "b")
    r = store.search(start=5, end=9)
    assert len(r.rows.collect()) == 5
    s = r.finished()
    assert (s.parts_total, s.parts_pruned_by_ts, s.parts_scanned, s.entries_matched) == (2, 1, 1, 5)
    r = store.search(q='{"labels":[{"l":"body","op":"eq","v":"line 3 word3"}]}')
    assert got(r.rows) == [ROWS[2]] and r.stats.used_index and r.stats.parts_pruned_by_index == 1
    body = json.loads("".join(store.search(term="word40").to_json()))
    assert [d["timestamp"] for d in body["data"]] == [40] and body["stats"]["entries_matched"] == 1
    assert got(LogStore(store.spark, store.root + "-none").search().rows) == []


def test_vacuum(store, rows):
    for k in range(4):
        store.append(rows.where(f"timestamp % 4 = {k}"), str(k))
    store.compact()
    assert store.vacuum() == []
    gone = store.vacuum(age=0, now=time.time() + 60)
    assert len(gone) == 8 and got(store.search().rows) == got(rows)


def test_merged_parts_stay_away(spark):
    log = spark.createDataFrame([(0, "PUT", "old-1", []), (1, "PUT", "old-2", []), (2, "MERGE", "m", ["old-1", "old-2"]), (4, "PUT", "new", [])], "index long, op string, part_id string, old_parts array<string>")
    assert {r.part_id for r in L.active_parts(log).collect()} == {"m", "new"}
    assert [r["after"] for r in L.log_gaps(log).collect()] == [2]


def test_sparse(spark):
    e = spark.range(100).selectExpr("1 as part", "id as timestamp")
    s = L.sparse_samples(e, "part")
    assert sorted(r.idx for r in s.collect()) == [0, 32, 64, 96]
    at = lambda a, b: tuple(L.sparse_range(s, "part", a, b).first())[1:]
    assert at(40, 50) == (32, 64) and at(0, 99) == (0, L.OPEN_END)


def test_stream_restarts_without_loss(spark, store, tmp_path):
    (tmp_path / "in").mkdir()
    run = lambda: flush_stream(envelope_stream(spark, f"file://{tmp_path}/in"), store, f"file://{tmp_path}/ckpt", once=True).awaitTermination()
    (tmp_path / "in/a.json").write_text('{"data":[{"timestamp":2,"data":"x"},{"timestamp":1,"data":"y"}]}')
    run()
    (tmp_path / "in/b.json").write_text('{"data":[{"timestamp":0,"data":"late"}]}')
    run()
    run()
    assert got(store.search().rows) == [(0, "late"), (1, "y"), (2, "x")]
    assert {p.part_id for p in store.parts()} == {"b-s-0", "b-s-1"}


def test_wal_and_blocks(spark, tmp_path):
    (tmp_path / "w.ndjson").write_text('{"timestamp":1,"data":"a"}\n{"timestamp":2,"da\n\n{"timestamp":3,"data":"c"}\n')
    assert got(ingest.read_wal(spark, str(tmp_path / "w.ndjson"))) == [(1, "a"), (3, "c")]
    df = spark.createDataFrame([(1, "a")], "timestamp long, data string")
    for codec in ("none", "gzip"):
        ingest.write_blocks(df, str(tmp_path / codec), codec)
        assert got(ingest.read_wal(spark, str(tmp_path / codec))) == [(1, "a")]
    with pytest.raises(ValueError):
        ingest.write_blocks(df, str(tmp_path / "z"), "lz9")


def test_torn_entries_and_running_writes(spark, store, rows, tmp_path):
    store.append(rows.where("timestamp <= 20"), "a")
    log = tmp_path / "store/log"
    (log / f"{1:016d}.json").write_text("")  # a writer died
    (log / ".aside").write_text("{")
    store.append(rows.where("timestamp > 20"), "b")
    assert got(store.search().rows) == ROWS and [e["index"] for e in store.log()] == [0, 2]
    running = tmp_path / "store/parts/b-running"
    (running / "_temporary").mkdir(parents=True)
    (running / "_temporary/part-0").write_text("x")
    old = time.time() - 1000
    for f in (running, running / "_temporary"):
        os.utime(f, (old, old))
    assert store.vacuum() == []  # something in it is new
    os.utime(running / "_temporary/part-0", (old, old))
    assert store.vacuum() == ["parts/b-running"]


def test_two_writers_take_different_entries(spark, store, rows):
    other = LogStore(spark, store.root)
    store._append("PUT", part={"part_id": "x"}, old_parts=[])
    seen = other._entries
    other._entries = lambda: seen()[:-1]  # it has listed the log before the first entry came
    with pytest.raises(RuntimeError):
        other._append("PUT", part={"part_id": "y"}, old_parts=[])
    assert [e["part"]["part_id"] for e in store.log()] == ["x"]


def test_snapshots_and_truncation(spark, store, rows, monkeypatch):
    monkeypatch.setattr("logsift.plans.store.SNAPSHOT_EVERY", 3)
    for k in range(5):
        store.append(rows.where(f"timestamp % 5 = {k}"), str(k))
    store.compact()
    before = store.parts()
    assert store._snapshot() >= 2 and store.truncate_log(pointer=1) == 1 and store.truncate_log() > 0
    assert store.parts() == before and got(store.search().rows) == ROWS
    assert store.append(rows.where("timestamp % 5 = 1"), "1") and store.parts() == before  # a batch of a part that was merged
    store.snapshot()
    store.truncate_log()
    assert store.log() == [] and store.parts() == before and got(store.search(term="word7").rows) == [ROWS[6]]
    r = store.search(term="no such thing")
    assert r.rows.count() == 0 and r.stats.parts_scanned == 0 and r.stats.parts_pruned_by_index == len(before)
    store.append(spark.createDataFrame([(99, "late")], "timestamp long, data string"), "z")
    assert len(store.parts()) == len(before) + 1


def test_terms_skip_parts(store, rows, spark):
    store.append(rows.where("timestamp <= 20"), "a")
    store.append(rows.where("timestamp > 20"), "b")
    for term, scanned in (("word40", 1), ("ORD4", 2), ("xyzzy", 0), ("w", 2), ("É", 2), ("", 2)):
        r = store.search(term=term)
        assert got(r.rows) == got(search(rows, term=term)) and r.stats.parts_scanned == scanned, term
    r = store.search(q='{"line":[{"op":"eq","v":"word33"}]}')
    assert got(r.rows) == [ROWS[32]] and r.stats.parts_scanned == 1
    r = store.search(term="word7", token_gate=True)
    assert got(r.rows) == [ROWS[6]]
    r = store.search(term="ord7", token_gate=True)  # no whole token
    assert got(r.rows) == [] and r.stats.parts_scanned == 0
    r = store.search(q='{"labels":[{"l":"service_name","op":"eq","v":"none"}]}')
    assert got(r.rows) == [] and r.stats.parts_scanned == 0
    assert list(r.stats.to_json()) == "parts_total parts_pruned_by_ts parts_pruned_by_index parts_scanned blocks_total blocks_pruned_by_ts blocks_pruned_by_index blocks_scanned entries_scanned entries_matched used_index duration_ms".split()
    hot = spark.createDataFrame([(7, "hot word7"), (8, "hot")], "timestamp long, data string")
    assert got(store.search(term="word7", hot=hot).rows) == sorted([ROWS[6], (7, "hot word7")])


def test_non_ascii_terms_are_found_in_parts(store, spark):
    store.append(spark.createDataFrame([(1, "Größe ÉCOLE é"), (2, "xx"), (3, "")], "timestamp long, data string"), "a")
    for term in ("größe", "GRÖßE", "É", "école", "cole é", "ÉCOLE"):
        assert got(store.search(term=term).rows) == got(store.search(term=term, use_index=False).rows), term


def test_token_cap(store, spark, rows):
    many = spark.range(10_050).selectExpr("id as timestamp", "concat('t', id) as data")
    store.append(many, "many")
    store.append(rows, "few")
    assert store.search(term="t7", token_gate=True).stats.parts_scanned == 1
    assert len(store.search(term="ord7", token_gate=True, use_index=False).rows.collect()) == 0
    assert store.search(term="line", token_gate=True, use_index=False).stats.parts_scanned == 2  # the cut set never prunes
    store.compact(force=True)
    assert store.search(term="nothing", token_gate=True, use_index=False).stats.parts_scanned == 1


def test_index_compaction(store, rows):
    for k in range(4):
        store.append(rows.where(f"timestamp % 4 = {k}"), str(k))
    store.compact()
    store.append(rows.where("timestamp = 9"), "more")
    index = store.compact_index()
    assert {p.index_id for p in store.parts()} == {index} and store.compact_index() is None
    posted = store._postings_of(store.parts())
    assert {r.data_id for r in posted.select("data_id").distinct().collect()} == {p.part_id for p in store.parts()}
    r = store.search(q='{"labels":[{"l":"body","op":"eq","v":"line 9 word9"}]}')
    assert got(r.rows) == [ROWS[8], ROWS[8]] and r.stats.parts_scanned == 2
    assert len([g for g in store.vacuum(age=0, now=time.time() + 60) if g.startswith("postings/")]) == 6


def test_damaged_parts_are_found(store, rows, tmp_path, spark):
    for k in range(4):
        store.append(rows.where(f"timestamp % 4 = {k}"), str(k))
    assert store.verify() == {}
    rows.where("timestamp = 4").select("timestamp", "data").write.mode("overwrite").parquet(f"{store.root}/parts/b-0")
    for f in (tmp_path / "store/parts/b-1").glob("*part-*"):
        f.unlink() if f.name.endswith(".crc") else f.write_bytes(b"PAR1 no")
    assert set(store.verify()) == {"b-0", "b-1"}
    with pytest.raises(Exception):
        store.compact()
    assert len(store.parts()) == 4
    with pytest.raises(ValueError, match="empty block"):
        store.ingest(rows.where("1 = 0"), "none")


def test_shared_folder_is_needed_on_a_cluster():
    from types import SimpleNamespace

    from logsift.session import checkpoint_root

    conf = SimpleNamespace(get=lambda k, d=None: d)
    with pytest.raises(ValueError, match="checkpoint.dir"):
        checkpoint_root(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://h:1")))
