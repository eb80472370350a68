"""Merges, metadata, compaction, transactions, manifest and the engine."""

import json
import random

import pytest

from siltbed.engine import Closed, Conflict, Engine, Options
from siltbed.functions import bloom, codec, metrics
from siltbed.operators import compaction, merge, pruning, reads, txn
from siltbed.session import read_bytes, write_bytes
from siltbed.sources import manifest as mf
from pyspark.sql import functions as F

LOG = "key string, version bigint, commit_ts bigint, value string, is_deleted boolean, run_id bigint, level int"


def test_merges(spark):
    s = "key string, version bigint, commit_ts bigint, value string"
    new = spark.createDataFrame([("a", 0, 5, "a2"), ("c", 0, 1, None)], s)
    old = spark.createDataFrame([("a", 0, 9, "a1"), ("b", 0, 2, "b1"), ("b", 0, 2, "b1")], s)
    assert {r["key"]: r["value"] for r in merge.k_way([new, old]).collect()} == {"a": "a2", "b": "b1", "c": None}
    assert sorted((r["key"], r["value"] or "") for r in merge.two_way(new, old.distinct()).collect()) == [("a", "a2"), ("b", "b1"), ("c", "")]
    assert merge.concat([new, old]).count() == 5
    assert merge.exact([new, old]).count() == 4
    assert [r["key"] for r in merge.concat_from([new, old], "b").collect()] == ["c", "b", "b"]
    with pytest.raises(ValueError):
        merge.concat([])


def test_blocks(spark):
    log = spark.createDataFrame([(f"key{i:03d}", 0, 100 + i, "v" * (i % 50), False, i // 500, 0) for i in range(1000)], LOG)
    blocks = pruning.packed_blocks(log, 4096).collect()
    assert sum(b["rows"] for b in blocks) == 1000 and all(b["bytes"] <= 4096 for b in blocks)
    big = spark.createDataFrame([("k", 0, 1, "x" * 70000, False, 0, 0), ("l", 0, 1, None, False, 0, 0)], LOG)
    assert [b["rows"] for b in pruning.packed_blocks(big).orderBy("block_no").collect()] == [1, 1]
    assert pruning.too_large(big).count() == 1
    got = spark.createDataFrame([(4096,), (4000,), (8100,), (0,)], "r int").select(pruning.aligned(F.col("r"))).collect()
    assert [r[0] for r in got] == [4096, 4096, 8192, 4096]
    index = pruning.block_index(log, 64, "run_id")
    assert index.agg(F.sum("rows")).first()[0] == 1000
    only = pruning.block_index(log.filter("run_id = 0"), 64)
    assert pruning.find_block(only, "key100").first()[0] == 1
    assert pruning.find_block(only, "zzz").first()[0] is None


def test_codec(spark):
    rows = [("key1", 1, 100), ("", 0, 0), ("käse", 2**62, 2**62), ("a" * 1000, 0, 1)]
    df = spark.createDataFrame(rows, "k string, v bigint, t bigint")
    e = codec.encode_key(F.col("k"), F.col("v"), F.col("t"))
    back = df.select(codec.decode_key(e).alias("d"), F.length(e).alias("n"), F.col("k")).collect()
    assert [(bytes(r["d"]["key"]).decode(), r["d"]["version"], r["d"]["commit_ts"]) for r in back] == rows
    assert all(r["n"] == len(r["k"].encode()) + 16 for r in back)
    short = spark.createDataFrame([(b"abc",)], "e binary").select(codec.decode_key(F.col("e")).alias("d")).first()["d"]
    assert bytes(short["key"]) == b"" and short["version"] == 0

    def poly(b):
        h = 0
        for x in b:
            h = (31 * h + x) % 2**32
        return h

    got = df.select("k", codec.polynomial_hash(F.col("k")).alias("h")).collect()
    assert all(r["h"] == poly(r["k"].encode()) for r in got)
    newer_first = df.select(F.hex(codec.encode_key(F.lit("k"), F.lit(1), F.col("t")))).distinct().count()
    assert newer_first == 4


def test_bloom(spark):
    keys = [f"key{i}".encode() for i in range(2000)] + [b"", b"\x00" * 100]
    f = bloom.build(keys, 0.01)
    assert bloom.contains(keys, *f).all()
    rate = bloom.contains([f"other{i}".encode() for i in range(10000)], *f).mean()
    assert rate <= 0.02
    for n, p, least in ((100, 0.01, 950), (1000, 0.001, 14300), (10000, 0.0001, 190000)):
        assert bloom.plan(n, p)[0] >= least
    assert not bloom.contains([b"x"], *bloom.build([])).any()
    log = spark.createDataFrame([(f"k{i}", i // 10) for i in range(40)], "key string, run_id bigint")
    got = bloom.probe_runs(bloom.run_filters(log), ["k3", "k35"]).filter("maybe").collect()
    assert {("k3", 0), ("k35", 3)} <= {(r["key"], r["run_id"]) for r in got}


def test_pick(spark):
    def due(levels):
        rows = [(lv, 100 * lv + i) for lv, n in levels.items() for i in range(n)]
        got = compaction.pick(spark.createDataFrame(rows, "level int, run_id bigint")).collect()
        return (got[0]["upper_level"], got[0]["lower_level"]) if got else None

    assert due({0: 4}) == (0, 1)
    assert due({0: 3}) is None
    assert due({1: 4}) == (1, 2)
    assert due({1: 3}) is None
    assert due({1: 3, 2: 5}) == (1, 2)
    assert due({1: 3, 2: 6, 3: 12, 4: 24, 5: 48, 6: 96, 7: 192}) is None
    assert due({1: 3, 2: 6}) == (2, 3)
    assert due({2: 5}) == (2, 3)  # an empty level above is no error
    assert due({6: 4}) == (6, 7)


def test_gc_keeps_snapshots(spark):
    rng = random.Random(5)
    rows = [(f"k{rng.randrange(6)}", 0, t, f"v{t}", rng.random() < 0.4, 0, 0) for t in range(1, 120)]
    log = spark.createDataFrame(rows, LOG).cache()
    kept = compaction.drop_old_versions(log, 60).cache()
    assert kept.count() < log.count()
    for at in (60, 61, 90, 119):
        pick = lambda x: sorted((r["key"], r["value"]) for r in reads.snapshot(x, at).collect())  # noqa: B023, E731
        assert pick(kept) == pick(log)


def test_output_files_are_disjoint(spark):
    log = spark.createDataFrame([(f"k{i % 7}" if i % 3 else "hot", 0, i, "v", False, 0, 0) for i in range(600)], LOG)
    files = compaction.output_files(log, 4).groupBy("file_no").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.count("*").alias("n")).orderBy("a", "b").collect()
    assert sum(f["n"] for f in files) == 600
    assert all(x["b"] <= y["a"] for x, y in zip(files, files[1:]))


def test_transactions(spark):
    w = spark.createDataFrame([(1, 1, "a", "x", False), (1, 2, "a", None, True), (2, 1, "a", "y", False), (2, 1, None, "y", False)], "txn_id bigint, seq int, key string, value string, is_deleted boolean")
    got = {(r["txn_id"], r["key"]): (r["value"], r["is_deleted"]) for r in txn.collapse(w).collect()}
    assert got == {(1, "a"): (None, True), (2, "a"): ("y", False)}
    ts = {r["txn_id"]: r["commit_ts"] for r in txn.commit_timestamps(w, 10).collect()}
    assert ts == {1: 11, 2: 12}
    log = spark.createDataFrame([("a", 7)], "key string, commit_ts bigint")
    reads_ = spark.createDataFrame([(1, "a", 6), (2, "a", 7), (3, "b", 0)], "txn_id bigint, key string, read_ts bigint")
    assert [r["txn_id"] for r in txn.conflicts(reads_, log).collect()] == [1]
    h = spark.createDataFrame([(5, [1, 2]), (6, None)], "commit_ts bigint, key_hashes array<bigint>")
    p = spark.createDataFrame([(1, 4, [2]), (2, 5, [2]), (3, 0, [9])], "txn_id bigint, read_ts bigint, key_hashes array<bigint>")
    assert [r["txn_id"] for r in txn.hash_conflicts(h, p).collect()] == [1]
    assert txn.recovered_timestamp(log.limit(0)).first()[0] == 0


def test_manifest_damage(spark, tmp_path):
    folder = f"file://{tmp_path}/m"
    m = mf.ManifestFile(spark, folder)
    m.append(mf.memtable_record(100))
    m.append(mf.flush_record(100))
    m.append(mf.compaction_record(0, [100], 1, [], False, [200, 201]))
    again = mf.ManifestFile(spark, folder)
    assert [r["type"] for r in again.records()] == ["memtable", "flush", "compaction"]
    assert sorted((r["sst_id"], r["level"]) for r in mf.replay(again.table()).collect()) == [(200, 1), (201, 1)]
    # one damaged line is skipped, a side log is applied, an empty manifest falls back to the backup
    text = read_bytes(spark, f"{folder}/MANIFEST").decode()
    write_bytes(spark, f"{folder}/MANIFEST", text.replace('"flushID":100', '"flushID":101').encode())
    write_bytes(spark, f"{folder}/MANIFEST.wal", (mf.line(mf.flush_record(7)) + "\n").encode())
    m = mf.ManifestFile(spark, folder)
    assert [r["type"] for r in m.records()] == ["memtable", "compaction", "flush"]
    write_bytes(spark, f"{folder}/MANIFEST", b"{corrupt\n")
    assert len(mf.ManifestFile(spark, folder).records()) == 3
    m.close()
    with pytest.raises(ValueError):
        m.append(mf.flush_record(9))
    lines = spark.createDataFrame([(x,) for x in (*text.splitlines(), text.splitlines()[0].replace("100", "111"), "", None, "{}", "[1]")], "value string")
    assert mf.parse(lines).count() == 3
    assert json.loads(mf.line({"type": "flush"}))["checksum"] > 0


def test_manifest_compaction(spark, tmp_path):
    m = mf.ManifestFile(spark, f"file://{tmp_path}/m")
    for i in range(1, 9):
        m.append(mf.memtable_record(i))
        if i < 8:
            m.append(mf.flush_record(i))
    m.append(mf.compaction_record(0, [1, 2, 3], 1, [], False, [20, 21, 22]))
    m.append(mf.compaction_record(1, [20], 2, [], False, [30]))
    m.append(mf.compaction_record(1, [21], 2, [30], False, [30, 31]))
    state = lambda: (sorted(tuple(r) for r in mf.replay(m.table()).collect()), [r[0] for r in mf.memtables_to_replay(m.table()).collect()])
    before = state()
    assert m.compact() > 0 and state() == before == ([(4, 0), (5, 0), (6, 0), (7, 0), (22, 1), (30, 2), (31, 2)], [8])
    assert m.compact() == 0
    assert [r["type"] for r in mf.ManifestFile(spark, f"file://{tmp_path}/m").records()] == [r["type"] for r in m.records()]


def test_engine(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    e = Engine(spark, path)
    e.put("a", "1")
    e.put("b", "2")
    e.put("b", "")
    e.delete("a")
    assert e.get("b") == ""
    with pytest.raises(reads.KeyDeleted):
        e.get("a")
    with pytest.raises(reads.KeyNotFound):
        e.get("zz")
    old = e.read_txn()
    t2, t3 = e.write_txn(), e.write_txn()
    t2.put("b", "t2")
    t3.put("b", "t3")
    assert t3.get("b") == ""  # its own writes stay unseen
    t3.commit()
    with pytest.raises(Conflict):
        t2.commit()
    with pytest.raises(Closed):
        t2.put("x", "y")
    assert old.get("b") == "" and e.get("b") == "t3"
    old.rollback()
    with pytest.raises(Closed):
        old.get("b")
    with pytest.raises(ValueError):
        e.put("", "x")
    assert e.flush() == 1
    with pytest.raises(reads.KeyDeleted):
        e.get("a")  # also from a run
    e.put("c", "3")
    # a crash: the log of the memtable is read again
    e = Engine(spark, path)
    assert [(r["key"], r["value"]) for r in e.scan().collect()] == [("b", "t3"), ("c", "3")]
    clock = e.clock
    e.write_batch(spark.createDataFrame([("d", "4"), ("e", "5")], "key string, value string"))
    assert e.clock == clock + 1
    with pytest.raises(ValueError):
        e.write_batch(spark.createDataFrame([(None, "4")], "key string, value string"))
    assert e.compact(full=True) and len(e.meta) == 1
    e.close()
    with pytest.raises(Closed):
        e.get("b")
    e = Engine(spark, path)
    assert [r["key"] for r in e.scan("b", "e").collect()] == ["b", "c", "d"]
    stats = e.stats()
    assert stats["count"]["scan"] == 1 and stats["levels"] == {1: {"runs": 1, "rows": 8}} and stats["active_transactions"] == 0


def test_engine_model(spark, tmp_path):
    """Random puts, deletes, flushes, compactions and restarts against a dictionary."""
    rng = random.Random(11)
    options = Options(keep_versions=False)
    e = Engine(spark, f"file://{tmp_path}/model", options)
    want: dict = {}
    for i in range(60):
        k = f"k{rng.randrange(8)}"
        if rng.random() < 0.3:
            e.delete(k)
            want.pop(k, None)
        else:
            e.put(k, f"v{i}")
            want[k] = f"v{i}"
        if i % 13 == 12:
            e.flush()
        if i == 40:
            e.compact(full=True)
        if i == 50:
            e = Engine(spark, f"file://{tmp_path}/model", options)
    assert {r["key"]: r["value"] for r in e.scan().collect()} == want


def test_histogram(spark):
    df = spark.createDataFrame([(0.0001,), (0.0003,), (9.0,), (None,)], "v double")
    got = {r["le"]: r["n"] for r in metrics.histogram(df, "v").collect()}
    assert got[0.0001] == 1 and got[0.0004] == 2 and got[float("inf")] == 3 and len(got) == 11
    m = metrics.Metrics()
    with pytest.raises(KeyError), m.timed("get"):
        raise KeyError
    assert m.snapshot()["count"] == {"get": 1, "errors": 1}
