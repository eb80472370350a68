"""The operators of the general problems: against brute force, and on nulls, ties, repeats, empty and clashing tables."""

import random
from collections import Counter, defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from siltbed.operators import consolidate, incremental
from siltbed.operators.change_store import ChangeStore, apply_changes, newest
from siltbed.operators.heavy_keys import aggregate_by_key, heavy_hitters, previous_by_key, versions_not_rising
from siltbed.operators.incremental import IncrementalTable, covered_to, fingerprints, pending_changes

CHANGES = "log_id bigint, key string, commit_ts bigint, mod_revision bigint, is_deleted boolean, value string"


def random_changes(rng, n):
    rows = []
    for i in range(n):
        key = rng.choice(["hot", "hot", "a", "b", "ключ", " a", "", None])
        m = rng.randrange(40)
        rows.append((key, m % 9, m, None if m % 5 == 0 else m % 3 == 0, f"v{m}" if m % 4 else None))
    return [(i, *r) for i, r in enumerate(rows)]


def model_state(rows):
    best = {}
    for _, k, ts, m, d, v in rows:
        if k and (k not in best or (ts, m) > best[k][:2]):
            best[k] = (ts, m, d, v)
    return {k: (b[0], b[1], b[3]) for k, b in best.items() if not b[2]}


def state_of(df):
    return {r["key"]: (r["commit_ts"], r["mod_revision"], r["value"]) for r in df.collect()}


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_changes_any_batches(spark, batches):
    rows = random_changes(random.Random(batches), 120)
    df = spark.createDataFrame(rows, CHANGES)
    assert state_of(apply_changes(df, "log_id", batches=batches)) == model_state(rows)


def test_change_store(spark, tmp_path):
    rows = random_changes(random.Random(9), 150)
    df = spark.createDataFrame(rows, CHANGES).drop("log_id")
    path = f"file://{tmp_path}/store"
    s = ChangeStore(spark, path, buckets=3)
    with pytest.raises(ValueError):
        s.read()
    parts = df.randomSplit([1.0] * 5, 4)
    for i, p in enumerate(parts):
        s.append(p, batch_id=str(i))
    assert s.append(parts[0], batch_id="0") == -1
    assert len(s.runs()) == 5
    assert state_of(s.read()) == model_state(rows)
    s = ChangeStore(spark, path)  # another session finds the runs by the manifest
    assert s.buckets == 3 and state_of(s.read()) == model_state(rows)
    assert s.compact() and len(s.runs()) == 1 and not s.compact()
    s.append(df.limit(0))
    assert state_of(s.read()) == model_state(rows)


def test_late_put_after_compaction(spark, tmp_path):
    rows = [(0, "k", 1, 1, False, "old"), (1, "k", 2, 2, True, None), (2, "j", 1, 3, False, "j"), (3, "k", 1, 1, False, "old")]
    df = spark.createDataFrame(rows, CHANGES)
    assert state_of(apply_changes(df, "log_id")) == model_state(rows) == {"j": (1, 3, "j")}
    s = ChangeStore(spark, f"file://{tmp_path}/late", buckets=2, trigger=2)
    for i in range(3):
        s.append(df.filter(F.col("log_id") == i).drop("log_id"))
        s.compact()
    s.append(df.filter("log_id = 3").drop("log_id"))
    assert len(s.runs()) == 2 and state_of(s.read()) == model_state(rows)


def test_changes_edge(spark):
    assert apply_changes(spark.createDataFrame([], CHANGES), "log_id").count() == 0
    clash = spark.createDataFrame(
        [(1, "k", 1, 1, False, "x", {"a": 1}, 7), (2, "k", 2, 1, True, "y", None, 8), (None, "j", None, None, None, None, {}, None)],
        "log_id bigint, key string, commit_ts bigint, mod_revision bigint, is_deleted boolean, run_id string, `odd name` map<string,int>, bucket int",
    )
    got = apply_changes(clash, "log_id").collect()
    assert [(r["key"], r["run_id"], r["odd name"]) for r in got] == [("j", None, {})]
    ties = spark.createDataFrame([("k", 1, "a"), ("k", 1, "b"), ("k", None, "z")], "key string, t bigint, v string")
    assert newest(ties, "key", ["t"]).first()["v"] == "b"


def test_heavy_keys(spark):
    rng = random.Random(2)
    rows = []
    for i in range(4000):
        key = rng.choice(["hot"] * 10 + ["warm"] * 3 + [f"k{rng.randrange(300)}", "", None])
        m = rng.randrange(3000)
        rows.append((key, m % 700 if m % 50 else None, m, None if m % 17 == 0 else (m * 7919) % 101))
    df = spark.createDataFrame(rows, "key string, commit_ts bigint, mod_revision bigint, version bigint").cache()
    by = defaultdict(set)
    for k, t, m, v in rows:
        if k and v is not None:
            by[k].add((t if t is not None else -1, m, v))
    want = set()
    for k, c in by.items():
        c = sorted(c)
        want |= {(k, y[1]) for x, y in zip(c, c[1:]) if y[2] <= x[2]}
    for params in ({}, {"heavy_share": 4, "slice_rows": 100}, {"heavy_share": 1000, "slice_rows": 11}, {"heavy_share": 3, "slice_rows": 2}):
        got = [tuple(r) for r in versions_not_rising(df, **params).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert {k for k, _ in heavy_hitters(df, "key", 4)} == {"hot"}
    counts = aggregate_by_key(df, "key", [F.count("*").alias("n")], [F.sum("n").alias("n")], heavy_share=5)
    assert {r["key"]: r["n"] for r in counts.collect()} == Counter(k for k, *_ in rows if k)


def test_heavy_keys_edge(spark):
    s = "key string, commit_ts bigint, mod_revision bigint, version bigint, prev int, slice int, bounds string"
    empty = spark.createDataFrame([], s)
    assert versions_not_rising(empty).count() == 0 and aggregate_by_key(empty, "key", [F.count("*").alias("n")], [F.sum("n").alias("n")]).count() == 0
    one = spark.createDataFrame([("k", 1, 1, 5, 9, 9, "b"), ("k", 1, 1, 5, 9, 9, "b"), ("k", 1, 2, 5, 9, 9, None)], s)
    got = previous_by_key(one, "key", ["commit_ts", "mod_revision"], "version", heavy_share=1).orderBy("mod_revision").collect()
    assert [(r["prev"], r["slice"], r["bounds"]) for r in got] == [(None, 9, "b"), (5, 9, None)]


def test_covered(spark):
    rng = random.Random(4)
    ranges = [(a := rng.randrange(300), a + rng.choice([0, 1, 5, 200, -3]), rng.randrange(1000)) for _ in range(80)] + [(None, 5, 9999)]
    points = sorted({rng.randrange(-5, 520) for _ in range(200)})
    p = spark.createDataFrame([(x,) for x in points] + [(None,)], "p bigint")
    got = {r["p"]: r["upto"] for r in covered_to(p, "p", spark.createDataFrame(ranges, "a bigint, b bigint, v bigint"), "a", "b", "v").collect()}
    want = {x: max(v) for x in points if (v := [v for a, b, v in ranges if a is not None and a <= x <= b])}
    assert got == want
    assert covered_to(p, "p", spark.createDataFrame([], "a bigint, b bigint, v bigint"), "a", "b", "v").count() == 0


def test_pending(spark):
    rng = random.Random(6)
    log = [(rng.choice(["hot", "a", "b", "", None]), rng.randrange(60), rng.randrange(1, 40)) for _ in range(600)]
    reports = []
    for run in range(12):
        a = rng.randrange(1, 40)
        for k in range(3):
            reports.append((len(reports), run, a, a + run % 4, 10 * run % 60, rng.choice(["running", "succeeded", "failed", "rolled_back", None]), k if k < 2 else 1))
    out = {}
    for rid, run, a, b, to, st, at in reports:
        out[run] = max(out.get(run, (-1,)), (at, rid, st, a, b, to))
    good = [(a, b, to) for _, _, st, a, b, to in out.values() if st == "succeeded"]
    done = {(k, m) for k, m, t in log if any(a <= t <= b and m <= to for a, b, to in good)}
    want = {(k, m) for k, m, _ in log if k} - done
    r = spark.createDataFrame(reports, "report_id bigint, run_id bigint, first_memtable_id bigint, last_memtable_id bigint, to_revision bigint, status string, reported_at int")
    df = spark.createDataFrame(log, "key string, mod_revision bigint, memtable_id bigint")
    for span in (1, 7, 512):
        got = [tuple(x) for x in pending_changes(df, r, span).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert {tuple(x) for x in pending_changes(df, r.limit(0)).collect()} == {(k, m) for k, m, _ in log if k}
    assert pending_changes(df.limit(0), r).count() == 0


def test_pending_from_run_to_run(spark, tmp_path):
    """A second run replaces only partitions that changed, a run that dies before it recorded is repeated."""
    r = lambda *runs: spark.createDataFrame(
        [(i, i, a, b, to, "succeeded", i) for i, (a, b, to) in enumerate(runs)],
        "report_id bigint, run_id bigint, first_memtable_id bigint, last_memtable_id bigint, to_revision bigint, status string, reported_at int",
    )
    s = "key string, mod_revision bigint, memtable_id bigint"
    log = [(f"k{m % 7}", m, m // 10) for m in range(400)]
    path = f"file://{tmp_path}/pending"
    run = lambda rows, reports: incremental.pending_table(spark.createDataFrame(rows, s), reports, 100, 10, path)
    got = lambda t: sorted((tuple(x) for x in t.read().select("key", "mod_revision").collect()), key=lambda x: (x[0], x[1] or 0))
    t, n = run(log, r((0, 29, 1000)))
    assert n == 4 and got(t) == sorted(x[:2] for x in log if x[1] >= 300)
    assert run(log, r((0, 29, 1000)))[1] == 0
    t, n = run(log, r((0, 29, 1000), (30, 34, 1000)))
    assert n == 1 and got(t) == sorted(x[:2] for x in log if x[1] >= 350)
    late = [*log, ("k0", 0, 39), ("new", 120, 39), ("k0", None, 1)]  # a repeat of a processed change, and two new ones
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(incremental.IncrementalTable, "record", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            run(late, r((0, 34, 1000)))
    t, n = run(late, r((0, 34, 1000)))
    assert n == 3 and got(t) == sorted([*[x[:2] for x in log if x[1] >= 350], ("new", 120), ("k0", None)], key=lambda x: (x[0], x[1] or 0))


def test_ranges_for_the_scan(spark):
    df = spark.range(0, 10_000).withColumnRenamed("id", "c")
    for parts in ([0], [1, 2, 3, 50, 51, 99], list(range(0, 100, 2)), list(range(0, 1000, 7))):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(incremental, "SCAN_RANGES", 5)
            kept = {r[0] for r in df.filter(incremental._in_ranges(("c", 10), parts)).collect()}
        assert {c for c in range(10_000) if c // 10 in set(parts)} <= kept
        if len(parts) < 7:
            assert len(kept) == 10 * len(parts)


def test_incremental_table(spark, tmp_path):
    t = IncrementalTable(spark, f"file://{tmp_path}/inc", "part")
    make = lambda rows: spark.createDataFrame(rows, "part int, v string")
    seen = []

    def compute(df):
        seen.append(sorted({r["part"] for r in df.collect()}))
        return df.filter("v <> 'drop'")

    rows = [(1, "a"), (1, "a"), (2, "b"), (3, None)]
    assert t.update(make(rows), compute) == 3
    assert t.update(make(rows[::-1]), compute) == 0  # order doesn't matter
    assert len(seen) == 1
    rows2 = [(1, "a"), (2, "b"), (3, "drop"), (4, "x")]
    assert t.update(make(rows2), compute) == 3 and seen[-1] == [1, 3, 4]
    assert sorted(tuple(r) for r in t.read().select("part", "v").collect()) == [(1, "a"), (2, "b"), (4, "x")]
    assert t.update(make(rows2[1:]), compute) == 1  # a partition that is gone
    assert sorted(r["part"] for r in t.read().collect()) == [2, 4]

    # a run that dies before its fingerprints are recorded is repeated without skipping or doubling anything
    def dies(df):
        raise RuntimeError

    with pytest.raises(RuntimeError):
        t.update(make([(2, "c"), (4, "x")]), dies)
    assert t.update(make([(2, "c"), (4, "x")]), compute) == 2
    assert sorted(tuple(r) for r in t.read().select("part", "v").collect()) == [(2, "c"), (4, "x")]
    a = fingerprints(make([(1, None), (1, "x")]), "part").first()
    b = fingerprints(make([(1, "x"), (1, None)]), "part").first()
    assert (a["n"], a["h"]) == (b["n"], b["h"])


def test_files_in_use(spark):
    s = "record_no bigint, type string, flush_id bigint, memtable_id bigint, compaction_task struct<upper_level:int, upper_ids:array<bigint>, lower_level:int, lower_ids:array<bigint>, bottom:boolean, output_ids:array<bigint>>, produced_ssts array<bigint>"
    rows = [
        (1, "flush", 1, None, None, None), (2, "flush", None, None, None, [2, None]), (3, "flush", 3, None, None, [3]), (3, "flush", 3, None, None, [3]),
        (4, "compaction", None, None, (0, [1, 2], 1, None, False, [10, None]), None),
        (5, "compaction", None, None, (0, [3], 1, [], False, None), None),  # names no output: not carried out
        (6, "compaction", None, None, (1, [10], 2, [None], True, []), [10, 11]),  # keeps what it reads
        (7, None, None, None, None, None), (8, "memtable", None, 9, None, None),
    ]
    m = spark.createDataFrame(rows, s)
    assert sorted(r[0] for r in consolidate.files_in_use(m).collect()) == [3, 10, 11]
    f = spark.createDataFrame([(3, 10, 1, "a", "b"), (3, None, None, None, None), (10, 40000, 1, "a", "b"), (11, None, None, None, None), (1, 5, 1, "a", "a")], "sst_id bigint, size_bytes bigint, n_entries bigint, first_key string, last_key string")
    assert [r["sst_id"] for r in consolidate.undersized(m, f).collect()] == [3]
    assert consolidate.undersized(m.limit(0), f).count() == 0 and consolidate.undersized(m, f.limit(0)).count() == 0


@pytest.mark.parametrize("kept", [7, 50, 10**6])
def test_merged_order(kept, monkeypatch):
    """The heap merge against a sort, with nulls, ties and runs of any length."""
    monkeypatch.setattr(consolidate, "KEPT_KEYS", kept)
    for seed in range(30):
        rng = random.Random(seed)
        rows = []
        for _ in range(rng.randrange(6)):
            run = [(rng.choice(["", "a", "ä", "b", "zz", *([None] if seed % 2 else [])]), rng.randrange(5)) for _ in range(rng.randrange(1, 60))]
            rows += sorted(run, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1]))
        got = consolidate.merged_order([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())])
        assert sorted(got.tolist()) == list(range(len(rows)))
        order = [((rows[i][0] is not None, (rows[i][0] or "").encode()), rows[i][1]) for i in got]
        assert order == sorted(order)


def test_lost_attempts_leave_no_files(spark, tmp_path):
    df = spark.createDataFrame([(f"k{i}", i) for i in range(50)], "key string, memtable_id bigint").withColumn("value", F.lit(None).cast("string"))
    out = consolidate.merge_runs(df, ["key"], consolidate.entry_bytes(), 300, f"file://{tmp_path}/o", "memtable_id")
    (tmp_path / "o" / "0-lost.parquet").write_bytes(b"")
    consolidate._drop_orphans(out, f"file://{tmp_path}/o")
    assert {r["file"] for r in out.collect()} == {f.name for f in (tmp_path / "o").glob("*.parquet")}
    assert sorted(s["source"] for r in out.collect() for s in r["sources"]) == list(range(50))


@pytest.mark.parametrize("target", [200, 5_000, 10**9])
def test_merge_runs(spark, tmp_path, target):
    rng = random.Random(target)
    rows = [(rng.choice(["hot"] * 4 + [f"k{rng.randrange(50)}", None, ""]), i, "x" * rng.choice([0, 1, 30, 300]) if i % 9 else None) for i in range(700)]
    rows += rows[:50]
    df = spark.createDataFrame(rows, "key string, commit_ts bigint, value string").withColumn("output", F.lit("a clashing name"))
    path = f"file://{tmp_path}/out"
    out = consolidate.merge_runs(df, ["key", "commit_ts"], consolidate.entry_bytes(), target, path).orderBy("output").collect()
    assert sum(o["records"] for o in out) == len(rows)
    back = spark.read.parquet(path)
    assert Counter(map(tuple, back.select("key", "commit_ts", "value").collect())) == Counter(rows)
    assert all(o["bytes"] < target + 400 for o in out)
    for f in (tmp_path / "out").rglob("*.parquet"):
        got = pq.ParquetFile(f).read(["key", "commit_ts"]).to_pylist()
        order = [((r["key"] is not None, (r["key"] or "").encode()), r["commit_ts"]) for r in got]
        assert order == sorted(order)
    assert all((x["last_key"] or "").encode() <= (y["first_key"] or "").encode() for x, y in zip(out, out[1:]))
    assert consolidate.merge_runs(df.limit(0), ["key"], consolidate.entry_bytes(), target, path + "0").count() == 0
