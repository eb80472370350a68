"""Every query with SQL against DuckDB on the smallest tables, the others for a result; streams; the entry."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
CORE = [n for n in entry.queries() if entry.llm is None or n not in entry.llm.QUERIES]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    norm = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted(([norm(r[i]) for i in order] for r in data), key=repr)


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if sql := entry.oracle_sql().get(name):
        cur = duck.execute(sql)
        names = [c[0] for c in cur.description]
        assert sorted(names) == sorted(df.columns)
        assert got == rows(names, cur.fetchall())


def test_all_batches(spark, duck):
    assert entry.queries()["kv_log_batches"](spark, SF).count() == duck.execute("SELECT count(*) FROM kv_log").fetchone()[0]


def test_engine_takes_all_events(spark, tmp_path):
    events = [(i, i % 70, "error" if i % 70 == i % 11 else f"e{i}") for i in range(200)]
    spark.createDataFrame(events, "event_id bigint, user_id bigint, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    df = entry.queries()["kv_engine"](spark, str(tmp_path))
    newest = {u: kind for _, u, kind in events}
    assert {tuple(r) for r in df.collect()} == {(f"u{u:08d}", kind) for u, kind in newest.items() if kind != "error"}
    assert spark.read.parquet(*df.inputFiles()).count() == len(events) + 2  # all versions, and those of the single writes


def test_all_runs_and_transactions(spark, tmp_path):
    """Against brute force, on ids of any size."""
    events = [(i, i * i % 23, "click") for i in range(9000, 9200)] + [(0, 1, "click"), (5001, 99, "click")]
    spark.createDataFrame(events, "event_id bigint, user_id bigint, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    orders = [(i, i % 7, "O", 1.0) for i in range(600, 9600, 3)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    run = lambda name: [tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect()]
    last = {u: max(i for i, v, _ in events if v == u) for _, u, _ in events}
    lost = {(i // 10, f"u{u:08d}") for i, u, _ in events if last[u] // 10 > i // 10}
    assert lost and sorted(run("kv_conflicts")) == sorted(lost)
    assert sorted(run("kv_hash_conflicts")) == sorted({(t,) for t, _ in lost})
    even = {u: max(i for i, v, _ in events if v == u and i // 1000 % 2 == 0) for i, u, _ in events if i // 1000 % 2 == 0}
    assert sorted(run("kv_two_merge")) == sorted((f"u{u:08d}", even.get(u, last[u])) for u in last)
    keys = [f"{i:010d}" for i, *_ in orders]
    assert sorted(k for k, _ in run("kv_concat_runs")) == keys
    assert sorted(k for k, _ in run("kv_concat_seek")) == [k for k in keys if k >= "0000000700"]
    probed = run("kv_bloom_probe")
    assert sorted(k for _, k, maybe in probed if maybe and len(k) == 10) == keys and all(r == int(k[:10]) // 1000 for r, k, _ in probed)
    absent = [maybe for _, k, maybe in probed if len(k) == 11]
    assert len(absent) == len(keys) - len({k[:7] for k in keys}) and sum(absent) < 0.05 * len(absent)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_stream_state(spark, tmp_path):
    from siltbed.streaming.ingest import drain, latest_by_key, latest_with_state

    schema = "key string, commit_ts bigint, value string, is_deleted boolean"
    parts = [[("a", 1, "a1", False), ("b", 5, "b5", False), (None, 1, "x", False)], [("a", 3, None, True), ("b", 2, "b2", None)], [("a", 2, "late", False), ("c", 1, "c", False)]]
    for i, p in enumerate(parts):
        spark.createDataFrame(p, schema).coalesce(1).write.parquet(f"{tmp_path}/in/p{i}")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    want = {("a", 3, None, True), ("b", 5, "b5", False), ("c", 1, "c", False)}
    assert {tuple(r) for r in drain(latest_by_key(stream()), "latest_a", "complete", f"{tmp_path}/c1").collect()} == want
    emitted = [tuple(r) for r in drain(latest_with_state(stream()), "latest_b", "append", f"{tmp_path}/c2").collect()]
    last = {}
    for r in emitted:
        last[r[0]] = max(last.get(r[0], r), r, key=lambda x: x[1])
    assert set(last.values()) == want


def test_log_is_waited_for(spark, tmp_path, monkeypatch):
    """A log that is slower than its writer holds the writer up; the queue doesn't take in all rows."""
    import time

    from siltbed.sources import runs
    from siltbed.sources.wal import WalBatcher

    events = [(i, i % 70, None if i % 9 == 0 else "error" if i % 7 == 0 else "e\u2028\"\u00e9\n") for i in range(40_000)]
    spark.createDataFrame(events, "event_id bigint, user_id bigint, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    waiting, append, submit = [0], runs.append_wal, WalBatcher.submit

    def slow(*args):
        time.sleep(0.05)
        append(*args)

    def watched(self, *args):
        waiting[0] = max(waiting[0], self._rows)
        return submit(self, *args)

    monkeypatch.setattr(runs, "append_wal", slow)
    monkeypatch.setattr(WalBatcher, "submit", watched)
    got = entry.queries()["kv_wal_replay"](spark, str(tmp_path)).collect()
    assert sorted((r["commit_ts"], r["value"] or "") for r in got) == [(i, kind or "") for i, _, kind in events]
    assert waiting[0] < 10_000
