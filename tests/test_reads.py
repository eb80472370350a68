"""Reads against a dictionary of versions, and the cited behaviours of scans and gets."""

import random

import pytest

from siltbed.operators import reads

SCHEMA = "key string, version bigint, commit_ts bigint, value string, is_deleted boolean, run_id bigint, level int"


def log_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def ten(spark):
    return log_of(spark, [(f"scan_key_{i:02d}", 0, i, f"value_{i:02d}", False, 0, 0) for i in range(10)])


def keys(df):
    return [r["key"] for r in df.collect()]


def test_scan_ranges(ten):
    assert keys(reads.scan(ten, "scan_key_", "scan_key_~")) == [f"scan_key_{i:02d}" for i in range(10)]
    assert keys(reads.scan(ten, "scan_key_03", "scan_key_07")) == [f"scan_key_{i:02d}" for i in (3, 4, 5, 6)]
    assert keys(reads.scan(ten, "zzz")) == []
    assert keys(reads.scan(ten, None, None, 5)) == [f"scan_key_{i:02d}" for i in range(5)]
    assert keys(reads.scan(ten, limit=-1)) == []
    assert keys(reads.seek(ten, "scan_key_04x")) == ["scan_key_05"]
    assert keys(reads.scan_prefix(ten, "scan_key_0", 2)) == ["scan_key_00", "scan_key_01"]


@pytest.mark.parametrize("start,end", [("z", "a"), ("a", "a")])
def test_bad_range(ten, start, end):
    with pytest.raises(ValueError):
        reads.scan(ten, start, end)


def test_versions_and_errors(spark):
    log = log_of(spark, [("k", 1, 1000, "v1", False, 0, 0), ("k", 2, 2000, "v2", False, 0, 0), ("k", 3, 3000, None, True, 0, 0), ("k", 3, 3000, None, True, 0, 0)])
    assert reads.get_or_raise(log, "k", 1000)["value"] == "v1"
    assert reads.get_or_raise(log, "k", 2500)["value"] == "v2"
    with pytest.raises(reads.KeyDeleted):
        reads.get_or_raise(log, "k")
    with pytest.raises(reads.KeyNotFound):
        reads.get_or_raise(log, "k", 10)
    for bad in (None, ""):
        with pytest.raises(ValueError):
            reads.get_or_raise(log, bad)
    assert [r["commit_ts"] for r in reads.history(log).collect()] == [3000, 2000, 1000]


def test_ties_follow_tiers(spark):
    log = log_of(spark, [("k", 0, 5, "old", False, 1, 1), ("k", 0, 5, "new", False, 2, 0), ("j", 0, 5, "a", False, 1, 0), ("j", 0, 5, "b", False, 2, 0)])
    assert {r["key"]: r["value"] for r in reads.snapshot(log).collect()} == {"k": "new", "j": "b"}


def test_nulls_and_empty(spark):
    log = log_of(spark, [(None, 0, 1, "x", False, 0, 0), ("", 0, 1, "x", False, 0, 0), ("k", None, 1, None, None, None, None)])
    assert keys(reads.snapshot(log)) == ["k"]
    assert keys(reads.snapshot(log_of(spark, []))) == []
    assert keys(reads.multi_get(log, ["k", "nope"])) == ["k"]


def test_model(spark):
    """Random puts and deletes spread over runs: every snapshot equals the model's."""
    rng = random.Random(3)
    rows, model = [], {}
    for ts in range(1, 200):
        k, gone = f"k{rng.randrange(12)}", rng.random() < 0.3
        rows.append((k, 0, ts, None if gone else f"v{ts}", gone, rng.randrange(5), rng.randrange(3)))
        model[ts] = (k, None if gone else f"v{ts}")
    log = log_of(spark, rows).cache()
    for at in (1, 17, 80, 199):
        want = {}
        for ts in range(1, at + 1):
            want[model[ts][0]] = model[ts][1]
        got = {r["key"]: r["value"] for r in reads.snapshot(log, at).collect()}
        assert got == {k: v for k, v in want.items() if v is not None}
