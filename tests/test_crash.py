"""A process that dies at any file operation: nothing published is lost, nothing unpublished is read."""

import random

import pytest

from siltbed import session
from siltbed.operators import change_store
from siltbed.operators.change_store import ChangeStore
from siltbed.sources import manifest as mf


class Died(RuntimeError):
    pass


def dying(monkeypatch, module, after):
    """Let the module's file operations fail from the one numbered after on; half of the writes leave a temporary file."""
    n = [0]

    def wrap(name):
        real = getattr(session, name)

        def f(spark, *args, **kw):
            n[0] += 1
            if n[0] > after:
                raise Died(name)
            return real(spark, *args, **kw)

        return f

    for name in ("write_bytes", "remove"):
        monkeypatch.setattr(module, name, wrap(name))
    return n


def test_manifest_dies_anywhere(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mf, "SIDE_LINES", 3)
    for after in range(0, 24, 2):
        folder = f"file://{tmp_path}/m{after}"
        m = mf.ManifestFile(spark, folder)
        m.append(mf.flush_record(1))
        done, tried = [1], []
        with monkeypatch.context() as patch:
            dying(patch, mf, after)
            try:
                for i in range(2, 9):
                    tried.append(i)
                    m.append(mf.flush_record(i))
                    done.append(i)
                m.append(mf.compaction_record(0, [1, 2], 1, [], False, [20]))
                m.compact()
            except Died:
                pass
        got = [r["flushID"] for r in mf.ManifestFile(spark, folder).records() if r["type"] == "flush"]
        assert got[: len(done)] == done or set(done) - set(got) <= {1, 2}  # compacted away
        assert set(got) <= {1, *tried}
        for lost in ("MANIFEST", "MANIFEST.bak"):  # either of the two alone, with the side log, is the whole state
            monkeypatch.setattr(mf, "SIDE_LINES", 3)
            m = mf.ManifestFile(spark, folder)
            m.append(mf.flush_record(100 + len(lost)))
            want = m.lines
            session.remove(spark, f"{folder}/{lost}")
            assert mf.ManifestFile(spark, folder).lines == want


CHANGES = "key string, commit_ts bigint, mod_revision bigint, is_deleted boolean"


def test_store_dies_anywhere(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    rows = [(f"k{rng.randrange(9)}", rng.randrange(50), m, rng.random() < 0.3) for m in range(60)]
    parts = [spark.createDataFrame(rows[i : i + 10], CHANGES) for i in range(0, 60, 10)]
    for after in (0, 1, 2, 3, 4, 5, 7, 9):
        path = f"file://{tmp_path}/s{after}"
        done = 0
        with monkeypatch.context() as patch:
            dying(patch, change_store, after)
            try:
                s = ChangeStore(spark, path, buckets=2, trigger=2)
                for i, p in enumerate(parts):
                    s.append(p, batch_id=str(i))
                    done = i + 1
                    s.compact()
            except Died:
                pass
        s = ChangeStore(spark, path, buckets=2, trigger=2)

        def now():
            best = {}
            for k, t, m, d in rows[: 10 * done]:
                best[k] = max(best.get(k, (-1,)), (t, m, d))
            return {k: b[1] for k, b in best.items() if not b[2]}

        if done:
            assert {r["key"]: r["mod_revision"] for r in s.read().collect()} == now()
        for i, p in enumerate(parts):  # everything is delivered again
            s.append(p, batch_id=str(i))
            s.compact()
        done = 6
        assert {r["key"]: r["mod_revision"] for r in s.read().collect()} == now()


def test_sizes_and_buckets(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    s = ChangeStore(spark, path, buckets=2, trigger=2)
    for i in range(8):
        s.append(spark.createDataFrame([("a", i, i, i == 7), (f"b{i}", i, i, False)], CHANGES))
        s.compact()
        assert len(s.runs()) <= 3
    s.append(spark.createDataFrame([("a", 1, 1, False)], CHANGES))
    assert s.compact(force=True, buckets=5) and s.buckets == 5 and len(s.runs()) == 1
    for x in (s, ChangeStore(spark, path)):
        assert x.buckets == 5 and sorted(r["key"] for r in x.read().collect()) == [f"b{i}" for i in range(8)]


def test_failed_publish_leaves_nothing(spark, tmp_path, monkeypatch):
    s = ChangeStore(spark, f"file://{tmp_path}/f", buckets=2)
    s.append(spark.createDataFrame([("a", 1, 1, False)], CHANGES))
    with monkeypatch.context() as patch:
        dying(patch, change_store, 0)
        with pytest.raises(Died):
            s.append(spark.createDataFrame([("b", 1, 1, False)], CHANGES))
    s.append(spark.createDataFrame([("c", 1, 1, False)], CHANGES))
    assert sorted(r["key"] for r in s.read().collect()) == ["a", "c"]
