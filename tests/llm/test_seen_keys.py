"""Ribbon filters, and whether a key was seen before: against brute force."""

import random

import numpy as np
import pytest

from siltbed.llm import ribbon
from siltbed.llm.seen_keys import MAX_BATCHES, seen_before, wrong_answers


def test_ribbon():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 63, 64, 65, 5000):
        h = rng.integers(-(2**63), 2**63 - 1, n)
        f = ribbon.build(np.concatenate([h, h]), 10)
        assert ribbon.probe(h, *f, 10).all()
        other = rng.integers(-(2**63), 2**63 - 1, 50_000)
        assert ribbon.probe(other, *f, 10).mean() < 3 * 2**-10


def test_seen_keys(spark):
    rng = random.Random(8)
    hist = [(i, rng.choice([f"k{rng.randrange(200)}", "hot", "", None])) for i in range(500)]
    recs = [(i * 3, rng.choice([f"k{rng.randrange(600)}", "hot", "new", f"k{rng.randrange(9)} ", "", None])) for i in range(700)]
    old = {k for _, k in hist if k}
    want, seen = set(), set(old)
    for n, k in recs:
        if k:
            if k in seen:
                want.add(n)
            seen.add(k)
    h = spark.createDataFrame(hist, "log_id bigint, key string")
    r = spark.createDataFrame(rng.sample(recs, len(recs)), "probe_id bigint, key string")
    for batches in ((1, 1), (4, 4), (3, 7)):
        got = [x[0] for x in seen_before(h, r, "log_id", "probe_id", batches=batches).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    rate = wrong_answers(h, r, "log_id", "probe_id").collect()
    assert len(rate) == 8 and all(x["said_yes"] <= 5 and x["audited"] > 0 for x in rate)
    assert seen_before(h.limit(0), r.limit(0), "log_id", "probe_id").count() == 0
    assert {x[0] for x in seen_before(h.limit(0), r, "log_id", "probe_id").collect()} < want


def test_too_many_batches(spark):
    r = spark.createDataFrame([(1, "a")], "n bigint, key string")
    with pytest.raises(ValueError):
        seen_before(r, r, "n", "n", batches=(MAX_BATCHES, 1))
    assert seen_before(r, r, "n", "n", batches=(MAX_BATCHES - 1, 1)).count() == 1
