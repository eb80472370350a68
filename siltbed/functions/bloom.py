"""Bloom filters of the keys of a run: sizing, building and probing, one filter a run."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltbed.session import ship

# The start values of the two hashes.
H1, H2 = 0x9E3779B9, 0x85EBCA6B


def bits_for(n: Column, p: Column) -> Column:
    """Bits of a filter for n keys at a rate p of false positives; n = 0 gives 0."""
    return F.ceil(-n * F.log(p) / F.pow(F.log(F.lit(2.0)), 2)).cast("bigint")


def hashes_for(n: Column, p: Column) -> Column:
    """The number of hashes, at least 1."""
    ratio = F.try_divide(bits_for(n, p).cast("double"), n.cast("double"))
    return F.greatest(F.lit(1), F.coalesce(F.round(ratio * F.log(F.lit(2.0))), F.lit(1))).cast("int")


def plan(n: int, p: float) -> tuple[int, int]:
    """(bits, hashes) of a filter; an empty one has a byte, so that probing needs no special case."""
    bits = max(8, math.ceil(-n * math.log(p) / math.log(2) ** 2)) if n else 8
    return bits, max(1, round(bits / max(n, 1) * math.log(2)))


def _pairs(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The two 64-bit hashes of each key, byte by byte over all keys at once."""
    size = np.array([len(k) for k in keys], np.int64)
    width = int(size.max(initial=0))
    table = np.zeros((len(keys), width), np.uint64)
    for i, k in enumerate(keys):
        table[i, : len(k)] = np.frombuffer(k, np.uint8)
    h1, h2 = np.full(len(keys), H1, np.uint64), np.full(len(keys), H2, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            on = size > j
            h1 = np.where(on, (h1 * np.uint64(33)) ^ table[:, j], h1)
            h2 = np.where(on, h2 * np.uint64(33 * 33) + table[:, j], h2)
    return h1, h2


def positions(keys: list[bytes], bits: int, hashes: int) -> np.ndarray:
    """The bit positions of each key, one row a key."""
    h1, h2 = _pairs(keys)
    with np.errstate(over="ignore"):
        return np.stack([(h1 + np.uint64(i) * h2) % np.uint64(bits) for i in range(hashes)], axis=1) if keys else np.empty((0, hashes), np.uint64)


def build(keys: list[bytes], p: float = 0.01) -> tuple[int, int, bytes]:
    bits, hashes = plan(len(keys), p)
    field = np.zeros((bits + 7) // 8 * 8, np.uint8)
    field[positions(keys, bits, hashes).astype(np.int64).ravel()] = 1
    return bits, hashes, np.packbits(field, bitorder="little").tobytes()


def contains(keys: list[bytes], bits: int, hashes: int, field: bytes) -> np.ndarray:
    """False is certain, True may be wrong at the planned rate."""
    have = np.unpackbits(np.frombuffer(field, np.uint8), bitorder="little")
    return have[positions(keys, bits, hashes).astype(np.int64)].all(axis=1).astype(bool)


def run_filters(log: DataFrame, p: float = 0.01, run: str = "run_id") -> DataFrame:
    """(run, n, bits, hashes, field) over the distinct keys of each run."""
    ship(log.sparkSession)
    kind = log.schema[run].dataType.simpleString()

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [bytes(k) for k in pdf["raw"]]
        bits, hashes, field = build(keys, p)
        return pd.DataFrame({run: pdf[run].iloc[:1].to_numpy(), "n": [len(keys)], "bits": [bits], "hashes": [hashes], "field": [field]})

    distinct = log.select(run, F.col("key").cast("binary").alias("raw")).distinct()
    return distinct.groupBy(run).applyInPandas(make, f"`{run}` {kind}, n bigint, bits bigint, hashes int, field binary")


def probe_runs(filters: DataFrame, keys: list[str], run: str = "run_id") -> DataFrame:
    """(run, key, maybe) for a list of keys against every run's filter."""
    ship(filters.sparkSession)
    kind = filters.schema[run].dataType.simpleString()
    raw = [k.encode() for k in keys]

    def ask(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                d = r._asdict()
                yield pd.DataFrame({run: [d[run]] * len(keys), "key": keys, "maybe": contains(raw, d["bits"], d["hashes"], d["field"])})

    return filters.mapInPandas(ask, f"`{run}` {kind}, key string, maybe boolean")


def probe_keys(filters: DataFrame, keys: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, key, maybe) for a table of (run, key): each key against the filter of the run it names.

    A run's keys meet its filter in one task, as they do where the filter is built.
    """
    ship(filters.sparkSession)
    kind = filters.schema[run].dataType.simpleString()

    def ask(have: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if have.empty:
            return pd.DataFrame({run: asked[run], "key": asked["key"], "maybe": False})
        d = have.iloc[0]
        maybe = contains([k.encode() for k in asked["key"]], int(d["bits"]), int(d["hashes"]), d["field"])
        return pd.DataFrame({run: asked[run], "key": asked["key"], "maybe": maybe})

    return filters.groupBy(run).cogroup(keys.select(run, "key").groupBy(run)).applyInPandas(ask, f"`{run}` {kind}, key string, maybe boolean")
