"""Reads of a versioned log: point and multi-key lookup, snapshots, ordered scans, history.

A log has the columns key, commit_ts, value, is_deleted and, if it knows its tiers, level (lower is newer) and run_id
(greater is newer). A read picks the newest version of a key with commit_ts up to the snapshot, and only then drops
deleted keys. Equal commit_ts: the lower level wins, then the greater run_id. Keys compare byte for byte.

Range filters stand before the reduction to one row a key, so they reach the Parquet scan. Null and empty keys belong
to no key. A null is_deleted is false.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltbed.operators.change_store import newest
from siltbed.sources.tables import has_key


class KeyNotFound(KeyError):
    """The key was never written, up to the snapshot."""


class KeyDeleted(KeyError):
    """The newest version of the key, up to the snapshot, is a delete."""


def version_order(log: DataFrame) -> tuple[DataFrame, list[str]]:
    """The log with its tie-breaking columns, and the order of versions from old to new."""
    order = ["commit_ts"]
    if "level" in log.columns:
        log = log.withColumn("__tier", -F.col("level"))
        order.append("__tier")
    if "run_id" in log.columns:
        order.append("run_id")
    return log, order


def versions_at(log: DataFrame, read_ts: int | None = None) -> DataFrame:
    """The newest version of each key, deletes included."""
    if read_ts is not None:
        log = log.filter(F.col("commit_ts") <= read_ts)
    log, order = version_order(log.filter(has_key()))
    return newest(log, "key", order).drop("__tier")


def live(versions: DataFrame) -> DataFrame:
    return versions.filter(~F.coalesce(F.col("is_deleted"), F.lit(False)))


def snapshot(log: DataFrame, read_ts: int | None = None) -> DataFrame:
    """Each live key once, as of read_ts (None: now)."""
    return live(versions_at(log, read_ts))


def get(log: DataFrame, key: str, read_ts: int | None = None) -> DataFrame:
    """The live version of one key, or no row."""
    return snapshot(log.filter(F.col("key") == key), read_ts)


def get_or_raise(log: DataFrame, key: str, read_ts: int | None = None):
    """The row of a live key; errors tell a missing key from a deleted one."""
    if not key:
        raise ValueError("a key must not be null or empty")
    rows = versions_at(log.filter(F.col("key") == key), read_ts).take(1)
    if not rows:
        raise KeyNotFound(key)
    if rows[0]["is_deleted"]:
        raise KeyDeleted(key)
    return rows[0]


def multi_get(log: DataFrame, keys: list[str] | DataFrame, read_ts: int | None = None) -> DataFrame:
    """The live versions of many keys: a list goes into the scan's filter, a table into a semi-join."""
    if isinstance(keys, DataFrame):
        wanted = keys.select(F.col(keys.columns[0]).alias("key")).distinct()
        return snapshot(log.join(wanted, "key", "left_semi"), read_ts)
    return snapshot(log.filter(F.col("key").isin(list(keys))), read_ts)


def between(start: str | None, end: str | None) -> Column:
    """start <= key < end; None or empty is unbounded. start >= end is an error if both are given."""
    if start and end and start.encode() >= end.encode():
        raise ValueError("the start of a range must lie before its end")
    cond = F.lit(True)
    if start:
        cond = cond & (F.col("key") >= start)
    if end:
        cond = cond & (F.col("key") < end)
    return cond


def scan(log: DataFrame, start: str | None = None, end: str | None = None, limit: int = 0, read_ts: int | None = None) -> DataFrame:
    """Live keys of [start, end) in key order; limit 0 is all, a negative one none."""
    found = snapshot(log.filter(between(start, end)), read_ts).orderBy("key")
    if limit < 0:
        return found.limit(0)
    return found.limit(limit) if limit else found


def scan_prefix(log: DataFrame, prefix: str, limit: int = 0, read_ts: int | None = None) -> DataFrame:
    """Live keys with a prefix, in key order (the prefix is pushed down to the scan)."""
    return scan(log.filter(F.col("key").startswith(prefix)), None, None, limit, read_ts)


def seek(log: DataFrame, key: str, read_ts: int | None = None) -> DataFrame:
    """The first live key at or after key; no row past the end."""
    return scan(log, key, None, 1, read_ts)


def history(log: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """All versions of the keys in [start, end), by key, newest first; exact repeats appear once."""
    rows = log.filter(has_key() & between(start, end)).dropDuplicates(["key", "commit_ts", *(["version"] if "version" in log.columns else [])])
    return rows.orderBy(F.col("key").asc(), F.col("commit_ts").desc())


def tombstones(log: DataFrame, read_ts: int | None = None) -> DataFrame:
    """The keys whose newest version is a delete."""
    return versions_at(log, read_ts).filter(F.coalesce(F.col("is_deleted"), F.lit(False)))
