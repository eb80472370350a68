"""Scalar functions: the key encoding, hashes, checksums, names. All are column expressions of built-in functions,
but for the hash of the Bloom filter, whose arithmetic wraps at 64 bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SUFFIX = 16  #: bytes after the key: version and inverted timestamp, 64 bits each, big-endian


def _be64(x: Column) -> Column:
    return F.unhex(F.lpad(F.hex(x), 16, "0"))


def encode_key(key: Column, version: Column, commit_ts: Column) -> Column:
    """key, version, inverted timestamp: bytes that sort a key's newer versions first. Null if any part is null."""
    return F.concat(key.cast("binary"), _be64(version.cast("bigint")), _be64(F.bitwise_not(commit_ts.cast("bigint"))))


def _tail_long(e: Column, from_end: int) -> Column:
    hexed = F.hex(F.substring(e, F.length(e) - from_end + 1, F.lit(8)))
    return F.conv(hexed, 16, -10).cast("bigint")


def decode_key(encoded: Column) -> Column:
    """struct(key binary, version, commit_ts); fewer than 16 bytes decode to an empty key with zeros."""
    short = F.length(encoded) < SUFFIX
    key = F.substring(encoded, F.lit(1), F.length(encoded) - SUFFIX)
    return F.struct(
        F.when(short, F.lit(b"")).otherwise(key).alias("key"),
        F.when(short, F.lit(0).cast("bigint")).otherwise(_tail_long(encoded, 16)).alias("version"),
        F.when(short, F.lit(0).cast("bigint")).otherwise(F.bitwise_not(_tail_long(encoded, 8))).alias("commit_ts"),
    )


def element_size(key: Column) -> Column:
    return (F.octet_length(key) + SUFFIX).cast("bigint")


def polynomial_hash(key: Column) -> Column:
    """h = 31 h + byte, modulo 2^32, over the key's bytes; an empty key has 0."""
    digits = F.hex(key.cast("binary"))
    at = F.sequence(F.lit(1), F.octet_length(key))
    bytes_ = F.transform(at, lambda i: F.conv(F.substring(digits, (i * 2 - 1).cast("int"), F.lit(2)), 16, 10).cast("bigint"))
    folded = F.aggregate(bytes_, F.lit(0).cast("bigint"), lambda h, b: (h * 31 + b).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.when(F.octet_length(key) == 0, F.lit(0).cast("bigint")).otherwise(folded)


def checksum(payload: Column) -> Column:
    return F.crc32(payload.cast("binary"))


def cache_key(table_id: Column, block_no: Column) -> Column:
    return F.concat_ws("_", table_id.cast("string"), block_no.cast("string"))


def task_name(task_type: Column) -> Column:
    """Names of the kinds of compaction, by their numbers from 0; others are unknown."""
    # Fixed values.
    names = ["Leveled", "Tiered", "Simple", "NoCompaction"]
    out = F.lit("Unknown")
    for i, n in enumerate(names):
        out = F.when(task_type == i, F.lit(n)).otherwise(out)
    return out


def widen(array: Column) -> Column:
    return F.transform(array, lambda x: x.cast("int"))


def array_max_or_zero(array: Column) -> Column:
    """The greatest element; 0 for an empty or null array."""
    return F.coalesce(F.array_max(array), F.lit(0))
