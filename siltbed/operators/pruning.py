"""Metadata of runs and blocks, and which of them a read can skip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltbed.session import ship

#: Fixed values of the block format: alignment, and bytes besides key and value.
ALIGNMENT, COUNT_BYTES, LENGTH_BYTES, OFFSET_BYTES = 4_096, 2, 2, 2
LONGEST = 65_535  #: of a key or a value in a block


def aligned(requested: Column) -> Column:
    """A block size rounded up to the alignment, at least one unit."""
    unit = F.lit(ALIGNMENT)
    return F.greatest(unit, F.ceil(requested / unit) * unit).cast("int")


def entry_size(key: Column, value: Column) -> Column:
    """Bytes of an entry in a block, its offset included; a null value is empty."""
    return (F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0)) + F.lit(2 * LENGTH_BYTES + OFFSET_BYTES)).cast("bigint")


def too_large(log: DataFrame) -> DataFrame:
    """Rows that a block can't hold (the store itself has no such limit)."""
    return log.filter((F.octet_length("key") > LONGEST) | (F.octet_length("value") > LONGEST))


def run_meta(log: DataFrame, run: str = "run_id") -> DataFrame:
    """One row a run: rows, first and last key, greatest commit_ts, bytes."""
    return log.groupBy(run).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("key").alias("first_key"),
        F.max("key").alias("last_key"),
        F.max("commit_ts").alias("max_ts"),
        F.sum(entry_size(F.col("key"), F.col("value"))).alias("bytes"),
    )


def block_index(log: DataFrame, rows_per_block: int, run: str | None = None) -> DataFrame:
    """Blocks of equally many rows in (key, newest first) order within each run: block_no, rows, first and last key.

    The log must name a run for anything large: a run is what one task sorts (its size is the store's target size).
    """
    by = [run] if run else []
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("key"), F.col("commit_ts").desc()))
    blocks = log.withColumn("block_no", F.floor((nth - 1) / rows_per_block).cast("bigint"))
    return blocks.groupBy(*by, "block_no").agg(
        F.count(F.lit(1)).alias("rows"), F.min("key").alias("first_key"), F.max("key").alias("last_key")
    )


def packed_blocks(log: DataFrame, block_bytes: int = ALIGNMENT, run: str = "run_id") -> DataFrame:
    """Greedy packing as a writer does it: a block takes entries in order while it stays within its size; its first
    entry always fits. (run, block_no, rows, bytes, first_key, last_key). Packing is a fold over a run in order, so
    it runs once a run, over a run's rows only."""
    ship(log.sparkSession)
    kind = log.schema[run].dataType.simpleString()

    def fold(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["__raw", "commit_ts"], ascending=[True, False], kind="stable")
        out, size, start = [], COUNT_BYTES, 0
        keys, sizes = pdf["key"].tolist(), pdf["__size"].tolist()
        for i, s in enumerate(sizes):
            if i > start and size + s > block_bytes:
                out.append((len(out), i - start, size, keys[start], keys[i - 1]))
                size, start = COUNT_BYTES, i
            size += s
        if keys:
            out.append((len(out), len(keys) - start, size, keys[start], keys[-1]))
        df = pd.DataFrame(out, columns=["block_no", "rows", "bytes", "first_key", "last_key"])
        df.insert(0, run, pdf[run].iat[0])
        return df

    rows = log.select(run, "key", F.col("key").cast("binary").alias("__raw"), "commit_ts", entry_size(F.col("key"), F.col("value")).alias("__size"))
    return rows.groupBy(run).applyInPandas(fold, f"`{run}` {kind}, block_no bigint, rows bigint, bytes bigint, first_key string, last_key string")


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Whether closed ranges overlap; a null bound is open."""
    return F.coalesce(s1 <= e2, F.lit(True)) & F.coalesce(s2 <= e1, F.lit(True))


def runs_for_range(meta: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """The runs that a scan of [start, end] must read."""
    return meta.filter(overlaps(F.col("first_key"), F.col("last_key"), F.lit(start), F.lit(end)))


def may_contain(meta: DataFrame, key: str) -> DataFrame:
    """The runs whose key range contains a key."""
    return meta.filter((F.col("first_key") <= key) & (F.col("last_key") >= key))


def find_block(blocks: DataFrame, key: str, run: str | None = None) -> DataFrame:
    """The number of the block that contains a key, else of the first block with larger keys; null past the end. With
    run, for each run that doesn't end before the key."""
    return blocks.filter(F.col("last_key") >= key).groupBy(*([run] if run else [])).agg(F.min("block_no").alias("block_no"))


def entry_at(log: DataFrame, index: int, run: str = "run_id") -> DataFrame:
    """The entry number index (from 0) of each run, in (key, newest first) order; runs that are shorter have none."""
    nth = F.row_number().over(Window.partitionBy(run).orderBy(F.col("key"), F.col("commit_ts").desc()))
    return log.withColumn("__nth", nth).filter(F.col("__nth") == index + 1).drop("__nth")


def sorted_runs(meta: DataFrame) -> DataFrame:
    """(level, runs): the runs of each level by first key, as point reads search them; ties by run number."""
    pairs = F.array_sort(F.collect_list(F.struct("first_key", "run_id")))
    return meta.groupBy("level").agg(F.transform(pairs, lambda x: x["run_id"]).alias("runs"))


def overlapping_pairs(meta: DataFrame) -> DataFrame:
    """(run_id, overlaps_next) in order of first key: whether a run's range meets that of the run after it; a level
    whose runs never do is sorted. meta is one row a run."""
    w = Window.partitionBy("level").orderBy("first_key", "run_id")
    nxt = F.lead("first_key").over(w)
    return meta.select("level", "run_id", F.coalesce(nxt <= F.col("last_key"), F.lit(False)).alias("overlaps_next"))


def estimated_size(log: DataFrame, by: str) -> DataFrame:
    """(by, bytes): bytes of a memtable, keys with their suffix and values, as they decide when it is full."""
    size = F.octet_length("key") + F.lit(16) + F.coalesce(F.octet_length("value"), F.lit(0))
    return log.filter(F.col("key").isNotNull()).groupBy(by).agg(F.sum(size.cast("bigint")).alias("bytes"))
