"""Choosing, applying and carrying out compactions; dropping old versions.

Levels: 0 is the level that flushes write to, its files may overlap; 1, 2, ... hold disjoint files each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltbed.operators import merge
from siltbed.operators.consolidate import ENTRY_OVERHEAD, entry_bytes


@dataclass(frozen=True)
class LevelOptions:
    level0_trigger: int = 4  #: files of level 0 that start a compaction into level 1
    files_threshold: int = 4  #: files of a level above an empty one that start a compaction
    size_ratio_percent: int = 200  #: a lower level with fewer files than this share of the upper one's is filled
    max_levels: int = 7


def level_counts(runs: DataFrame, options: LevelOptions = LevelOptions()) -> DataFrame:
    """(level, files) for every level, empty ones too. runs: level, run_id."""
    levels = runs.sparkSession.range(0, options.max_levels + 1).select(F.col("id").cast("int").alias("level"))
    return levels.join(F.broadcast(runs.groupBy("level").agg(F.count(F.lit(1)).alias("n"))), "level", "left").select(
        "level", F.coalesce("n", F.lit(0)).cast("bigint").alias("files")
    )


def pick(runs: DataFrame, options: LevelOptions = LevelOptions()) -> DataFrame:
    """At most one row (upper_level, lower_level, bottom, reason): the compaction that is due.

    Level 0 comes first. Otherwise the first level whose lower neighbour is empty and that has enough files, or whose
    lower neighbour is too small in proportion to it. An empty upper level starts nothing.
    """
    counts = level_counts(runs, options)  # at most max_levels + 1 rows, so one window without partitions is bounded
    pairs = counts.select(
        F.col("level").alias("upper_level"),
        (F.col("level") + 1).alias("lower_level"),
        F.col("files").alias("upper"),
        F.lead("files").over(Window.orderBy("level")).alias("lower"),
    ).filter(F.col("lower").isNotNull())
    share = F.try_divide(F.col("lower") * 100, F.col("upper"))
    reason = (
        F.when((F.col("upper_level") == 0) & (F.col("upper") >= options.level0_trigger), F.lit("level 0 is full"))
        .when((F.col("upper_level") > 0) & (F.col("lower") == 0) & (F.col("upper") >= options.files_threshold), F.lit("lower level is empty"))
        .when((F.col("upper_level") > 0) & (F.col("lower") > 0) & (F.floor(share) < options.size_ratio_percent), F.lit("lower level is small"))
    )
    due = pairs.withColumn("reason", reason).filter(F.col("reason").isNotNull())
    return (
        due.orderBy("upper_level")
        .limit(1)
        .select("upper_level", "lower_level", (F.col("lower_level") == options.max_levels).alias("bottom"), "reason")
    )


def due(counts: dict[int, int], options: LevelOptions = LevelOptions()) -> tuple[int, int, bool, str] | None:
    """The same rule as pick() on the few numbers that a store has at hand: (upper, lower, bottom, reason) or None."""
    for upper in range(options.max_levels):
        have, below = counts.get(upper, 0), counts.get(upper + 1, 0)
        reason = None
        if upper == 0:
            reason = "level 0 is full" if have >= options.level0_trigger else None
        elif not below:
            reason = "lower level is empty" if have >= options.files_threshold else None
        elif have and below * 100 // have < options.size_ratio_percent:
            reason = "lower level is small"
        if reason:
            return upper, upper + 1, upper + 1 == options.max_levels, reason
    return None


def apply_result(runs: DataFrame, upper_level: int, lower_level: int, outputs: DataFrame) -> DataFrame:
    """The runs after a compaction: all of both levels are gone, the outputs (run_id) are in the lower one."""
    kept = runs.filter(~F.col("level").isin(upper_level, lower_level)).select("level", "run_id")
    return kept.unionByName(outputs.select(F.lit(lower_level).cast("int").alias("level"), "run_id"))


def merged(log: DataFrame, upper_level: int, lower_level: int) -> DataFrame:
    """The rows of two levels as a rewrite keeps them: every version and tombstone once."""
    rows = log.filter(F.col("level").isin(upper_level, lower_level))
    return merge.exact([rows]).withColumn("level", F.lit(lower_level).cast("int"))


def output_files(rows: DataFrame, files: int) -> DataFrame:
    """Rows in files of disjoint key ranges, sorted by key, newest first, with the column file_no.

    Ranges are made of (key, commit_ts), so one key may span files if it is larger than a file.
    """
    spread = rows.withColumn("__age", -F.col("commit_ts")).repartitionByRange(files, "key", "__age")
    return spread.sortWithinPartitions("key", "__age").withColumn("file_no", F.spark_partition_id()).drop("__age")


def target_files(rows: DataFrame, target_bytes: int) -> int:
    """How many files of about target_bytes the rows need."""
    total = rows.agg(F.sum(entry_bytes())).first()[0] or 0
    return max(1, -(-int(total) // max(target_bytes, ENTRY_OVERHEAD)))


def discard_horizon(watermark: int, oldest_read_ts: int | None, ratio: float = 0.7) -> int:
    """Up to which commit_ts superseded versions may go: a share of the way to the oldest snapshot still read."""
    return int(min(watermark, watermark if oldest_read_ts is None else oldest_read_ts) * ratio)


def drop_old_versions(log: DataFrame, horizon: int, bottom: bool = True) -> DataFrame:
    """Keep each key's newest version at or before the horizon and everything after it.

    At the bottom level a kept version that is a delete goes too, if it is at or before the horizon: nothing older is
    left for it to hide. Any snapshot at or after the horizon reads the same as before. Versions of a key with the
    same commit_ts stay together.
    """
    old = F.col("commit_ts") <= horizon
    # One row a key, reduced map-side, and joined back: a key with very many versions is no single group anywhere.
    last = log.filter(old).groupBy("key").agg(F.max("commit_ts").alias("__last"))
    cond: Column = ~old | (F.col("commit_ts") == F.col("__last"))
    if bottom:
        cond = cond & ~(old & F.coalesce(F.col("is_deleted"), F.lit(False)))
    return log.join(last, "key", "left").filter(cond).select(*log.columns)
