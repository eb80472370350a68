"""Merging sorted runs: the set operators of the store.

A k-way or two-way merge keeps one row for each key, from the newest run that has it; a concatenation keeps all rows
of runs that don't overlap; an exact merge drops only rows equal in (key, version, commit_ts), as a rewrite of runs
must keep every version. Runs are given newest first. No runs give an error, as the columns are then unknown.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.operators.change_store import newest


def concat(runs: list[DataFrame]) -> DataFrame:
    """All rows of all runs (columns by name)."""
    if not runs:
        raise ValueError("no runs to merge")
    return reduce(DataFrame.unionByName, runs)


def concat_from(runs: list[DataFrame], key: str) -> DataFrame:
    """All rows at or after a key."""
    return concat([r.filter(F.col("key") >= key) for r in runs])


def k_way(runs: list[DataFrame]) -> DataFrame:
    """One row a key, from the first run (the newest) that has it; inside a run its greatest row by commit_ts."""
    ranked = [r.withColumn("__age", F.lit(-i)) for i, r in enumerate(runs)]
    order = ["__age", *(["commit_ts"] if "commit_ts" in runs[0].columns else [])]
    return newest(concat(ranked), "key", order).drop("__age")


def two_way(upper: DataFrame, lower: DataFrame) -> DataFrame:
    """All rows of the upper run, and the rows of the lower one whose key the upper hasn't got."""
    return upper.unionByName(lower.join(upper.select("key").distinct(), "key", "left_anti").select(*lower.columns))


def exact(runs: list[DataFrame]) -> DataFrame:
    """All versions once: rows equal in (key, version, commit_ts) are repeats. Nulls there are equal to each other."""
    return concat(runs).dropDuplicates(["key", "version", "commit_ts"])
