"""Transactions in bulk: write sets, commit timestamps, conflicts under snapshot isolation, recovery of the clock."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltbed.operators.heavy_keys import previous_by_key
from siltbed.sources.tables import has_key


def collapse(writes: DataFrame) -> DataFrame:
    """The last write of each key in each transaction. writes: txn_id, seq, key, value, is_deleted.

    Reduced map-side, so a key that one transaction writes very often costs one row a task.
    """
    rest = [c for c in writes.columns if c not in ("txn_id", "key")]
    best = F.max(F.struct("seq", *[c for c in rest if c != "seq"])).alias("w")
    return writes.filter(has_key()).groupBy("txn_id", "key").agg(best).select("txn_id", "key", *[F.col(f"w.{c}").alias(c) for c in rest])


def numbered(df: DataFrame, by: str, base: int = 0, name: str = "commit_ts") -> DataFrame:
    """The distinct values of a column with consecutive numbers from base + 1, in ascending order.

    Distributed: ranges are sorted in parallel, and each starts after the rows of the ranges before it (one count a
    range reaches the driver). A single window over all rows would put them into one task.
    """
    spark = df.sparkSession
    values = df.select(by).filter(F.col(by).isNotNull()).distinct()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    from siltbed.session import shared_path, written

    ranged = written(
        values.repartitionByRange(parts, by).select(by, F.spark_partition_id().alias("__range")), shared_path(spark, "numbered")
    )
    sizes = {r["__range"]: r["n"] for r in ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, at = [], base
    for k in sorted(sizes):
        starts.append((k, at))
        at += sizes[k]
    first = spark.createDataFrame(starts, "__range int, __start bigint")
    nth = F.row_number().over(Window.partitionBy("__range").orderBy(by))
    return ranged.join(F.broadcast(first), "__range").select(by, (F.col("__start") + nth).alias(name))


def commit_timestamps(writes: DataFrame, base: int = 0) -> DataFrame:
    """(txn_id, commit_ts): consecutive timestamps in order of the transactions, after base."""
    return numbered(writes, "txn_id", base)


def conflicts(writes: DataFrame, log: DataFrame) -> DataFrame:
    """The writes that lose under first-committer-wins: a version of their key was committed after their snapshot.

    writes: txn_id, key, read_ts; log: key, commit_ts. The log is reduced to one row a key first.
    """
    last = log.filter(has_key()).groupBy("key").agg(F.max("commit_ts").alias("__last"))
    return writes.join(last, "key").filter(F.col("__last") > F.col("read_ts")).select(*writes.columns)


def conflicts_between(writes: DataFrame) -> DataFrame:
    """(txn_id) of transactions of a batch that lose to another one of the batch: some key of theirs was committed by
    another transaction after their read_ts and before their own commit_ts.

    writes: txn_id, key, read_ts, commit_ts. Each write only looks at the write of its key committed just before it
    (the latest that can have happened after read_ts), so no pairs are made.
    """
    w = writes.select("txn_id", "key", "read_ts", "commit_ts").distinct()
    before = previous_by_key(w, "key", ["commit_ts", "txn_id"], "commit_ts", prev="__before")  # a hot key is sliced there
    return before.filter(F.col("__before") > F.col("read_ts")).select("txn_id").distinct()


def hash_conflicts(committed: DataFrame, pending: DataFrame) -> DataFrame:
    """(txn_id) of pending transactions that share a key hash with one committed after their read_ts.

    committed: commit_ts, key_hashes; pending: txn_id, read_ts, key_hashes. A null list is empty.
    """
    last = committed.select(F.explode("key_hashes").alias("h"), "commit_ts").groupBy("h").agg(F.max("commit_ts").alias("last"))
    p = pending.select("txn_id", "read_ts", F.explode("key_hashes").alias("h"))
    return p.join(last, "h").filter(F.col("last") > F.col("read_ts")).select("txn_id").distinct()


def low_water_mark(active: DataFrame) -> DataFrame:
    """The least read_ts of the active transactions; null if there are none."""
    return active.agg(F.min("read_ts").alias("low_water_mark"))


def recovered_timestamp(log: DataFrame) -> DataFrame:
    """The clock after a restart: the greatest commit_ts of all tiers, 0 for an empty store."""
    return log.agg(F.coalesce(F.max("commit_ts"), F.lit(0)).cast("bigint").alias("recovered_ts"))


def committed(timestamps: DataFrame, log: DataFrame) -> DataFrame:
    """The timestamps (commit_ts) that some transaction committed at."""
    return timestamps.join(log.select("commit_ts").distinct(), "commit_ts", "left_semi")


def outcomes(txns: DataFrame, log: DataFrame, lost: DataFrame) -> DataFrame:
    """(txn_id, state) of transactions: aborted if in lost, committed if the log has rows of it, else pending."""
    done = log.select("txn_id").distinct().withColumn("__done", F.lit(True))
    gone = lost.select("txn_id").distinct().withColumn("__lost", F.lit(True))
    state = F.when(F.col("__lost"), "aborted").when(F.col("__done"), "committed").otherwise("pending")
    return txns.select("txn_id").distinct().join(done, "txn_id", "left").join(gone, "txn_id", "left").select("txn_id", state.alias("state"))
