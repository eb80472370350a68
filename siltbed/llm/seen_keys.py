"""Has this key been seen before? Ribbon filters over sealed batches, probed in generations, then an exact check.

Keys arrive in batches, in order of a number. A sealed batch is reduced to its distinct keys, split by a hash of the
key into shards of bounded size, and each shard becomes one ribbon filter: about FREE * BITS bits a key, whatever the
key's length. A later batch probes the filters of all earlier batches, shard by shard, with 64-bit hashes of its
distinct keys. A filter that says no is certain; keys with a yes are looked up in the sealed batches' key table, which
therefore is read for few keys only where most records are new. Inside its own batch a key's first record decides.

The rate of wrong answers of the filters is measured with keys that are certainly absent (longer than any key seen);
after the exact check the answers are right.

Skew: a batch is reduced to distinct keys inside each map task before any shuffle, so a key that holds a third of all
records is one row a task; the answer comes from an anti join on the unique record number.

Defined cases: records with a null or empty key belong to no key: they are neither kept nor answered. Empty inputs give
no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.llm import ribbon
from siltbed.session import shared_path, ship, size_of, written
from siltbed.sources.tables import has_key

BITS = 12
SHARD_BYTES = 1 << 20  #: about so many bytes of a sealed key table for each shard of a batch
SEED = 7
TASK_FILTERS = 8
#: The filters that say yes are bits of a number of 64 bits with a sign.
MAX_BATCHES = 63


@dataclass
class SeenKeys:
    """The sealed batches of a stream of keys: a table of distinct keys and one of filters."""

    keys: DataFrame  #: gen, key, h, shard, first (the least record number)
    filters: DataFrame  #: gen, shard, n, seed, rows, solution
    shards: int
    bits: int


def _generation(df: DataFrame, number: str, batches: int, offset: int) -> DataFrame:
    lo, hi = df.agg(F.min(number), F.max(number)).first()
    if lo is None:
        return df.withColumn("gen", F.lit(offset))
    step = max(1, -(-(hi - lo + 1) // batches))
    return df.withColumn("gen", (F.lit(offset) + F.floor((F.col(number) - F.lit(lo)) / F.lit(step))).cast("int"))


def seal(history: DataFrame, records: DataFrame, number_h: str, number_r: str, key: str = "key", batches: tuple[int, int] = (4, 4), bits: int = BITS) -> SeenKeys:
    """Seal history (batches[0] batches) and then records (batches[1] batches), all by their record numbers; more than
    MAX_BATCHES batches are an error."""
    if sum(batches) > MAX_BATCHES:
        raise ValueError(f"at most {MAX_BATCHES} sealed batches are probed at once")
    spark = records.sparkSession
    ship(spark)
    base = shared_path(spark, "seen")
    a = _generation(history.filter(has_key(key)).select(key, number_h), number_h, batches[0], 0)
    b = _generation(records.filter(has_key(key)).select(key, number_r), number_r, batches[1], batches[0])
    both = a.select("gen", F.col(key).alias("key"), F.col(number_h).alias("n")).unionByName(
        b.select("gen", F.col(key).alias("key"), F.col(number_r).alias("n"))
    )
    distinct = both.groupBy("gen", "key").agg(F.min("n").alias("first"))
    keys = written(distinct.withColumn("h", F.xxhash64(F.lit(SEED), "key")), f"{base}/keys")
    shards = max(1, -(-size_of(spark, f"{base}/keys") // (SHARD_BYTES * sum(batches))))
    keys = keys.withColumn("shard", F.pmod(F.col("h"), F.lit(shards)).cast("int"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        seed, rows, solution = ribbon.build(pdf["h"].to_numpy(), bits)
        return pd.DataFrame(
            {"gen": [int(pdf["gen"].iat[0])], "shard": [int(pdf["shard"].iat[0])], "n": [len(pdf)], "seed": [seed], "rows": [rows], "solution": [solution]}
        )

    # Solving costs far more than its bytes, so tasks are set by the number of filters, not by the size of their keys.
    groups = shards * sum(batches)
    tasks = max(min(groups, spark.sparkContext.defaultParallelism), -(-groups // TASK_FILTERS))
    built = keys.select("gen", "shard", "h").repartition(tasks, "gen", "shard").groupBy("gen", "shard").applyInPandas(
        solve, "gen int, shard int, n bigint, seed bigint, rows bigint, solution binary"
    )
    return SeenKeys(keys, written(built, f"{base}/filters"), shards, bits)


def probe(probes: DataFrame, seen: SeenKeys, carry: str) -> DataFrame:
    """probes: gen, shard, h and carry (a column of the type string). Returns carry, gen, hits: the earlier
    generations, as bits of a number, whose filter says yes."""
    bits = seen.bits
    kind = dict(probes.dtypes)[carry]

    def ask(p: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        hits = np.zeros(len(p), np.int64)
        h, gen = p["h"].to_numpy(), p["gen"].to_numpy()
        for g, seed, rows, solution in zip(f["gen"], f["seed"], f["rows"], f["solution"], strict=True):
            later = np.flatnonzero(gen > g)
            if len(later):
                yes = ribbon.probe(h[later], int(seed), int(rows), solution, bits)
                hits[later[yes]] |= np.int64(1) << np.int64(g)
        return pd.DataFrame({carry: p[carry], "gen": gen, "hits": hits})

    left = probes.select("shard", "gen", "h", carry).groupBy("shard")
    right = seen.filters.select("shard", "gen", "seed", "rows", "solution").groupBy("shard")
    return left.cogroup(right).applyInPandas(ask, f"{carry} {kind}, gen int, hits bigint")


def seen_before(history: DataFrame, records: DataFrame, number_h: str, number_r: str, key: str = "key", batches: tuple[int, int] = (4, 4)) -> DataFrame:
    """The records (their number) whose key occurs in history or in a record with a smaller number."""
    spark = records.sparkSession
    seen = seal(history, records, number_h, number_r, key, batches)
    later = seen.keys.filter(F.col("gen") >= batches[0])
    answered = probe(later, seen, "key")
    base = shared_path(spark, "answers")
    answered = written(answered, base)
    maybe = answered.filter("hits <> 0")
    s = seen.keys.select(F.col("key").alias("k"), F.col("gen").alias("g"))
    known = maybe.join(s, (F.col("key") == F.col("k")) & (F.col("g") < F.col("gen")), "left_semi").select("key", "gen")
    # The complement is small and free of hot keys: the first record of each key that was new to its batch.
    new = later.join(known, ["key", "gen"], "left_anti").select(F.col("first").alias("__first"))
    return (
        records.filter(has_key(key))
        .select(number_r)
        .join(new, F.col(number_r) == F.col("__first"), "left_anti")
    )


def wrong_answers(history: DataFrame, records: DataFrame, number_h: str, number_r: str, key: str = "key", batches: tuple[int, int] = (4, 4)) -> DataFrame:
    """For each sealed batch: keys, bits a key, audit probes, their yes-answers and the rate of wrong answers.

    The audit asks for keys that are certainly absent: every distinct record key with a tail that makes it longer than
    the longest key of the history and the records. A batch that no audit key reached has the rate null.
    """
    seen = seal(history, records, number_h, number_r, key, batches)
    longest = seen.keys.agg(F.max(F.length("key"))).first()[0] or 0
    absent = (
        seen.keys.filter(F.col("gen") >= batches[0])
        .select(F.concat(F.col("key"), F.lit("~" * (longest + 1))).alias("key"))
        .distinct()
        .withColumn("h", F.xxhash64(F.lit(SEED), "key"))
        .withColumn("shard", F.pmod(F.col("h"), F.lit(seen.shards)).cast("int"))
        .withColumn("gen", F.lit(sum(batches)))
    )
    asked = probe(absent, seen, "key")
    gens = F.explode(F.sequence(F.lit(0), F.lit(sum(batches) - 1))).alias("g")
    rate = asked.select(gens, "hits").groupBy("g").agg(
        F.count(F.lit(1)).alias("audited"), F.sum(F.expr("shiftright(hits, g) & 1")).alias("said_yes")
    )
    made = seen.filters.groupBy("gen").agg(
        F.sum("n").alias("n_keys"), (F.sum(F.length("solution")) * 8 / F.sum("n")).alias("bits_per_key"), F.count(F.lit(1)).alias("filters")
    )
    return made.join(rate, made["gen"] == rate["g"], "left").select(
        "gen", "n_keys", "filters", "bits_per_key", "audited", "said_yes", F.try_divide("said_yes", "audited").alias("wrong_rate")
    )
