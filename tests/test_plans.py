"""Plans that matter at scale: what is pushed down, what is not shuffled."""

import contextlib
import io

from pyspark.sql import functions as F

from siltbed.operators import reads
from siltbed.operators.change_store import ChangeStore
from siltbed.sources import runs


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    return out.getvalue()


def log(spark, n=2000):
    return spark.range(n).select(
        F.format_string("k%05d", F.col("id") % 700).alias("key"), F.lit(0).cast("bigint").alias("version"), F.col("id").alias("commit_ts"),
        F.col("id").cast("string").alias("value"), (F.col("id") % 9 == 0).alias("is_deleted"),
    )


def test_range_reaches_the_scan(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    runs.write_run(log(spark), root, 1)
    df = reads.scan(runs.read_runs(spark, root, [1]), "k00100", "k00110", 5, 1500).select("key")
    text = plan(df)
    assert "GreaterThanOrEqual(key,k00100)" in text and "LessThan(key,k00110)" in text and "LessThanOrEqual(commit_ts,1500)" in text
    assert "TakeOrderedAndProject" in text
    assert "StringStartsWith(key,k0001)" in plan(reads.scan_prefix(runs.read_runs(spark, root, [1]), "k0001"))
    assert "EqualTo(key,k00005)" in plan(reads.get(runs.read_runs(spark, root, [1]), "k00005"))


def test_columns_are_pruned(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    runs.write_run(log(spark), root, 1)
    text = plan(runs.read_runs(spark, root, [1]).groupBy("run_id").agg(F.max("commit_ts")))
    assert "ReadSchema: struct<commit_ts:bigint>" in text


def test_merge_on_read_has_no_shuffle(spark, tmp_path):
    s = ChangeStore(spark, f"file://{tmp_path}/c", order=["commit_ts"], buckets=4)
    for part in log(spark).randomSplit([1.0, 1.0, 1.0], 1):
        s.append(part)
    text = plan(s.read())
    assert "Exchange" not in text and "Bucketed: true" in text
    assert s.read().count() == reads.snapshot(log(spark)).count()


def test_newest_is_reduced_before_its_shuffle(spark):
    text = plan(reads.snapshot(log(spark)))
    assert text.count("SortAggregate") + text.count("HashAggregate") >= 2 and text.count("Exchange (") <= 1
