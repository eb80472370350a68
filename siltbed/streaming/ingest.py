"""Streams of changes: appended as runs batch by batch, and the latest version of each key as keyed state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltbed.operators.change_store import ChangeStore


def read_changes(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 8) -> DataFrame:
    """A stream of Parquet files of changes; files_per_batch holds back a backlog, so that a batch stays bounded."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def ingest(
    stream: DataFrame,
    store: ChangeStore,
    checkpoint: str,
    trigger: dict | None = None,
    after: Callable[[ChangeStore], None] | None = None,
    query_name: str = "ingest",
) -> StreamingQuery:
    """Append each micro-batch of a stream to a store as one run, then do maintenance (by default: compact if due).

    A batch that is delivered again after a failure has the same number and isn't appended twice.
    """

    def batch(df: DataFrame, number: int) -> None:
        store.append(df, batch_id=f"{query_name}-{number}")
        (after or (lambda s: s.compact()))(store)

    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).queryName(query_name)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def latest_by_key(stream: DataFrame) -> DataFrame:
    """The newest version of each key as a streaming aggregate (update or complete mode): the state is one row a key.

    It is kept by Spark's state store; out-of-order and repeated deliveries don't matter, as only the greatest
    (commit_ts, ...) is kept. Deletes stay as rows, for a later older put must not bring the key back.
    """
    keep = [c for c in stream.columns if c not in ("key", "commit_ts")]
    s = stream.filter(F.col("key").isNotNull() & (F.length("key") > 0))
    best = s.groupBy("key").agg(F.max(F.struct("commit_ts", *keep)).alias("b"))
    return best.select("key", *[F.col(f"b.{c}").alias(c) for c in ("commit_ts", *keep)])


def latest_with_state(stream: DataFrame) -> DataFrame:
    """The same as a custom stateful operator: emits a key only when its newest version changes.

    stream: key string, commit_ts bigint, value string, is_deleted boolean. Output: the same columns, in append mode.
    State: the newest version of each key.
    """
    import pandas as pd

    def step(key, batches, state):
        have = state.get if state.exists else None
        best = have
        for pdf in batches:
            for ts, value, gone in zip(pdf["commit_ts"], pdf["value"], pdf["is_deleted"], strict=True):
                if best is None or int(ts) > best[0]:
                    best = (int(ts), None if value is None else str(value), bool(gone) if gone is not None else False)
        if best is not None and best != have:
            state.update(best)
            yield pd.DataFrame({"key": [key[0]], "commit_ts": [best[0]], "value": [best[1]], "is_deleted": [best[2]]})

    schema = "key string, commit_ts bigint, value string, is_deleted boolean"
    s = stream.select("key", "commit_ts", "value", "is_deleted").filter(F.col("key").isNotNull() & (F.length("key") > 0))
    return s.groupBy("key").applyInPandasWithState(step, schema, "commit_ts bigint, value string, is_deleted boolean", "append", "NoTimeout")


def drain(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there now and return its table (memory sink: results of bounded size, tests)."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
