"""A log-structured store of changes: sorted runs, merge on read with tombstones, compaction by size.

Layout. A table in the shared folder, partitioned by run and bucketed and sorted by key. Every append writes one run:
the newest change of each key in the batch, sorted by key. A JSON manifest, replaced in one step, lists the live runs;
readers list runs from it only. A run's name is unique to the attempt that writes it, so what a lost job left behind
is never read, also if its batch is written again.

Read. The buckets of all runs meet in one task each without a shuffle; sorting rows that are already sorted runs is
a merge (Spark's sort finds the runs), and the newest change of each key is kept. Tombstones hide a key only after
the newest change was chosen, and compaction keeps them, so a late, older put can't bring a deleted key back.

Compaction. Once trigger runs are live, the newest ones are merged, each older run with them as long as it is at most
GROWTH times as large as they are together. So a large run is rewritten only when it grows by half at least, and the
number of live runs stays logarithmic. Which runs are merged doesn't matter for the result, as the order columns and
not the age of a run decide. A full compaction may change the number of buckets.

Order. A change is newer if its order columns, compared from left to right, are greater. Rows equal in key and order
columns are repeats of one change; one of them is kept (the greatest by the remaining columns, so that the outcome is
the same however the rows are spread). Null in an order column counts as older than any value.

Skew. A batch is reduced to one row a key before its shuffle, inside each map task; a key that holds a third of all
rows reaches the shuffle as one row a task.

Defined cases: rows with a null or empty key are refused into no run (the engine treats them as errors); a null
tombstone flag means false; an empty batch gives an empty run, an empty store reads as no rows; columns besides
key, order and tombstone are carried as the payload, whatever their names.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltbed.session import exists, read_bytes, remove, shared_path, size_of, write_bytes
from siltbed.sources.tables import has_key

RUN = "__run"
BODY = "__body"
GROWTH = 2


def newest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row a key: the one greatest by the order columns, then by the remaining ones.

    Map-side: each task reduces its rows to one a key before the exchange.
    """
    rest = sorted(c for c in df.columns if c != key and c not in order)
    orderable = [c for c in rest if not _has_map(df.schema[c].dataType)]
    packed = F.struct(*[F.col(f"`{c}`") for c in [*order, *orderable]])
    if len(orderable) == len(rest):
        best = df.groupBy(F.col(f"`{key}`").alias(key)).agg(F.max(packed).alias(BODY))
    else:  # maps have no order: they ride along
        best = df.groupBy(F.col(f"`{key}`").alias(key)).agg(
            F.max_by(F.struct(*[F.col(f"`{c}`") for c in [*order, *rest]]), packed).alias(BODY)
        )
    return best.select(*[F.col(f"`{key}`") if c == key else F.col(BODY)[c].alias(c) for c in df.columns])


def _has_map(t: T.DataType) -> bool:
    if isinstance(t, T.MapType):
        return True
    if isinstance(t, T.ArrayType):
        return _has_map(t.elementType)
    return isinstance(t, T.StructType) and any(_has_map(f.dataType) for f in t.fields)


@dataclass
class ChangeStore:
    spark: SparkSession
    path: str
    key: str = "key"
    order: list[str] = field(default_factory=lambda: ["commit_ts", "mod_revision"])
    deleted: str = "is_deleted"
    buckets: int = 0
    trigger: int = 4  #: with so many live runs, compaction begins

    def __post_init__(self) -> None:
        self.manifest = f"{self.path}/MANIFEST.json"
        if exists(self.spark, self.manifest):
            self.state = json.loads(read_bytes(self.spark, self.manifest))
        else:
            buckets = self.buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            self.state = {"live": [], "buckets": buckets, "table": self._new("runs"), "schema": None, "appended": []}
        self._open()

    @staticmethod
    def _new(name: str) -> str:
        return f"{name}-{uuid.uuid4().hex[:12]}"

    def _open(self) -> None:
        self.name = f"siltbed_{uuid.uuid4().hex[:16]}"
        self.buckets = self.state["buckets"]
        self.schema = T.StructType.fromJson(self.state["schema"]) if self.state["schema"] else None
        if self.schema is not None:
            self._register()

    # -- writing

    def append(self, changes: DataFrame, batch_id: str | None = None) -> str | int:
        """Write one sorted run and publish it; returns its name. A batch_id already appended is not appended again:
        then -1."""
        if batch_id is not None and batch_id in self.state["appended"]:
            return -1
        clean = changes.filter(has_key(f"`{self.key}`")).withColumn(
            self.deleted, F.coalesce(F.col(f"`{self.deleted}`"), F.lit(False))
        )
        run = self._write(newest(clean, self.key, self.order))
        done = [batch_id] if batch_id is not None else []
        self._publish(live=[*self.state["live"], self._sized(run)], appended=[*self.state["appended"], *done])
        return run

    def _write(self, df: DataFrame) -> str:
        run = self._new("r")
        df = df.select(F.lit(run).alias(RUN), *df.columns)
        if self.schema is None:
            self.schema = df.schema
            self.state["schema"] = df.schema.jsonValue()
        (
            df.write.format("parquet")
            .mode("append")
            .partitionBy(RUN)
            .bucketBy(self.buckets, self.key)
            .sortBy(self.key)
            .option("path", f"{self.path}/{self.state['table']}")
            .saveAsTable(self.name)
        )
        return run

    def _sized(self, run: str) -> list:
        return [run, size_of(self.spark, f"{self.path}/{self.state['table']}/{RUN}={run}")]

    def _register(self) -> None:
        """Name an existing table in this session's catalogue (its files stay where they are)."""
        fields = [f for f in self.schema.fields if f.name != RUN] + [self.schema[RUN]]
        cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        self.spark.sql(
            f"CREATE TABLE {self.name} ({cols}) USING parquet OPTIONS (path '{self.path}/{self.state['table']}') "
            f"PARTITIONED BY ({RUN}) CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) INTO {self.buckets} BUCKETS"
        )
        self.spark.catalog.recoverPartitions(self.name)

    def _publish(self, **changed) -> None:
        """The state changes in memory only once it has changed on disk."""
        state = self.state | changed
        write_bytes(self.spark, self.manifest, json.dumps(state).encode())
        self.state = state

    # -- reading

    def runs(self) -> list[str]:
        return [run for run, _ in self.state["live"]]

    def changes(self, runs: list[str] | None = None) -> DataFrame:
        """All rows of the live runs, or of some of them."""
        if self.schema is None:
            raise ValueError("the store has no run yet")
        return self.spark.table(self.name).filter(F.col(RUN).isin(self.runs() if runs is None else runs))

    def _merged(self, runs: list[str] | None = None) -> DataFrame:
        return newest(self.changes(runs).drop(RUN), self.key, self.order)

    def read(self) -> DataFrame:
        """The current state: each live key once, with its newest change."""
        return self._merged().filter(~F.col(f"`{self.deleted}`"))

    # -- compaction

    def due(self) -> list[str]:
        """The runs to merge now, if any."""
        live = self.state["live"]
        take, size = 1, live[-1][1] if live else 0
        while take < len(live) and live[-take - 1][1] <= GROWTH * size:
            take, size = take + 1, size + live[-take - 1][1]
        return [run for run, _ in live[-take:]] if len(live) >= max(self.trigger, 2) and take > 1 else []

    def compact(self, force: bool = False, buckets: int = 0) -> bool:
        """Merge the runs that are due; if forced, all live runs into one, into another number of buckets if that is
        given. Returns whether anything was merged.

        Tombstones stay: an older put that a later append delivers must still find its key deleted. The merged run is
        published before the runs it replaces are deleted.
        """
        if force and buckets and buckets != self.buckets and self.runs():
            return self._rebuild(buckets)
        runs = self.runs() if force else self.due()
        if len(runs) < 2:
            return False
        run = self._write(self._merged(runs))
        kept = [x for x in self.state["live"] if x[0] not in runs]
        self._publish(live=[*kept, self._sized(run)])
        remove(self.spark, *[f"{self.path}/{self.state['table']}/{RUN}={r}" for r in runs])
        self.spark.catalog.refreshTable(self.name)
        return True

    def _rebuild(self, buckets: int) -> bool:
        """All runs into one, in a new table with another number of buckets."""
        old, merged, before = self.state["table"], self._merged(), self.state
        mine = self.name
        self.name, self.buckets, self.state = f"siltbed_{uuid.uuid4().hex[:16]}", buckets, before | {"table": self._new("runs")}
        try:
            self._publish(live=[self._sized(self._write(merged))], buckets=buckets)
        except BaseException:
            self.name, self.buckets, self.state = mine, before["buckets"], before
            raise
        remove(self.spark, f"{self.path}/{old}")
        return True


def apply_changes(
    changes: DataFrame,
    arrival: str,
    key: str = "key",
    order: tuple[str, ...] = ("commit_ts", "mod_revision"),
    deleted: str = "is_deleted",
    batches: int = 6,
    name: str = "changes",
) -> DataFrame:
    """The current state from a table of deliveries: appended in batches by arrival, compacted when due, merged on
    read.

    batches is the number of runs that the deliveries are cut into by ranges of arrival, which only bounds the size
    of one append; the result doesn't depend on it, nor on when compactions happen. A null in arrival belongs to the
    first batch. Result: the columns of changes without arrival.
    """
    spark = changes.sparkSession
    store = ChangeStore(spark, shared_path(spark, name), key, list(order), deleted)
    lo, hi = changes.agg(F.min(arrival), F.max(arrival)).first()
    if lo is None:
        store.append(changes.drop(arrival))
        return store.read()
    step = max(1, -(-(hi - lo + 1) // batches))
    cuts = list(range(lo, hi + 1, step))
    for i, a in enumerate(cuts):
        inside: Column = F.col(arrival) >= a
        if i + 1 < len(cuts):
            inside = inside & (F.col(arrival) < a + step)
        if i == 0:
            inside = F.col(arrival).isNull() | (F.col(arrival) < a + step)
        store.append(changes.filter(inside).drop(arrival), batch_id=str(a))
        if i + 1 < len(cuts):
            store.compact()
    return store.read()
