"""Consolidating many small sorted files into few well-sized ones.

Plan: the manifest log says which files are in use; those below a size are taken together, however many they are.
Runs: the files' records, sorted as they are in the files, are the sorted runs to merge. Exchange: each run is cut at
the bounds of key ranges, so every range gets a sorted piece of each run; bounds come from a sample of (key, order
columns), so a key that holds most records spans several ranges. Merge: the pieces of a range are merged with a heap of
their heads; from the least one, all records before the next head are taken at once. Nothing is sorted again.
Roll: the merged stream is cut into files when the sum of bytes reaches the target, and each file's key range,
count, bytes and source files are recorded as it is written. Records are neither dropped nor deduplicated.

A range holds about the target's bytes, which is what one task keeps in memory. Files are named after the attempt that
writes them, and only those named in the committed metadata count, so a lost executor leaves nothing behind that is
read. Python workers write them, so the shared folder must be of a kind that pyarrow knows (file, hdfs, s3, gs).

Defined cases: null and empty lists and nulls inside them name nothing; a file listed twice counts once, with its
known size; a file that is listed nowhere or without a size isn't known to be small; records with a null or empty key
are left out; no files or no records give no outputs.
"""

from __future__ import annotations

import heapq
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltbed.session import broadcast_if_small, hadoop_fs, remove, shared_path, ship, written
from siltbed.sources.tables import has_key

#: Bytes of an entry besides key and value: two lengths of 16 bits, a 16-bit offset, version and timestamp of 64 bits.
ENTRY_OVERHEAD = 22
SMALL = 32_768
TARGET = 128 << 20
#: Sort keys kept as Python objects at once, over all runs of a range.
KEPT_KEYS = 200_000


def _ids(array: Column) -> Column:
    """The array without nulls; a null array is empty."""
    return F.coalesce(F.filter(array, lambda x: x.isNotNull()), F.array().cast("array<bigint>"))


def manifest_effects(manifest: DataFrame) -> DataFrame:
    """(produced, consumed): arrays of file ids for each record that has an effect.

    A flush produces flush_id and produced_ssts. A compaction produces produced_ssts and its output_ids; if it names
    none it was not carried out and consumes nothing; what it reads and produces again is not consumed. Torn records,
    memtable and freeze records have no effect; a null list is empty, and so are nulls inside lists.
    """
    t = F.col("compaction_task")
    made = _ids(F.col("produced_ssts"))
    flush = F.col("type") == "flush"
    compaction = F.col("type") == "compaction"
    produced = F.when(flush, F.array_union(made, _ids(F.array("flush_id")))).when(
        compaction, F.array_union(made, _ids(t["output_ids"]))
    )
    read = F.when(compaction, F.array_union(_ids(t["upper_ids"]), _ids(t["lower_ids"]))).otherwise(F.array().cast("array<bigint>"))
    return (
        manifest.select("record_no", produced.alias("produced"), read.alias("read"))
        .filter(F.size("produced") > 0)
        .select("record_no", "produced", F.array_except("read", "produced").alias("consumed"))
    )


def files_in_use(manifest: DataFrame) -> DataFrame:
    """(sst_id) of each file that some record produces and no carried-out compaction consumes."""
    effects = manifest_effects(manifest)
    produced = effects.select(F.explode("produced").alias("sst_id"), F.lit(0).alias("gone"))
    consumed = effects.select(F.explode("consumed").alias("sst_id"), F.lit(1).alias("gone"))
    state = produced.unionByName(consumed).groupBy("sst_id").agg(F.max("gone").alias("gone"), F.min("gone").alias("made"))
    return state.filter("gone = 0 and made = 0").select("sst_id")


def listing(files: DataFrame) -> DataFrame:
    """One row a file of a directory listing with repeats: the greatest known size, count and key range."""
    return files.groupBy("sst_id").agg(
        F.max("size_bytes").alias("size_bytes"),
        F.max("n_entries").alias("n_entries"),
        F.min("first_key").alias("first_key"),
        F.max("last_key").alias("last_key"),
    )


def undersized(manifest: DataFrame, files: DataFrame, below: int = SMALL) -> DataFrame:
    """The files in use smaller than below bytes; a file whose size is nowhere listed isn't known to be small."""
    return listing(files).filter(F.col("size_bytes") < below).join(files_in_use(manifest), "sst_id", "left_semi")


def entry_bytes(key: str = "key", value: str = "value") -> Column:
    return (
        F.coalesce(F.octet_length(key), F.lit(0)) + F.coalesce(F.octet_length(value), F.lit(0)) + F.lit(ENTRY_OVERHEAD)
    ).cast("bigint")


def merged_order(columns: list) -> np.ndarray:
    """The positions of rows in sorted order. columns: the sort columns (pyarrow arrays) of concatenated sorted runs.

    A run ends where the next row is smaller. Nulls come first, strings compare byte for byte.
    """
    n = len(columns[0])

    def keys(at: int, stop: int) -> list[tuple]:
        parts = []
        for c in columns:
            x = c.slice(at, stop - at)
            values = x.cast("binary").to_pylist() if str(x.type) in ("string", "large_string") else x.to_pylist()
            parts.append([(v is not None, v) for v in values] if c.null_count else values)
        return list(zip(*parts, strict=True))

    starts, last = [0] if n else [], None
    for at in range(0, n, KEPT_KEYS):
        some = keys(at, min(n, at + KEPT_KEYS))
        if last is not None and some[0] < last:
            starts.append(at)
        starts += [at + i for i in range(1, len(some)) if some[i] < some[i - 1]]
        last = some[-1]
    if len(starts) < 2:
        return np.arange(n)
    ends = [*starts[1:], n]
    chunk = max(16, KEPT_KEYS // len(starts))
    have = [keys(a, min(b, a + chunk)) for a, b in zip(starts, ends, strict=True)]
    base, at = list(starts), [0] * len(starts)  # where a run's kept keys begin, and its head among them
    heap = [(h[0], r) for r, h in enumerate(have)]
    heapq.heapify(heap)
    out, filled = np.empty(n, np.int64), 0
    while heap:
        _, r = heapq.heappop(heap)
        k, i = have[r], at[r]
        if heap:
            bound, other = heap[0]
            stop = max(i + 1, (bisect_right if r < other else bisect_left)(k, bound, i))
        else:
            stop = len(k)
        out[filled : filled + stop - i] = np.arange(base[r] + i, base[r] + stop)
        filled += stop - i
        if stop == len(k):
            base[r] += stop
            k, stop = keys(base[r], min(ends[r], base[r] + chunk)), 0
            have[r] = k
        at[r] = stop
        if k:
            heapq.heappush(heap, (k[stop], r))
    return out


def _location(spark, path: str) -> str:
    """path as a URI that pyarrow understands."""
    fs, p = hadoop_fs(spark, path)
    uri = fs.makeQualified(p).toString()
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def merge_runs(records: DataFrame, order: list[str], size: Column, target: int, path: str, source: str | None = None) -> DataFrame:
    """Write records sorted by order into files of about target bytes under path.

    Returns one row a file: output, file, records, bytes, first_key, last_key, sources. order[0] is the key. Files have
    disjoint ranges of order, and output rises with the range. A file passes target by one record at most. sources
    counts the file's records by source, a whole-numbered column. No records give no files.
    """
    spark = records.sparkSession
    ship(spark)
    names = records.columns
    runs = written(records.withColumn("__bytes", size).sortWithinPartitions(*order), f"{path}-runs")
    total = runs.agg(F.sum("__bytes")).first()[0] or 0
    ranges = max(1, -(-total // target))
    # The range number leads the output's number. Rows equal in all of order may still part, by their content.
    spread = runs.repartitionByRange(ranges, *order, F.xxhash64(*[c for c in names if not _has_map(runs.schema[c].dataType)]))
    kind = runs.schema[order[0]].dataType.simpleString()
    to = _location(spark, path)

    def merge(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow.fs import FileSystem
        from pyspark import TaskContext

        pieces = [b for b in batches if b.num_rows]
        if not pieces:
            return
        table = pa.Table.from_batches(pieces).combine_chunks()
        table = table.take(pa.array(merged_order([table.column(c).chunk(0) for c in order])))
        ends = np.cumsum(table.column("__bytes").to_numpy())
        fs, folder = FileSystem.from_uri(to)
        fs.create_dir(folder, recursive=True)
        at, nth, attempt, rows = 0, 0, uuid.uuid4().hex[:12], []
        while at < len(ends):
            full = (ends[at - 1] if at else 0) + target
            stop = min(len(ends), int(np.searchsorted(ends, full, "left")) + 1)
            part = table.slice(at, stop - at)
            number = (TaskContext.get().partitionId() << 32) + nth
            name = f"{number:016x}-{attempt}.parquet"
            pq.write_table(part.select(names), f"{folder}/{name}", filesystem=fs)
            count: dict[int, int] = {}
            if source:
                values, n = np.unique(part.column(source).drop_null().to_numpy(), return_counts=True)
                count = dict(zip(values.tolist(), n.tolist(), strict=True))
            key = part.column(order[0])
            rows.append((number, name, len(part), int(ends[stop - 1] - (ends[at - 1] if at else 0)), key[0], key[-1], list(count.items())))
            at, nth = stop, nth + 1
        cols = list(zip(*rows, strict=True))
        count_kind = pa.list_(pa.struct([("source", pa.int64()), ("records", pa.int64())]))
        firsts, lasts = (pa.array([x.as_py() for x in c], table.schema.field(order[0]).type) for c in cols[4:6])
        counts = pa.array([[{"source": s, "records": n} for s, n in c] for c in cols[6]], count_kind)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int64()), pa.array(cols[1]), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), firsts, lasts, counts],
            names=["output", "file", "records", "bytes", "first_key", "last_key", "sources"],
        )

    made = f"output bigint, file string, records bigint, bytes bigint, first_key {kind}, last_key {kind}, sources array<struct<source:bigint,records:bigint>>"
    done = written(spread.mapInArrow(merge, made), f"{path}-metadata")
    _drop_orphans(done, path)
    remove(spark, f"{path}-runs")
    return done


def _has_map(t: T.DataType) -> bool:
    return "map<" in t.simpleString()


def _drop_orphans(made: DataFrame, path: str) -> None:
    """Delete the files of attempts that were lost: there are more files than outputs only then."""
    spark = made.sparkSession
    fs, p = hadoop_fs(spark, path)
    have = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    have = [x for x in have if x.endswith(".parquet")]
    if len(have) > made.count():
        found = spark.createDataFrame([(x,) for x in have], "file string")
        remove(spark, *[f"{path}/{r[0]}" for r in found.join(made, "file", "left_anti").select("file").collect()])


class Consolidation:
    """One consolidation: plan, merge, metadata.

    log holds the records of a flushed file under its memtable_id, which is the file's number. The plan has all
    undersized files in use; those that a compaction wrote have no records under a memtable_id, so they are planned
    but not merged here: they are the rest.
    """

    def __init__(self, manifest: DataFrame, files: DataFrame, log: DataFrame, below: int = SMALL, target: int = TARGET) -> None:
        spark = manifest.sparkSession
        self.base = shared_path(spark, "consolidation")
        self.plan = written(undersized(manifest, files, below), f"{self.base}/plan")
        few = broadcast_if_small(self.plan.select("sst_id"), f"{self.base}/plan")
        self.records = log.filter(has_key()).join(few, F.col("memtable_id") == F.col("sst_id"), "left_semi")
        order = ["key", "commit_ts", "mod_revision", "log_id"]
        self.outputs = merge_runs(self.records, order, entry_bytes(), target, f"{self.base}/files", "memtable_id")

    def files(self) -> DataFrame:
        """The files of the plan, each once, with the records of it that the outputs hold: sst_id, size_bytes,
        n_entries, records, merged. A file of the rest isn't merged and has 0 records."""
        merged = self.outputs.select(F.explode("sources").alias("s")).groupBy(F.col("s.source").alias("sst_id")).agg(F.sum("s.records").alias("records"))
        return self.plan.join(merged, "sst_id", "left").select(
            "sst_id", "size_bytes", "n_entries", F.coalesce("records", F.lit(0)).alias("records"), F.col("records").isNotNull().alias("merged")
        )
