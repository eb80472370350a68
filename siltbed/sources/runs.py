"""Runs: sorted Parquet files of a log, one for each flush and each output file of a compaction, with their logs (WAL).

A run lies in runs/run_id=NNNNN and is sorted by (key, newest first), so Parquet's statistics prune ranges of keys;
a WAL file holds the JSON rows of the commits that are not yet flushed. Rows have one schema everywhere. The metadata of
a run (range of keys, rows, greatest commit_ts, bytes) comes from the footers of the files just written, and then lives
in the manifest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltbed.session import exists, hadoop_fs, read_bytes, size_of, write_bytes

#: Of a log, read by one task.
TASK_BYTES = 16 << 20

LOG_SCHEMA = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("version", T.LongType()),
        T.StructField("commit_ts", T.LongType()),
        T.StructField("value", T.StringType()),
        T.StructField("is_deleted", T.BooleanType()),
        T.StructField("create_revision", T.LongType()),
        T.StructField("mod_revision", T.LongType()),
        T.StructField("lease_id", T.LongType()),
    ]
)


def run_path(root: str, run_id: int) -> str:
    return f"{root}/runs/run_id={run_id:05d}"


def wal_path(root: str, memtable_id: int) -> str:
    return f"{root}/wal/{memtable_id:05d}"


def with_log_columns(rows: DataFrame) -> DataFrame:
    """rows with exactly the columns of a log, those it hasn't got as nulls."""
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in LOG_SCHEMA.fields])


def write_runs(rows: DataFrame, root: str, first_id: int, bloom: bool = True, block_bytes: int = 128 << 20, page_bytes: int = 1 << 20, next_id: int | None = None) -> list[dict]:
    """Write each partition of rows as a sorted run, numbered first_id and then from next_id (first_id + 1 if it isn't
    given) in the order of the partitions; returns the runs' metadata: run_id, first, last, rows, max_ts, bytes. Empty partitions give none.

    The key column gets a Parquet Bloom filter, which point reads use to skip row groups. The files are written beside
    the runs and moved to their places, so a run is there as a whole or not at all; a number that an earlier, lost
    attempt used is taken over.
    """
    spark = rows.sparkSession
    attempt = f"{root}/runs/_{uuid.uuid4().hex[:12]}"
    w = with_log_columns(rows).sortWithinPartitions("key", F.desc("commit_ts")).write.mode("overwrite")
    w = w.option("parquet.block.size", block_bytes).option("parquet.page.size", page_bytes)
    if bloom:
        # Sized by the keys there are: else each row group would carry a filter of the greatest size, 1 MiB.
        w = w.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
    w.parquet(attempt)
    fs, p = hadoop_fs(spark, attempt)
    files = sorted(x for s in fs.listStatus(p) if (x := s.getPath().getName()).endswith(".parquet"))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    metas = []
    for name, meta in zip(files, _footers(spark, attempt, files), strict=True):
        if not meta["rows"]:
            continue
        run_id = (first_id + 1 if next_id is None else next_id) + len(metas) - 1 if metas else first_id
        to = path(run_path(root, run_id))
        fs.delete(to, True)
        fs.mkdirs(to)
        fs.rename(path(f"{attempt}/{name}"), path(f"{run_path(root, run_id)}/data.parquet"))
        metas.append({"run_id": run_id, **meta})
    fs.delete(p, True)
    return metas


def write_run(rows: DataFrame, root: str, run_id: int) -> dict:
    """Write rows as one run, in one file; returns its metadata, without rows an empty one."""
    metas = write_runs(rows.coalesce(1), root, run_id)
    return metas[0] if metas else {"run_id": run_id, "first": None, "last": None, "max_ts": None, "rows": 0, "bytes": 0}


def _footers(spark: SparkSession, folder: str, names: list[str]) -> list[dict]:
    """first, last, rows, max_ts and bytes of the columns of each file, from its footer; from its rows where a bound is too long for it."""
    reader = spark.sparkContext._jvm.org.apache.parquet.hadoop.ParquetFileReader
    to_input = spark.sparkContext._jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath
    path, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for name in names:
        f = reader.open(to_input(path(f"{folder}/{name}"), conf))
        try:
            blocks = list(f.getFooter().getBlocks())
            rows = sum(b.getRowCount() for b in blocks)
            stats = [{c.getPath().toDotString(): c.getStatistics() for c in b.getColumns()} for b in blocks]
            known = all(s[c].hasNonNullValue() for s in stats for c in ("key", "commit_ts"))
            if known:
                firsts = [s["key"].genericGetMin().toStringUsingUTF8() for s in stats]
                lasts = [s["key"].genericGetMax().toStringUsingUTF8() for s in stats]
                top = max((s["commit_ts"].genericGetMax() for s in stats), default=None)
                meta = {"first": min(firsts, key=str.encode, default=None), "last": max(lasts, key=str.encode, default=None), "max_ts": top}
            else:
                df = spark.read.schema(LOG_SCHEMA).parquet(f"{folder}/{name}")
                meta = df.agg(F.min("key").alias("first"), F.max("key").alias("last"), F.max("commit_ts").alias("max_ts")).first().asDict()
            out.append({**meta, "rows": rows, "bytes": sum(b.getCompressedSize() for b in blocks)})
        finally:
            f.close()
    return out


def read_runs(spark: SparkSession, root: str, run_ids: list[int]) -> DataFrame:
    """The rows of some runs with run_id, in one scan; no runs give no rows."""
    if not run_ids:
        return spark.createDataFrame([], LOG_SCHEMA).withColumn("run_id", F.lit(None).cast("bigint"))
    paths = [run_path(root, r) for r in run_ids]
    df = spark.read.schema(T.StructType([*LOG_SCHEMA.fields, T.StructField("run_id", T.LongType())])).option("basePath", f"{root}/runs").parquet(*paths)
    return df


_NAMES = [f'"{c}":' for c in LOG_SCHEMA.names]
_quoted = json.encoder.encode_basestring_ascii


def _line(row: tuple) -> str:
    """A row as a JSON object without its nulls; a third of the time of json.dumps, which a log of many rows waits for."""
    text = [n + (_quoted(v) if isinstance(v, str) else str(v).lower()) for n, v in zip(_NAMES, row, strict=True) if v is not None]
    return "{" + ",".join(text) + "}"


def append_wal(spark: SparkSession, root: str, memtable_id: int, seq: int, rows: list[tuple]) -> None:
    """Make a commit durable before it is visible: one file, complete or absent. Nulls are left out of its lines."""
    text = "\n".join(map(_line, rows))
    write_bytes(spark, f"{wal_path(root, memtable_id)}/{seq:08d}.json", (text + "\n").encode())


def wal_ids(spark: SparkSession, root: str) -> list[int]:
    """The memtables that have a log, by listing the folder."""
    fs, p = hadoop_fs(spark, f"{root}/wal")
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(p)) if fs.exists(p) else []


def replay_wal(spark: SparkSession, root: str, memtable_id: int) -> Iterator[tuple]:
    """The rows of a memtable's log in order of writing."""
    path = wal_path(root, memtable_id)
    if not exists(spark, path):
        return
    fs, p = hadoop_fs(spark, path)
    for s in sorted(fs.listStatus(p), key=lambda s: s.getPath().getName()):
        name = s.getPath().getName()
        if name.endswith(".json"):
            for x in read_bytes(spark, f"{path}/{name}").decode().splitlines():
                rec = json.loads(x)
                yield tuple(rec.get(c) for c in LOG_SCHEMA.names)


def read_wal(spark: SparkSession, root: str, ids: list[int] | None = None) -> DataFrame:
    """All logged rows, or those of some memtables, as a table with memtable_id, for large logs. A damaged line is an error."""
    paths = [wal_path(root, m) for m in (wal_ids(spark, root) if ids is None else ids)]
    if not paths:
        return spark.createDataFrame([], LOG_SCHEMA).withColumn("memtable_id", F.lit(None).cast("bigint"))
    # By folder, as a glob of files lists each file in a task of its own.
    df = spark.read.schema(LOG_SCHEMA).option("pathGlobFilter", "*.json").option("mode", "FAILFAST").json(paths)
    df = df.withColumn("memtable_id", F.regexp_extract(F.input_file_name(), r"/wal/(\d+)/", 1).cast("bigint"))
    # A scan puts three or four of these small files into a task: as many as make up TASK_BYTES serve better.
    tasks = -(-sum(size_of(spark, p) for p in paths) // TASK_BYTES)
    return df.coalesce(max(tasks, spark.sparkContext.defaultParallelism))
