"""Session helpers: the shared folder, shipping the package to executors, checked broadcasts."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its measured size is at most this many bytes.
BROADCAST_BYTES = 2 << 20


def build_session(app: str = "siltbed", cpus: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.split("[")[0] == "local"


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share, as named in spark.checkpoint.dir.

    Where the setting is absent, a temporary folder serves on a local master; elsewhere that is an error,
    as a folder of one machine would be lost with it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(root)
        return root.rstrip("/")
    if not is_local(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="siltbed-")
    spark.conf.set("spark.checkpoint.dir", root)
    spark.sparkContext.setCheckpointDir(root)
    return root


_MADE: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new, unused path for a table in the shared folder; sweep() removes it."""
    path = f"{shared_root(spark)}/siltbed/{name}-{uuid.uuid4().hex[:12]}"
    _MADE.append(path)
    return path


def sweep(spark: SparkSession) -> int:
    """Remove the intermediate tables that this process made; call it once their results were written or collected.

    Results are read lazily from these tables, so nothing removes them earlier. Returns how many there were.
    """
    gone, _MADE[:] = list(_MADE), []
    remove(spark, *gone)
    return len(gone)


def hadoop_fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        fs, p = hadoop_fs(spark, path)
        fs.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop_fs(spark, path)
    return fs.exists(p)


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of all files under path; 0 if there is none."""
    fs, p = hadoop_fs(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


_DEFAULT: dict[str, str] = {}  # the scheme of paths without one, by application


def _local(spark: SparkSession, path: str) -> str | None:
    """The name of a file on this machine for Python's own functions; None on any other file system."""
    if path.startswith("file:/"):
        return "/" + path[5:].lstrip("/")
    sc = spark.sparkContext
    if path.startswith("/") and sc.applicationId not in _DEFAULT:
        _DEFAULT[sc.applicationId] = sc._jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(sc._jsc.hadoopConfiguration()).getScheme()
    return path if path.startswith("/") and _DEFAULT[sc.applicationId] == "file" else None


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Write to a temporary name and replace path in one step: at any moment a reader sees the old file or the new one.

    A local folder replaces by rename. Other file systems refuse to rename onto a file, and are asked to overwrite
    while renaming, which those with real renames do in one step.
    """
    if local := _local(spark, path):  # the same without thirty calls to the JVM, which is on this machine too
        tmp = f"{local}.{uuid.uuid4().hex[:8]}.tmp"
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(tmp, "wb") as f:
            f.write(data)
        os.replace(tmp, local)
        return
    fs, p = hadoop_fs(spark, path)
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    hadoop = jvm.org.apache.hadoop.fs
    tmp = hadoop.Path(f"{path}.{uuid.uuid4().hex[:8]}.tmp")
    out = fs.create(tmp, True)
    out.write(bytearray(data))
    out.close()
    rename = getattr(hadoop, "Options$Rename")
    how = gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    hadoop.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(tmp, p, how)


def read_bytes(spark: SparkSession, path: str) -> bytes:
    fs, p = hadoop_fs(spark, path)
    s = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(s))
    finally:
        s.close()


def written(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as Parquet and return the table just written; it cuts the lineage and survives lost executors."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(small: DataFrame, path: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast of a table written at path if its files are at most limit bytes (Parquet of short rows
    unpacks to a few times that); beyond it Spark chooses a shuffled join."""
    return F.broadcast(small) if size_of(small.sparkSession, path) <= limit else small


def balanced(df: DataFrame) -> DataFrame:
    """df over all cores before work that is heavy for each row, if its scan has far fewer partitions than that.

    At scale a scan has more partitions than cores, and nothing is moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, b.schema) as w:
            w.write_batch(b)
        yield pa.record_batch({"batch": [out.getvalue().to_pybytes()]})


def local_rows(df: DataFrame) -> Iterator[tuple]:
    """The rows of df in their order, on the driver: a partition at a time like toLocalIterator, but as Arrow batches and
    plain tuples, which takes a fraction of its time."""
    ship(df.sparkSession)
    for packed in df.mapInArrow(_packed, "batch binary").toLocalIterator():
        yield from zip(*map(_values, pa.ipc.open_stream(packed[0]).read_all().columns), strict=True)


def _values(c: pa.ChunkedArray) -> list:
    plain = pa.types.is_string(c.type) or not c.null_count and (pa.types.is_integer(c.type) or pa.types.is_boolean(c.type))
    return c.to_numpy(zero_copy_only=False).tolist() if plain else c.to_pylist()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, whatever their working directory: its source goes out as a zip, once a
    session."""
    if spark.conf.get("spark.siltbed.shipped", None):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, files in os.walk(here):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    path = f"{shared_root(spark)}/siltbed/package-{uuid.uuid4().hex[:12]}/siltbed.zip"
    write_bytes(spark, path, buf.getvalue())
    spark.sparkContext.addPyFile(path)
    spark.conf.set("spark.siltbed.shipped", "1")
