"""Processing only new or changed records, by fingerprints of partitions.

A partition's fingerprint is its number of rows and the sum of a 64-bit hash of each row: both add up in any order,
so they are computed with map-side partial sums and don't depend on how rows lie in files. A partition is recomputed
only if its fingerprint differs from the one recorded when it was last processed, and its result is replaced as a
whole by dynamic partition overwrite. The fingerprint is recorded after the result is in place: a run that dies in
between finds the partition still changed and replaces it again, so nothing is skipped and nothing appears twice.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltbed.session import broadcast_if_small, exists, hadoop_fs, read_bytes, remove, shared_path, size_of, write_bytes, written
from siltbed.sources.tables import has_key


MARK = "__marker"
#: The cover of the memtables is broadcast up to this size on disk, else joined by a shuffle.
COVER_BYTES = 2 << 20
#: Fixed widths, in revisions, of a partition of the result and of a cell, the unit of the fingerprints inside it.
SPAN, CELL = 1 << 17, 64
#: Up to so many changed partitions are also given to the scan as ranges, so that it skips row groups.
SCAN_PARTS, SCAN_RANGES = 1_000, 64


def row_hash(*columns: str) -> Column:
    """A 64-bit hash of a row, in which a null differs from any value and from a null in the next column."""
    parts: list[Column] = []
    for c in columns:
        parts += [F.col(f"`{c}`"), F.col(f"`{c}`").isNull()]
    return F.xxhash64(*parts)


def additive(hash_col: Column) -> Column:
    """The sum of hashes, wide enough never to overflow."""
    return F.sum(hash_col.cast("decimal(20,0)"))


def fingerprints(df: DataFrame, part: str, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """(part, n, h) of each partition; with where, of the rows that satisfy it."""
    cols = columns or sorted(c for c in df.columns if c != part)
    if where is not None:
        df = df.filter(where)
    return df.groupBy(F.col(part).alias(part)).agg(F.count(F.lit(1)).alias("n"), additive(row_hash(*cols)).alias("h"))


class IncrementalTable:
    """The result of a function of each partition of a source, kept up to date.

    path holds the result (partitioned by part) and, beside it, the fingerprints of the last successful run in
    generations; the newest complete generation counts. Every recomputed partition also gets one marker row, so that
    a partition whose result is now empty is replaced like any other; read() leaves the markers out.
    """

    def __init__(self, spark: SparkSession, path: str, part: str) -> None:
        self.spark, self.path, self.part = spark, path, part

    def _generations(self) -> list[int]:
        fs, p = hadoop_fs(self.spark, f"{self.path}/fingerprints")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(x[2:]) for x in names if x.startswith("g=") and exists(self.spark, f"{self.path}/fingerprints/{x}/_SUCCESS"))

    def recorded(self) -> DataFrame | None:
        gens = self._generations()
        return self.spark.read.parquet(f"{self.path}/fingerprints/g={gens[-1]}") if gens else None

    def record(self, prints: DataFrame) -> None:
        """Make prints the fingerprints of the last successful run; earlier generations go afterwards."""
        gens = self._generations()
        prints.write.mode("overwrite").parquet(f"{self.path}/fingerprints/g={(gens[-1] if gens else 0) + 1}")
        remove(self.spark, *[f"{self.path}/fingerprints/g={g}" for g in gens])

    def changed(self, now: DataFrame) -> DataFrame:
        """The partitions that are new, different or gone since the recorded run."""
        old = self.recorded()
        if old is None:
            return now.select(self.part)
        a, b = now.alias("a"), old.alias("b")
        same_part = F.col(f"a.{self.part}").eqNullSafe(F.col(f"b.{self.part}"))
        both = a.join(b, same_part, "full_outer")
        differ = ~(F.col("a.n").eqNullSafe(F.col("b.n")) & F.col("a.h").eqNullSafe(F.col("b.h")))
        return both.filter(differ).select(F.coalesce(F.col(f"a.{self.part}"), F.col(f"b.{self.part}")).alias(self.part))

    def update(
        self,
        source: DataFrame,
        compute: Callable[[DataFrame], DataFrame],
        prints: DataFrame | None = None,
        ranged: tuple[str, int] | None = None,
    ) -> int:
        """Recompute the changed partitions; returns their number. compute must keep the column part.

        prints are the fingerprints of source, where the caller has them already. ranged, if part is a column of source
        divided by a number and rounded down, is that column and number: then few changed partitions are read by
        ranges of it. A partition that is gone, or whose result is now empty, loses its old rows. If nothing changed,
        nothing is written.
        """
        made = shared_path(self.spark, "fingerprints")
        now = written(prints if prints is not None else fingerprints(source, self.part), made)
        listed = shared_path(self.spark, "changed")
        changed = written(self.changed(now), listed)
        n = changed.count()
        if n or not exists(self.spark, f"{self.path}/data"):
            few = broadcast_if_small(changed.withColumnRenamed(self.part, "__p"), listed)
            if ranged and n <= SCAN_PARTS:
                source = source.filter(_in_ranges(ranged, [r[0] for r in changed.collect()]))
            keep = source.join(few, F.col(self.part).eqNullSafe(F.col("__p")), "left_semi")
            marked = compute(keep).withColumn(MARK, F.lit(False)).unionByName(
                changed.withColumn(MARK, F.lit(True)), allowMissingColumns=True
            )
            # All rows of a partition into one task (a very large partition into several), so that it gets few files.
            (
                marked.hint("rebalance", self.part)
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy(self.part)
                .parquet(f"{self.path}/data")
            )
            write_bytes(self.spark, f"{self.path}/schema.json", marked.schema.json().encode())
            self.record(now)
        remove(self.spark, made, listed)
        return n

    def read(self) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(read_bytes(self.spark, f"{self.path}/schema.json")))
        df = self.spark.read.schema(schema).parquet(f"{self.path}/data")
        return df.filter(~F.col(MARK)).drop(MARK)


def _in_ranges(ranged: tuple[str, int], parts: list[int]) -> Column:
    """A filter for the scan that holds for all rows of these partitions, and for few others: at most SCAN_RANGES
    ranges, made by closing the smallest gaps. Rows without a value are let through."""
    column, span = ranged
    parts = sorted(parts)
    gaps = sorted(range(1, len(parts)), key=lambda i: parts[i - 1] - parts[i])[: SCAN_RANGES - 1]
    cuts = [0, *sorted(i for i in gaps if parts[i] > parts[i - 1] + 1), len(parts)]
    cond = F.col(column).isNull()
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a < b:
            cond = cond | F.col(column).between(parts[a] * span, (parts[b - 1] + 1) * span - 1)
    return cond


def outcomes(reports: DataFrame) -> DataFrame:
    """One row a run: its last report by reported_at (equal times: the greater report_id). Null run_id is no run."""
    last = reports.filter("run_id is not null").groupBy("run_id").agg(
        F.max(F.struct("reported_at", "report_id", "status", "first_memtable_id", "last_memtable_id", "to_revision")).alias("r")
    )
    return last.select("run_id", "r.*")


def covered_to(points: DataFrame, point: str, ranges: DataFrame, first: str, last: str, value: str) -> DataFrame:
    """(point, upto): for each point the greatest value among the closed ranges that contain it; points in no range
    are left out.

    A range is cut into aligned blocks of 1, 2, 4, ... points (at most two of a size) and a point belongs to one block
    of each size, so this is an equality join of a few rows a range with a few rows a point, however wide the ranges
    are and however they overlap. Ranges with a null end or an end before their start contain nothing.
    """
    ranges = ranges.filter(F.col(first) <= F.col(last))
    lo, hi = ranges.agg(F.min(first), F.max(last)).first()
    lo, hi = (0, 0) if lo is None else (lo, hi)
    top = max(1, (hi - lo + 1).bit_length())
    steps = F.sequence(F.lit(0), F.lit(top))
    a, b = F.col(first) - F.lit(lo), F.col(last) + F.lit(1 - lo)
    two = lambda l: F.pow(F.lit(2), l).cast("bigint")

    def blocks(l: Column) -> Column:
        left = F.floor((a + two(l) - 1) / two(l)).cast("bigint")
        right = F.floor(b / two(l)).cast("bigint")
        mine = F.array(
            F.when((left < right) & (left % 2 == 1), left), F.when((left < right) & (right % 2 == 1), right - 1)
        )
        return F.transform(F.filter(mine, lambda x: x.isNotNull()), lambda x: F.struct(l.alias("size"), x.alias("block")))

    cut = ranges.select(F.explode(F.flatten(F.transform(steps, blocks))).alias("b"), F.col(value).alias("v"))
    cut = cut.groupBy("b.size", "b.block").agg(F.max("v").alias("v"))
    at = points.select(point).filter(F.col(point).between(lo, hi)).distinct().select(
        point,
        F.explode(
            F.transform(
                steps,
                lambda l: F.struct(l.alias("size"), F.floor((F.col(point) - F.lit(lo)) / two(l)).cast("bigint").alias("block")),
            )
        ).alias("b"),
    )
    return at.select(point, "b.*").join(cut, ["size", "block"]).groupBy(point).agg(F.max("v").alias("upto"))


def pending_changes(log: DataFrame, reports: DataFrame, span: int = SPAN, cell: int = CELL, path: str | None = None) -> DataFrame:
    """The changes (key, mod_revision) of which no row was processed by a run that succeeded, each once.

    Partitions are ranges of span revisions, cut into cells of cell revisions: all deliveries of a change, late repeats
    too, lie in one cell, so cells can be judged one by one. Each cell has two fingerprints, of all its rows and of those
    that successful runs processed. Where they are equal nothing is pending, and its rows are read no further; only
    rows of the other cells are shuffled and grouped by change. Partitions are replaced by dynamic overwrite, and
    their fingerprints recorded after.

    path is a folder that is kept from run to run: then a run touches only partitions in which, since the last run, rows
    were added or became processed (span and cell must stay the same). Without it every partition is new.

    Rows with a null or empty key are left out; a row without memtable or revision was processed by no run.
    """
    return pending_table(log, reports, span, cell, path)[0].read().select("key", "mod_revision")


def pending_table(log: DataFrame, reports: DataFrame, span: int = SPAN, cell: int = CELL, path: str | None = None) -> tuple[IncrementalTable, int]:
    """The table behind pending_changes after this run, and how many partitions the run replaced."""
    spark = log.sparkSession
    base = shared_path(spark, "incremental")
    done = outcomes(reports).filter("status = 'succeeded'")
    rows = log.filter(has_key()).select("key", "mod_revision", "memtable_id")
    cover = written(
        covered_to(rows, "memtable_id", done, "first_memtable_id", "last_memtable_id", "to_revision"), f"{base}/cover"
    )
    number = lambda width: F.coalesce(F.floor(F.col("mod_revision") / width), F.lit(-1)).cast("bigint")
    flagged = rows.join(broadcast_if_small(cover, f"{base}/cover", COVER_BYTES), "memtable_id", "left").select(
        "key",
        "mod_revision",
        number(span).alias("part"),
        number(cell).alias("cell"),
        F.coalesce(F.col("mod_revision") <= F.col("upto"), F.lit(False)).alias("processed"),
    )
    if size_of(spark, f"{base}/cover") > COVER_BYTES:
        flagged = written(flagged, f"{base}/rows")  # a shuffled join is made once; a broadcast one costs less than a copy
    h = row_hash("key", "mod_revision")
    cells = written(
        flagged.groupBy("part", "cell").agg(
            F.count(F.lit(1)).alias("n"),
            additive(h).alias("h"),
            F.count_if("processed").alias("n_done"),
            F.coalesce(additive(F.when(F.col("processed"), h)), F.lit(0)).alias("h_done"),
            additive(row_hash("key", "mod_revision", "processed")).alias("state"),
        ),
        f"{base}/cells",
    )
    open_ = written(cells.filter("n <> n_done or h <> h_done").select("cell"), f"{base}/open")

    def recompute(part_rows: DataFrame) -> DataFrame:
        todo = part_rows.join(broadcast_if_small(open_, f"{base}/open"), "cell", "left_semi")
        each = todo.groupBy("part", "key", "mod_revision").agg(F.max("processed").alias("processed"))
        return each.filter(~F.col("processed")).select("key", "mod_revision", "part")

    table = IncrementalTable(spark, path or f"{base}/pending", "part")
    prints = cells.groupBy("part").agg(F.sum("n").alias("n"), F.sum("state").alias("h"))
    return table, table.update(flagged, recompute, prints, ("mod_revision", span))
