"""Ordered results per key where a few keys hold most rows.

1. A frequent-items sketch over the key column (one pass, mergeable, fixed size) names the keys that may hold more
   rows than a slice and more than 1/heavy_share of all rows. The second condition bounds their number by TOP, whatever
   the data; what remains light is then less than a task's share of the rows.
2. Rows of heavy keys are found by a broadcast join with that list and cut, key by key, into slices by ranges of the
   first order column; the bounds of the slices come from a quantile sketch.
3. Heavy rows are shuffled by (key, slice), the remaining rows by key: no task gets more than a slice or an ordinary
   key. Where a result looks at the row before, the last row of each slice (one row a slice) is carried to the next.
4. The two results are united.

The sketch only decides which way a row takes; any key may take either way with the same result, so an estimate that
is off costs time, never rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltbed.sources.tables import has_key

#: Fixed size of the frequent-items sketch, and of the list it gives: the proven bound of what is broadcast.
TRACKED = 50_000
TOP = 2_500
#: Slices of all heavy keys together, and how many bounds are searched at once. A slice is larger than asked for only
#: where it is less than 1/SLICES of all heavy rows.
SLICES, GROUP = 16_384, 128
SLICE_ROWS = 20_000


def heavy_hitters(df: DataFrame, key: str, heavy_share: int, rows: int = 0) -> list[tuple[str, int]]:
    """(key, estimated rows) of the keys that may hold more than 1/heavy_share of the rows, and more than rows; at most
    TOP of them.

    The sketch's error is at most 3.5 / TRACKED of the rows, far below the share asked for. Null is no key.
    """
    top = (
        df.select(F.col(f"`{key}`").alias("k"))
        .agg(F.expr(f"approx_top_k(k, {TOP}, {TRACKED})").alias("top"), F.count("k").alias("n"))
        .first()
    )
    return [(r["item"], r["count"]) for r in top["top"] or [] if r["item"] is not None and r["count"] > rows and r["count"] * heavy_share > top["n"]]


def slices(df: DataFrame, key: str, by: str, heavy: list[tuple[str, int]], target: int) -> DataFrame | None:
    """A small table (__hk, __bounds): for each heavy key the inner bounds of its slices of about target rows, in
    groups of GROUP. Where all heavy keys together would get more than SLICES slices, slices are larger instead, so
    that what is broadcast has a fixed bound."""
    if not heavy:
        return None
    spark = df.sparkSession
    target = max(target, -(-sum(n for _, n in heavy) // SLICES))
    parts = {k: max(1, -(-n // target)) for k, n in heavy}
    most = max(parts.values())
    points = [i / most for i in range(1, most)]
    found = {}
    if points:
        names = spark.createDataFrame(list(parts.items()), "__hk string, __parts int")
        rows = (
            df.join(F.broadcast(names), F.col(f"`{key}`") == F.col("__hk"))
            .groupBy("__hk")
            .agg(F.percentile_approx(by, points, max(10_000, 4 * most)).alias("bounds"))
            .collect()  # at most SLICES bounds of TOP keys remain of it
        )
        found = {r["__hk"]: _thinned(r["bounds"] or [], parts[r["__hk"]]) for r in rows}
    grouped = [(k, [b[i : i + GROUP] for i in range(0, len(b), GROUP)]) for k in parts for b in [found.get(k, [])]]
    return spark.createDataFrame(grouped, "__hk string, __bounds array<array<bigint>>")


def slice_number(bounds: str, by: str) -> Column:
    """How many bounds lie below a value: first by groups, then inside one; a null value lies below all bounds."""
    below = lambda array: F.size(F.filter(array, lambda b: b < F.col(by)))
    groups = F.size(F.filter(bounds, lambda g: g[0] < F.col(by)))
    return F.when(groups == 0, 0).otherwise((groups - 1) * GROUP + below(F.get(bounds, groups - 1)))


def _thinned(points: list[int], parts: int) -> list[int]:
    """Of equally spaced quantiles, those that cut into parts."""
    most = len(points) + 1
    return sorted({int(points[min(len(points) - 1, round(i * most / parts) - 1)]) for i in range(1, parts)})


def previous_by_key(
    df: DataFrame,
    key: str,
    order: list[str],
    carry: str,
    heavy_share: int = TOP,
    slice_rows: int = SLICE_ROWS,
    prev: str = "prev",
) -> DataFrame:
    """The rows of df, each once, with the column prev: the value of carry in the row before, by the order columns,
    within the key.

    Rows equal in key and order columns are repeats of one row; the one with the greatest carry stays. prev is null in
    the first row of a key. Rows with a null or empty key are left out. Nulls in order columns come first; a carry
    that is null counts as a value: prev is then null. The first order column must be a whole number. A key with
    more than slice_rows rows is heavy if that is more than 1/heavy_share of all. slice_rows: rows of a slice, the most
    that one task gets of a heavy key (but for rows equal in the first order column, which stay together). A column of df named like prev
    is replaced; all others are kept.
    """
    df = df.filter(has_key(f"`{key}`"))
    columns = [c for c in df.columns if c != prev]
    heavy = heavy_hitters(df, key, heavy_share, slice_rows)
    parts = slices(df, key, order[0], heavy, slice_rows)
    k = F.col(f"`{key}`")

    def chained(rows: DataFrame, by: list[str]) -> DataFrame:
        """Repeats taken out and prev set, in one sort of each group."""
        line = Window.partitionBy(*by).orderBy(*order)
        full = Window.partitionBy(*by).orderBy(*order, F.col(carry).desc_nulls_last())
        same = F.lit(True)
        for c in order:
            same = same & F.lag(c).over(full).eqNullSafe(F.col(c))
        nth = F.row_number().over(full)
        once = rows.withColumn("__again", (nth > 1) & same).filter(~F.col("__again")).drop("__again")
        return once.withColumn("__first", F.row_number().over(line) == 1).withColumn(prev, F.lag(carry).over(line))

    if parts is None:
        return chained(df, [key]).select(*columns, prev)
    light = chained(df.join(F.broadcast(parts.select("__hk")), k == F.col("__hk"), "left_anti"), [key])
    hot = df.join(F.broadcast(parts), k == F.col("__hk")).withColumn("__slice", slice_number("__bounds", order[0])).drop("__hk", "__bounds")
    inner = chained(hot, [key, "__slice"])
    # One row a slice: the carry of its last row, moved on to the next slice that has rows; at most SLICES + TOP rows.
    newest = F.max_by(F.struct(F.col(carry).alias("v")), F.struct(*order, carry))
    last = hot.groupBy(key, "__slice").agg(newest.alias("__last"))
    nxt = last.select(
        k.alias("__k"), F.col("__slice").alias("__s"), F.lag(F.col("__last.v")).over(Window.partitionBy(key).orderBy("__slice")).alias("__v")
    )
    joined = inner.join(F.broadcast(nxt), (k == F.col("__k")) & (F.col("__slice") == F.col("__s")), "left")
    hot_out = joined.withColumn(prev, F.when(F.col("__first"), F.col("__v")).otherwise(F.col(prev)))
    return light.select(*columns, prev).unionByName(hot_out.select(*columns, prev))


def aggregate_by_key(df: DataFrame, key: str, partial: list[Column], final: list[Column], heavy_share: int = 50, salts: int = 64) -> DataFrame:
    """Aggregates per key in two steps, heavy keys through (key, salt) first.

    partial are aggregates over rows, final are aggregates over the partial columns (for example sum of counts).
    """
    df = df.filter(has_key(key))
    heavy = heavy_hitters(df, key, heavy_share)
    if not heavy:
        return df.groupBy(key).agg(*partial).groupBy(key).agg(*final)
    names = df.sparkSession.createDataFrame([(k,) for k, _ in heavy], "__hk string")
    light = df.join(F.broadcast(names), F.col(key) == F.col("__hk"), "left_anti").groupBy(key).agg(*partial)
    hot = (
        df.join(F.broadcast(names), F.col(key) == F.col("__hk"), "left_semi")
        .withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
        .groupBy(key, "__salt")
        .agg(*partial)
        .drop("__salt")
    )
    return reduce(DataFrame.unionByName, [light, hot]).groupBy(key).agg(*final)


def versions_not_rising(changes: DataFrame, key: str = "key", **params: int) -> DataFrame:
    """The changes whose version isn't greater than that of the change just before it, by (commit_ts, mod_revision).

    changes: key, version, commit_ts, mod_revision; repeated deliveries count once, changes without a version and
    rows without a key are left out. Result: key, mod_revision.
    """
    rows = changes.filter(has_key(key) & F.col("version").isNotNull())
    w = previous_by_key(rows, key, ["commit_ts", "mod_revision"], "version", **params)
    return w.filter(F.col("version") <= F.col("prev")).select(key, "mod_revision")
