"""Counters and latency histograms of operations."""

from __future__ import annotations

import time
from collections import Counter
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The first bound of a latency histogram in seconds, the factor between bounds, their number.
START, FACTOR, COUNT = 0.0001, 2, 10


def bounds(start: float = START, factor: float = FACTOR, count: int = COUNT) -> list[float]:
    return [start * factor**i for i in range(count)]


def bounds_column() -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(COUNT - 1)), lambda i: F.lit(START) * F.pow(F.lit(float(FACTOR)), i))


def histogram(df: DataFrame, value: str, by: list[str] | None = None, edges: list[float] | None = None) -> DataFrame:
    """Cumulative counts (le, n): rows with value up to each bound, and in all (le infinite). Nulls aren't observed."""
    edges = edges or bounds()
    aggs = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(edges)]
    wide = df.groupBy(*(by or [])).agg(*aggs, F.count(value).alias("all"))
    pairs = [F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(edges)]
    pairs.append(F.struct(F.lit(float("inf")).alias("le"), F.col("all").alias("n")))
    return wide.select(*(by or []), F.explode(F.array(*pairs)).alias("x")).select(*(by or []), "x.le", "x.n")


class Metrics:
    """Counters and histograms of one engine, kept on the driver: a few numbers for each kind of operation."""

    def __init__(self) -> None:
        self.count: Counter[str] = Counter()
        self.seconds: dict[str, list[int]] = {}
        self.edges = bounds()

    @contextmanager
    def timed(self, op: str):
        began = time.perf_counter()
        try:
            yield
        except Exception:
            self.count["errors"] += 1
            raise
        finally:
            took = time.perf_counter() - began
            self.count[op] += 1
            cells = self.seconds.setdefault(op, [0] * (len(self.edges) + 1))
            cells[next((i for i, b in enumerate(self.edges) if took <= b), len(self.edges))] += 1

    def snapshot(self) -> dict:
        return {"count": dict(self.count), "edges": self.edges, "seconds": {k: list(v) for k, v in self.seconds.items()}}
