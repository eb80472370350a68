"""Reading the input tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str | Column) -> DataFrame:
    """A table of the data folder, with only the columns asked for."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def has_key(key: str = "key") -> Column:
    """A null or empty key belongs to no key: such a row is left out everywhere."""
    return F.col(key).isNotNull() & (F.length(key) > 0)
