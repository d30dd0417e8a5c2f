"""Duplicates, keep-first, and latest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that occur more than once, with their number of rows (all members count)."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in a stated order (dropDuplicates would keep an arbitrary one).

    The rank limit is applied by each task before the shuffle, so a key of many rows doesn't meet in one task.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__place", place).where("__place = 1").drop("__place")


def latest_per(df: DataFrame, keys: list[str], order: Column, columns: list[str]) -> DataFrame:
    """The row with the greatest order of each key, by one partial aggregation."""
    best = F.max_by(F.struct(*columns), order).alias("best")
    return df.groupBy(*keys).agg(best).select(*keys, "best.*")
