"""Duplicates, slices and batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """Keep the first row of each key in the given total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def repeat_flag(df: DataFrame, keys: Sequence[str], id_col: str, name: str = "is_repeat") -> DataFrame:
    """Mark every row of a key but the one with the smallest id.

    A running minimum would gather a hot key in one task, so the smallest id is aggregated first.
    """
    joined = df.join(df.groupBy(*keys).agg(F.min(id_col).alias("_first")), list(keys), "left")
    return joined.withColumn(name, F.coalesce(F.col(id_col) != F.col("_first"), F.lit(False))).drop("_first")


def top(df: DataFrame, order: Sequence, n: int, skip: int = 0) -> DataFrame:
    """Rows `skip` to `skip + n` of a total order."""
    ranked = df.orderBy(*order)
    return (ranked.offset(skip) if skip else ranked).limit(n)
