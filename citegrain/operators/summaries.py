"""Grouped summaries, histograms and exact order statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citegrain.operators.durable import durable

# Rank tables of at most so many values (3 MB) are broadcast.
SENT_VALUES = 200_000


def grouped_means(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Means and row count per key."""
    return df.groupBy(*keys).agg(
        *[F.avg(c).alias(f"mean_{c}") for c in columns], F.count(F.lit(1)).alias("n")
    )


def numeric_means(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean of every numeric column per key."""
    numeric = [c for c, t in df.dtypes if c not in keys and t in NUMERIC_TYPES]
    return df.groupBy(*keys).agg(*[F.avg(c).alias(f"mean_{c}") for c in numeric])


NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double")


def value_counts(df: DataFrame, column: str, keep_null: bool = False) -> DataFrame:
    rows = df if keep_null else df.where(F.col(column).isNotNull())
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, value: str, by: Sequence[str] = (), bins: int = 20) -> DataFrame:
    """Counts in equal-width bins over the overall range; the top edge belongs to the last bin.

    Equal values are merged first and kept; the range and the counts come from them, so rows are read once.
    """
    values = durable(value_copies(df, value, by))
    low, high = values.agg(F.min(value), F.max(value)).first()
    width = ((high - low) / bins if low is not None else 0) or 1.0
    position = F.floor((F.col(value) - F.lit(low)) / F.lit(float(width))) + 1
    bin_ = F.least(position, F.lit(bins)).cast("int")
    return values.groupBy(*by, bin_.alias("bin")).agg(F.sum("n").alias("n"))


def value_positions(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per group and distinct value: `n` copies, `before` smaller rows, `total` rows.

    Copies are merged before anything is ordered, so one value may hold any share of the rows.
    """
    return placed_values(value_copies(df, value, by), value, by)


def value_copies(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct values per group with their number of copies `n`."""
    present = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return present.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))


def placed_values(values: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Running positions over distinct values that carry their number of copies `n`.

    The values are range-partitioned, so their partitions are buckets whose number and size follow the data
    and the session's settings; the bucket of each row is frozen by writing it.  Only bucket totals are
    accumulated together, and each bucket is ordered by itself.
    """
    cut = durable(values.repartitionByRange(*by, value).withColumn("_bucket", F.spark_partition_id()))
    totals = cut.groupBy(*by, "_bucket").agg(F.sum("n").alias("_rows"))
    in_group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # a row per partition at most
    totals = totals.select(
        *by,
        "_bucket",
        (F.sum("_rows").over(in_group.orderBy("_bucket")) - F.col("_rows")).alias("_base"),
        F.sum("_rows").over(in_group).alias("total"),
    )
    in_bucket = Window.partitionBy(*by, "_bucket").orderBy(value)
    return (
        cut.join(totals, [*by, "_bucket"])
        .withColumn("before", F.col("_base") + F.sum("n").over(in_bucket) - F.col("n"))
        .drop("_bucket", "_base")
    )


def exact_quantiles(
    df: DataFrame, value: str, probabilities: dict[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Exact interpolated quantiles (position (n-1)p) per group without holding a group anywhere."""
    placed = value_positions(df, value, by)
    return placed.groupBy(*by).agg(*quantile_columns(value, probabilities))


def quantile_columns(value: str, probabilities: dict[str, float]) -> list:
    columns = []
    for name, p in probabilities.items():
        # six decimals keep whole positions whole: 0.1 * 10 must not become 0.9999
        position = F.round((F.max("total") - 1) * p, 6)
        own = F.round((F.col("total") - 1) * p, 6)
        low = F.max(F.when(holds(F.floor(own)), F.col(value)))
        high = F.max(F.when(holds(F.ceil(own)), F.col(value)))
        columns.append((low + (high - low) * (position - F.floor(position))).alias(name))
    return columns


def holds(position):
    return (F.col("before") <= position) & (position < F.col("before") + F.col("n"))


def six_numbers(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Minimum, quartiles, mean and maximum per group."""
    quartiles = quantile_columns(value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return value_positions(df, value, by).groupBy(*by).agg(
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        (F.sum(F.col(value) * F.col("n")) / F.sum("n")).alias("mean"),
        *quartiles,
    )


def rank_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Spearman correlation of every pair of columns, ties at their average rank.

    The ranks of all columns come from one pass over (column, value) rows, whose copies are merged.  The rows,
    read again, look up one column after the other: rank tables of few values are sent to all tasks, so that
    only columns of many values shuffle rows.  The rank means are known, so the sums are centred.
    """
    ranked = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    values = ranked.unpivot([], list(columns), "column", "value").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    centred = F.col("before") + F.col("n") / 2 - F.col("total") / 2
    ranks = durable(placed_values(values, "value", ["column"]).select("column", "value", centred.alias("_r")))
    sizes = dict(ranks.groupBy("column").count().collect())
    for c in columns:
        own = ranks.where(F.col("column") == c).select(F.col("value").alias(c), F.col("_r").alias(f"_r_{c}"))
        ranked = ranked.join(F.broadcast(own) if sizes.get(c, 0) <= SENT_VALUES else own, c)

    def products(a: str, b: str):
        return F.sum(F.col(f"_r_{a}") * F.col(f"_r_{b}"))

    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    sums = ranked.agg(*[products(a, b).alias(f"_{a}_{b}") for a, b in pairs])
    entries = F.array(*[
        F.struct(
            F.lit(a).alias("column_a"),
            F.lit(b).alias("column_b"),
            F.try_divide(
                F.col(f"_{a}_{b}"), F.sqrt(F.col(f"_{a}_{a}")) * F.sqrt(F.col(f"_{b}_{b}"))
            ).alias("correlation"),
        )
        for a, b in pairs
    ])
    return sums.select(F.inline(entries))
