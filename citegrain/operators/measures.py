"""Counts and distinct counts per facility, state and year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citegrain.constants import SEVERE_LETTERS
from citegrain.functions.values import is_severe, presence, row_sum

FACILITY_YEAR = ("state", "insp_year", "facility_id")


def distinct_values(*columns: str) -> Column:
    """Distinct count in which a null counts as a value, as dedup-then-count gives.

    Spark shuffles distinct aggregates on key and value, so a hot key is spread by its values.
    """
    return F.count_distinct(F.struct(*columns))


def row_counts(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def distinct_counts(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str) -> DataFrame:
    """Distinct combinations of `columns` per key."""
    return df.select(*keys, *columns).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def facility_year_measures(citations: DataFrame, severe=SEVERE_LETTERS) -> DataFrame:
    """All facility-year measures from one scan.

    Citations are first reduced to distinct events and distinct (tag, severity) pairs per
    facility-year.  That shuffle is keyed by the values as well, so a facility holding a third of all
    citations is spread over many tasks.  The second aggregation then counts event rows and keeps
    sets that the tag and severity code lists bound.
    """
    none = {c: F.lit(None).cast(citations.schema[c].dataType).alias(c) for c in
            ("eventid", "deficiency_tag", "scope_severity")}
    kinds = F.array(
        F.struct(F.lit(True).alias("is_event"), F.col("eventid"),
                 none["deficiency_tag"], none["scope_severity"]),
        F.struct(F.lit(False).alias("is_event"), none["eventid"],
                 F.col("deficiency_tag"), F.col("scope_severity")),
    )
    reduced = citations.select(*FACILITY_YEAR, F.inline(kinds)).distinct()
    tag, letter = F.col("deficiency_tag"), F.col("scope_severity")
    tags, letters = F.collect_set(tag), F.collect_set(letter)
    unknown_tag = F.max(F.when(~F.col("is_event"), tag.isNull().cast("int")).otherwise(0))
    severe_pair = F.when(is_severe(letter, severe) & tag.isNotNull(), F.concat_ws("-", tag, letter))
    return reduced.groupBy(*FACILITY_YEAR).agg(
        F.bool_or(F.col("facility_id").isNotNull()).alias("known_facility"),
        F.count_if("is_event").alias("fac_times_inspected"),
        (F.size(tags) + unknown_tag).cast("bigint").alias("no_of_tags_peryear"),
        F.size(F.filter(letters, lambda s: is_severe(s, severe))).cast("bigint").alias("severe_tags_applied"),
        F.array_sort(tags).alias("list_tags"),
        F.array_sort(letters).alias("scope_list"),
        F.array_sort(F.collect_set(severe_pair)).alias("severe_pairs"),
    )


def state_year_facilities(citations: DataFrame) -> DataFrame:
    """Facilities inspected per state and year."""
    return distinct_counts(citations, ["state", "insp_year"], ["facility_id"], "count_nh_insp_st_yr")


def state_year_events(citations: DataFrame) -> DataFrame:
    """Inspections (facility and event) per state and year."""
    return distinct_counts(citations, ["state", "insp_year"], ["facility_id", "eventid"], "n_events")


def tag_lists(citations: DataFrame) -> DataFrame:
    """Sorted distinct tags per facility-year; the tag code list bounds each list."""
    return citations.groupBy(*FACILITY_YEAR).agg(
        F.array_sort(F.collect_set("deficiency_tag")).alias("list_tags")
    )


def year_columns(years: Sequence[int]) -> list[str]:
    return [f"y{y}" for y in years]


def facility_year_pivot(citations: DataFrame, years: Sequence[int]) -> DataFrame:
    """Citations per facility with one column per year; years without inspection are null.

    Conditional counts in one aggregation stand for a count, a pivot and a mean of one value.
    """
    counts = [
        F.nullif(F.count_if(F.col("insp_year") == y), F.lit(0)).cast("double").alias(f"y{y}") for y in years
    ]
    return citations.groupBy("state", "facility_id").agg(*counts)


def years_inspected(pivoted: DataFrame, years: Sequence[int]) -> DataFrame:
    """Year columns as 0/1 flags with their sum."""
    names = year_columns(years)
    flags = pivoted.withColumns({c: presence(F.col(c)) for c in names})
    return flags.withColumn("yrs_inspected", row_sum([F.col(c) for c in names]))


def yearly_change(counts: DataFrame, by: str, year: str, count: str, base: str = "current") -> DataFrame:
    """Change against the year before and its ratio to the current (or previous) count."""
    before = F.lag(count).over(Window.partitionBy(by).orderBy(year))
    change = F.col(count) - before
    divisor = F.col(count) if base == "current" else before
    return counts.select(
        "*", change.alias("p_chg"), F.try_divide(change, divisor).alias("per_ch")
    )


def attach_distinct_count(df: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    """Put the distinct count of a column within its key on every row.

    Aggregate and join back: a window would gather each key's rows in one task, while a join's crowded
    partitions are split by adaptive execution.
    """
    return df.join(df.groupBy(*keys).agg(distinct_values(column).alias(name)), list(keys), "left")


def year_pivot(df: DataFrame, row: str, year: str, value: str, years: Sequence[int]) -> DataFrame:
    """Mean of a value per row label and year, one column per year."""
    means = [F.avg(F.when(F.col(year) == y, F.col(value))).alias(f"y{y}") for y in years]
    return df.groupBy(row).agg(*means)


def margins(df: DataFrame, row: str, year: str, years: Sequence[int], total: str = "All") -> DataFrame:
    """Row counts by label and year, with a total per label, per year and overall."""
    counts = [F.count_if(F.col(year) == y).alias(f"y{y}") for y in years]
    label = F.when(F.grouping(row) == 1, total).otherwise(F.col(row))
    return (
        df.where(F.col(row).isNotNull())
        .rollup(row)
        .agg(label.alias("_label"), *counts, F.count(F.col(year)).alias("total"))
        .drop(row)
        .withColumnRenamed("_label", row)
    )


def year_growth(pivoted: DataFrame, first: str, second: str, name: str) -> DataFrame:
    """Percent growth between two year columns; null where the first is 0."""
    ratio = F.try_divide(F.col(second), F.col(first))
    return pivoted.withColumn(name, (ratio - 1) * 100)
