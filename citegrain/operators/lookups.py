"""Label joins, coordinate merges and multi-pass lookups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrain.functions.values import substring_label
from citegrain.operators.measures import facility_year_measures


def label_tags(citations: DataFrame, labels: DataFrame, tag: str, number: str) -> DataFrame:
    """Left join of a label table on the tag as a whole number."""
    keyed = citations.withColumn("_tag", F.col(tag).try_cast("bigint"))
    return keyed.join(labels.withColumnRenamed(number, "_tag"), "_tag", "left").drop("_tag")


def with_coordinates(citations: DataFrame, coordinates: DataFrame) -> DataFrame:
    """Left join of facility coordinates without repeated rows.

    Both sides are made distinct before the join, so its rows are distinct too.
    """
    return citations.distinct().join(coordinates.distinct(), "facility_id", "left")


def coordinate_extract(citations: DataFrame, coordinates: DataFrame) -> DataFrame:
    """One row per state, facility, year and tag with one whole position of the facility, if it has any."""
    tagged = citations.select("state", "insp_year", "facility_id", "deficiency_tag").distinct()
    place = F.min(F.struct("lat", "lon")).alias("_p")
    known = coordinates.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    positions = known.groupBy("facility_id").agg(place).select("facility_id", "_p.lat", "_p.lon")
    return tagged.join(positions, "facility_id", "left").select(
        "facility_id", "insp_year", "lat", "lon", "deficiency_tag"
    )


def inner_coordinates(measures: DataFrame, positions: DataFrame) -> DataFrame:
    """Facility-year rows with a position; the year arrives as text on the position side."""
    places = positions.select(
        "facility_id", F.col("insp_year").try_cast("int").alias("insp_year"), "lat", "lon"
    ).distinct()
    return measures.join(places, ["facility_id", "insp_year"])


def point_counts(positions: DataFrame, value: str = "deficiency_tag") -> DataFrame:
    """Non-null values per facility, year and position, from complete rows only."""
    return (
        positions.dropna().groupBy("facility_id", "insp_year", "lat", "lon")
        .agg(F.count(value).alias("def_tags"))
    )


def merge_providers(measures: DataFrame, providers: DataFrame) -> DataFrame:
    """Left join of facility characteristics; years without a provider file keep nulls."""
    return measures.join(providers, ["insp_year", "facility_id"], "left")


def unmatched(rows: DataFrame, known: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key has no match."""
    return rows.join(known.select(*on).distinct(), list(on), "left_anti")


def backfill(rows: DataFrame, on: Sequence[str], passes: Sequence[DataFrame]) -> DataFrame:
    """Fill `lon`/`lat` from a series of lookup tables, each used for rows still missing.

    Adds `source_pass` (1-based, null when never found) and `found`.  The tables are merged into one lookup
    with the first pass that knows a key, so that the rows are read and joined once, however many passes
    there are.
    """
    known = [
        table.where(F.col("lon").isNotNull() & F.col("lat").isNotNull())
        .select(*on, F.struct(F.lit(number).alias("source_pass"), "lon", "lat").alias("_hit"))
        for number, table in enumerate(passes, start=1)
    ]
    if not known:
        none = {"lon": "double", "lat": "double", "source_pass": "int"}
        return rows.withColumns({c: F.lit(None).cast(t) for c, t in none.items()}).withColumn("found", F.lit(False))
    lookup = reduce(DataFrame.unionByName, known).groupBy(*on).agg(F.min("_hit").alias("_hit"))
    filled = rows.join(lookup, list(on), "left")
    return filled.withColumns({c: F.col(f"_hit.{c}") for c in ("lon", "lat", "source_pass")}).withColumn(
        "found", F.col("source_pass").isNotNull()
    ).drop("_hit")


def population_by_group(
    estimates: DataFrame,
    geo: str = "GEOID",
    variable: str = "variable",
    estimate: str = "estimate",
    part: str = "A",
    label: str = "white",
    otherwise: str = "non-white",
) -> DataFrame:
    """Estimate totals by area and race group; a group without any estimate totals 0."""
    return estimates.groupBy(geo, substring_label(F.col(variable), part, label, otherwise).alias("race")).agg(
        F.coalesce(F.sum(estimate), F.lit(0.0)).alias("poptot")
    )


def facility_year_quality(citations: DataFrame, **options) -> DataFrame:
    """Facility-year measures with the facility and inspection counts of their state and year.

    The state totals sum the measures, so both sides of the join read one shuffle.  They count an
    unknown facility as one; its own row is left out by an aggregated mark, because a filter on the
    key would sink into one side's scan and part the two.
    """
    measures = facility_year_measures(citations, **options)
    totals = measures.groupBy("state", "insp_year").agg(
        F.count(F.lit(1)).alias("count_nh_insp_st_yr"),
        F.sum("fac_times_inspected").alias("count_events_st_yr"),
    )
    # one row per state and year: some thousands at most
    return measures.where("known_facility").drop("known_facility").join(F.broadcast(totals), ["state", "insp_year"])
