"""The studies as whole jobs: ingest, facility-year table, category trends, geocoding, tracts."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegrain import constants as c
from citegrain.functions.values import first_match, parse_date, yes_no
from citegrain.operators import columns as cols
from citegrain.operators import lookups, measures
from citegrain.operators.regression import TagModel, cross_section, fit_tag_model
from citegrain.operators.polygons import points_in_polygons
from citegrain.operators.spatial import local_g, shift_repeats
from citegrain.sources.files import LATIN_1, read_text_columns, write_csv, write_table
from citegrain.sources.headed import read_extracts


def typed_inspections(raw: DataFrame) -> DataFrame:
    """Raw citations to dated, distinct citations of the study years.

    The year test drops rows without a readable date as well.  A saved index column would keep copies apart,
    so it goes first; the report text is compared by its hash and not shuffled.
    """
    dated = raw.drop(*SAVED_INDEX).withColumn("inspect_date", parse_date(F.col("inspection_date")))
    dated = dated.withColumn("insp_year", F.year("inspect_date"))
    dated = dated.where(F.col("insp_year").between(*c.INGEST_YEARS))
    if "inspection_text" in dated.columns:
        dated = dated.withColumn("inspection_text", F.sha2("inspection_text", 256))
    return dated.distinct().drop(*c.INGEST_DROPS)


# How readers name a first column without a heading.
SAVED_INDEX = ("_c0", "Unnamed: 0")


def ingest(spark: SparkSession, source: str, target: str, multi_line: bool = False) -> None:
    """CSV extract to parquet, one folder per year so that year filters skip the rest.

    Only files with line breaks inside quotes need `multi_line`; they cannot be split over tasks.
    """
    raw = read_text_columns(spark, source, multi_line=multi_line)
    # a year's rows meet in some tasks each, so that a folder gets few files
    spread = typed_inspections(raw).hint("rebalance", "insp_year")
    write_table(spread, target, by=["insp_year"])


def provider_year(file: str) -> int | None:
    """Year in a provider file name, which tells the era of its column names."""
    found = re.search(r"[0-9]{2,4}", file.rsplit("/", 1)[-1])
    return int(found.group()) if found else None


def harmonise_providers(raw: DataFrame, year: int | None) -> DataFrame:
    """One provider file with the long names of its era, cut to the common columns, short names."""
    eras = {2019: c.PROVIDER_LONG_NAMES, 2023: c.PROVIDER_2023_NAMES}
    common = cols.union_eras([(raw, eras.get(year, {}))], c.PROVIDER_LONG_NAMES.values())
    short = common.withColumnsRenamed(cols.short_names(c.PROVIDER_LONG_NAMES))
    dated = short.withColumnRenamed("provnum", "facility_id").withColumn(
        "filedate", parse_date(F.col("filedate"), "yyyy-MM-dd", "MM/dd/yyyy")
    )
    numeric = [n for n in dated.columns if n not in PROVIDER_TEXT]
    return cols.cast_numbers(dated, numeric, strict=False).withColumn("insp_year", F.year("filedate"))


PROVIDER_TEXT = (
    "facility_id", "ownership", "certification", "inhosp", "chow_last_12mos", "resfamcouncil", "filedate",
)


def provider_table(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """All provider files, one per year, under one set of names."""
    parts = [
        harmonise_providers(read_text_columns(spark, f, encoding=LATIN_1), provider_year(f)) for f in files
    ]
    return reduce(DataFrame.unionByName, parts)


def facility_table(citations: DataFrame, providers: DataFrame) -> DataFrame:
    """Facility-year quality with the characteristics of the same year."""
    return lookups.merge_providers(lookups.facility_year_quality(citations), providers)


def typed_extract(raw: DataFrame) -> DataFrame:
    """Combined extract: text and rating columns out, names lower-case, dates, flags and numbers typed.

    The named columns must be numbers; text columns at the positions 32 to 40 become numbers where they can.
    """
    kept = cols.lower_names(cols.drop_prefixed(raw, c.UNUSED_PREFIXES)).drop(*c.EXTRACT_DROPS, *c.RATING_DROPS)
    dates = [d for d in ("filedate", "inspection_date", "participation_date") if d in kept.columns]
    kept = kept.withColumns({d: parse_date(F.col(d), "yyyy-MM-dd", "MM/dd/yyyy") for d in dates})
    if "ccrc_facil" in kept.columns:
        kept = kept.withColumn("ccrc_facil", yes_no(F.col("ccrc_facil")))
    kept = cols.cast_numbers(kept, c.NUMERIC_COLUMNS)
    # fixed values: the positions of further columns that are cast leniently
    lenient = [n for n in kept.columns[32:41] if kept.schema[n].dataType.simpleString() == "string"]
    return cols.cast_numbers(kept, lenient, strict=False)


def combined_extract(spark: SparkSession, folder: str) -> DataFrame:
    return typed_extract(read_extracts(spark, folder))


def labelled_counts(citations: DataFrame, labels: DataFrame, tag: str, number: str) -> DataFrame:
    """Non-null bed counts per category and year; citations without a label form a null category."""
    labelled = lookups.label_tags(citations, labels, tag, number)
    return labelled.groupBy("category", "insp_year").agg(F.count("bedcert").alias("bedcert_count"))


def category_growth(citations: DataFrame, years: Sequence[int]) -> DataFrame:
    """Citations by state and year with totals and the growth from each year to the next."""
    table = measures.margins(citations, "state", "insp_year", years)
    for first, second in zip(years, years[1:]):
        table = measures.year_growth(table, f"y{first}", f"y{second}", f"growth_{first}_{second}")
    return table


def geocoded(facilities: DataFrame, replies: Sequence[DataFrame], on: Sequence[str], body: str = "body") -> DataFrame:
    """Facilities with the position of their address: unique addresses, stored replies pass by pass, joined back.

    A reply table has the address columns and the service's answer as JSON text; answers without a match or
    that are no JSON count as missing, and the next pass is asked.
    """
    passes = [
        r.select(*on, first_match(F.col(body)).alias("_p")).select(*on, F.col("_p.x").alias("lon"), F.col("_p.y").alias("lat"))
        for r in replies
    ]
    found = lookups.backfill(facilities.select(*on).distinct(), on, passes)
    return facilities.join(found, list(on), "left")


def write_tracts(table: DataFrame, target: str) -> None:
    """The tract table, geometry left out, as CSV for other tools."""
    write_csv(table, target, header=True)


def tract_health(
    tracts: DataFrame, facilities: DataFrame, health: DataFrame, drop_states=c.NON_CONTIGUOUS_STATES
) -> DataFrame:
    """Tracts with the facilities they contain and their health measures, geometry left out."""
    kept = tracts.where(~F.col("statefp").isin(*drop_states))
    # health joins the tracts first: afterwards a crowded tract would be shuffled as a whole
    described = (
        kept.withColumn("_tract", F.col("geoid").try_cast("bigint"))
        .join(health.withColumnRenamed("TractFIPS", "_tract"), "_tract", "left")
        .drop("_tract")
    )
    return points_in_polygons(described, facilities, "geoid", "wkt", "lon", "lat").drop("wkt")


def senior_population(estimates: DataFrame, drop_states=c.NON_CONTIGUOUS_STATES) -> DataFrame:
    """Population 65+ per tract and race group, contiguous states only."""
    kept = estimates.where(
        F.col("variable").isin(*c.SENIOR_VARIABLES) & ~F.substring("GEOID", 1, 2).isin(*drop_states)
    )
    return lookups.population_by_group(kept)


def hot_spots(
    facility_years: DataFrame, year: int, measures_: Sequence[str] = ("no_of_tags_peryear", "severe_tags_applied"), k: int = 20
) -> DataFrame:
    """Local hot and cold spots of one year's complete rows; facilities sharing a position are moved apart first."""
    columns = ["facility_id", "lat", "lon", *measures_]
    rows = facility_years.where(F.col("insp_year") == year).dropna().select(*columns)
    apart = shift_repeats(rows, "facility_id", ["lat", "lon"])
    return local_g(apart, "facility_id", ["lat", "lon"], list(measures_), k)


def tag_regression(facility_years: DataFrame, year: int = 2022) -> TagModel:
    """Tag-count regression on the cross-section of one year."""
    label = "no_of_tags_peryear"
    columns = ["facility_id", "state", label, *c.REGRESSION_NUMERIC, *c.REGRESSION_CATEGORICAL]
    section = cross_section(facility_years, year, columns)
    return fit_tag_model(section, label, c.REGRESSION_NUMERIC, c.REGRESSION_CATEGORICAL, "state", ["facility_id"])
