"""Domain tables bound to the given TPC-H-like tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegrain.operators.quadtree import spread
from citegrain.sources.files import read_table

YEARS = list(range(1995, 2002))
SEVERE_TYPES = ("PROMO", "LARGE", "SMALL")
SUSPECT_TAGS = 12

CATEGORIES = ("Resident Rights", "Quality of Life and Care", "Nursing", "Pharmacy", "Environment")


# Declared schemas spare every query a job that only reads file footers.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet", SCHEMAS[name])


def inspected_orders(
    spark: SparkSession, sf_dir: str, state: bool = True, years: tuple[int, int] | None = None
) -> DataFrame:
    """One row per inspection episode: state, year, facility, event.  `years` (both included) reaches the scan."""
    orders = table(spark, sf_dir, "orders")
    if years:
        first, end = (F.lit(f"{y}-01-01 00:00:00").cast("timestamp_ntz") for y in (years[0], years[1] + 1))
        orders = orders.where((F.col("o_orderdate") >= first) & (F.col("o_orderdate") < end))
    orders = orders.select(
        F.col("o_orderkey").alias("eventid"),
        F.col("o_custkey").alias("facility_id"),
        F.year("o_orderdate").alias("insp_year"),
    )
    return with_state(spark, sf_dir, orders) if state else orders


def with_state(spark: SparkSession, sf_dir: str, df: DataFrame) -> DataFrame:
    homes = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("state"))
    places = homes.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("facility_id"), "state"
    )
    return df.join(places, "facility_id")


def citations(
    spark: SparkSession, sf_dir: str, state: bool = True, tags: bool = True, extra: tuple[str, ...] = (),
    years: tuple[int, int] | None = None,
) -> DataFrame:
    """One row per citation; the joins that a caller does not need are left out.

    Lines and inspections meet last, dealt over all of the session's shuffle partitions: a task's share, and with it
    the sets that callers build from it, stays that small however much the rows are compressed.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("eventid"), "l_partkey", *extra
    )
    if tags:
        parts = table(spark, sf_dir, "part").select(
            F.col("p_partkey").alias("l_partkey"),
            F.col("p_brand").alias("deficiency_tag"),
            F.col("p_type").alias("scope_severity"),
        )
        lines = lines.join(parts, "l_partkey")
    rows = met_by(lines.drop("l_partkey"), inspected_orders(spark, sf_dir, state, years), "eventid")
    tagged = ("deficiency_tag", "scope_severity") if tags else ()
    return rows.select(*[c for c in rows.columns if c not in tagged], *tagged)


def met_by(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Inner join of two large tables on a key that few rows share, over all of the session's shuffle partitions."""
    return spread(rows, key).join(spread(others, key), key)


def provider_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facility characteristics per year."""
    rows = citations(
        spark, sf_dir, state=False, tags=False,
        extra=("l_quantity", "l_extendedprice", "l_discount", "l_tax"),
    )
    return (
        rows.groupBy("facility_id", "insp_year")
        .agg(
            F.avg("l_quantity").alias("bedcert"),
            F.avg("l_extendedprice").alias("restot"),
            F.avg("l_discount").alias("aidhrd"),
            F.avg("l_tax").alias("rnhrd"),
        )
    )


def tag_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag number to category, one row per brand."""
    number = F.regexp_extract("p_brand", r"([0-9]+)", 1).cast("bigint")
    names = F.array(*[F.lit(c) for c in CATEGORIES])
    return (
        table(spark, sf_dir, "part").select(number.alias("tag_number")).distinct()
        .select(
            "tag_number",
            F.get(names, (F.col("tag_number") % len(CATEGORIES)).cast("int")).alias("category"),
        )
    )


def coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facility coordinates and one measure; facilities without an embedding have none."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("facility_id"),
        (F.get("embedding", F.lit(0)).cast("double") * 50 - 95).alias("lon"),
        (F.get("embedding", F.lit(1)).cast("double") * 20 + 38).alias("lat"),
        F.col("label").cast("double").alias("x"),
    )


def tracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One polygon per supplier: rectangles for even keys, triangles for odd ones."""
    key = F.col("s_suppkey")
    x0 = F.lit(-114.0) + (key % 20) * F.lit(1.9)
    y0 = F.lit(29.5) + (F.floor(key / 20) % 8) * F.lit(2.0)

    def vertex(dx: float, dy: float):
        return F.concat_ws(" ", (x0 + F.lit(dx)).cast("string"), (y0 + F.lit(dy)).cast("string"))

    def ring(*corners: tuple[float, float]):
        body = F.concat_ws(", ", *[vertex(*c) for c in (*corners, corners[0])])
        return F.concat(F.lit("POLYGON (("), body, F.lit("))"))

    rectangle = ring((0.0, 0.0), (1.7, 0.0), (1.7, 1.6), (0.0, 1.6))
    triangle = ring((0.0, 0.0), (1.8, 0.0), (0.0, 1.8))
    return table(spark, sf_dir, "supplier").select(
        F.lpad(key.cast("string"), 11, "0").alias("geoid"),
        F.lpad(F.col("s_nationkey").cast("string"), 2, "0").alias("statefp"),
        F.when(key % 2 == 0, rectangle).otherwise(triangle).alias("wkt"),
    )


def tract_health_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "supplier")
        .select(F.col("s_suppkey").alias("TractFIPS"), F.col("s_acctbal").alias("health"))
    )
