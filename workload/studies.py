"""The studies' jobs, bound to text columns built from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from citegrain import constants as c
from citegrain.functions import text as t
from citegrain.operators import measures
from citegrain.plans import jobs
from workload import views as v
from workload.places import LOCAL_G
from workload.registry import COORDINATES, MEASURES, query

LATER = 20  # years that carry the given dates into the studied period


@query(f"""WITH d AS (SELECT DISTINCT l_orderkey AS eventid, o_custkey AS facility_id, p_brand AS deficiency_tag, p_name,
  CAST(CAST(o_orderdate AS DATE) + INTERVAL {LATER} YEAR AS DATE) AS inspect_date
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)
SELECT CAST(eventid AS VARCHAR) AS eventid, CAST(facility_id AS VARCHAR) AS facility_id, deficiency_tag,
  strftime(inspect_date, '%m/%d/%Y') AS inspection_date, inspect_date, CAST(year(inspect_date) AS INT) AS insp_year
FROM d WHERE year(inspect_date) BETWEEN 2014 AND 2023""")
def ingest_citations(spark, sf_dir):
    orders = v.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").cast("string").alias("facility_id"),
        F.date_format(F.add_months(F.col("o_orderdate").cast("date"), 12 * LATER), "MM/dd/yyyy").alias("inspection_date"),
    )
    parts = v.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("deficiency_tag"), F.col("p_name").alias("inspection_text")
    )
    lines = v.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    raw = v.met_by(lines.join(parts, "l_partkey"), orders, "l_orderkey").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("_c0"), F.col("l_orderkey").cast("string").alias("eventid"),
        "facility_id", "deficiency_tag", "inspection_date", "inspection_text",
    )
    return jobs.typed_inspections(raw)


@query("""SELECT CAST(o_custkey AS VARCHAR) AS facility_id, CAST(o_orderdate AS DATE) AS filedate,
  o_orderkey % 2 = 0 AS ccrc_facil, o_totalprice AS bedcert, CAST(o_orderkey % 100 AS DOUBLE) AS deficiency_tag FROM orders""")
def extract_types(spark, sf_dir):
    raw = v.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("Facility_ID"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("filedate"),
        F.when(F.col("o_orderkey") % 2 == 0, "Y").otherwise("N").alias("ccrc_facil"),
        F.col("o_totalprice").cast("string").alias("bedcert"), F.lit("3").alias("overall_rating"),
        (F.col("o_orderkey") % 100).cast("string").alias("deficiency_tag"), F.col("o_orderpriority").alias("Footnote 1"),
        F.col("o_orderstatus").alias("address"), F.col("o_orderpriority").alias("inspection_text"),
    )
    return jobs.typed_extract(raw)


@query("""SELECT CAST(c_custkey AS VARCHAR) AS facility_id, c_mktsegment AS ownership, c_acctbal AS bedcert,
  CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_nationkey AS DOUBLE) END AS restot, DATE '2019-11-01' AS filedate,
  CAST(2019 AS INT) AS insp_year FROM customer""")
def harmonise_providers(spark, sf_dir):
    given = {
        "PROVNUM": F.col("c_custkey").cast("string"), "OWNERSHIP": F.col("c_mktsegment"),
        "BEDCERT": F.col("c_acctbal").cast("string"), "FILEDATE": F.lit("2019-11-01"),
        "RESTOT": F.when(F.col("c_custkey") % 3 == 0, "unknown").otherwise(F.col("c_nationkey").cast("string")),
    }
    names = [given.get(n, F.lit("1")).alias(n) for n in c.PROVIDER_LONG_NAMES]
    table = jobs.harmonise_providers(v.table(spark, sf_dir, "customer").select(*names), 2019)
    return table.select("facility_id", "ownership", "bedcert", "restot", "filedate", "insp_year")


@query("""WITH est AS (SELECT lpad(CAST(user_id % 90 AS VARCHAR), 2, '0') || lpad(CAST(user_id AS VARCHAR), 9, '0') AS geoid,
  chr(CAST(65 + event_id % 8 AS INT)) AS race, event_id % 4 AS code, value FROM events)
SELECT geoid AS "GEOID", CASE WHEN race = 'A' THEN 'white' ELSE 'non-white' END AS race, round(coalesce(sum(value), 0), 4) AS poptot
FROM est WHERE race < 'H' AND code < 3 AND substr(geoid, 1, 2) NOT IN ('02', '15', '78', '74', '72', '69', '66', '60')
GROUP BY ALL""")
def senior_population(spark, sf_dir):
    user, event = F.col("user_id").cast("string"), F.col("event_id")
    variable = F.concat(
        F.lit("B01001"), F.char(65 + event % 8), F.lit("_"), F.lpad((14 + event % 4).cast("string"), 3, "0")
    )
    estimates = v.table(spark, sf_dir, "events").select(
        F.concat(F.lpad((F.col("user_id") % 90).cast("string"), 2, "0"), F.lpad(user, 9, "0")).alias("GEOID"),
        variable.alias("variable"), F.col("value").alias("estimate"),
    )
    return jobs.senior_population(estimates).withColumn("poptot", F.round("poptot", 4))


SPOTS_SQL = LOCAL_G.replace(COORDINATES, f"""{MEASURES}, {COORDINATES.replace("geo AS", "spot AS")}, geo AS (
  SELECT spot.facility_id, lon, lat, CAST(no_of_tags_peryear AS DOUBLE) AS x
  FROM spot JOIN fy ON fy.facility_id = spot.facility_id AND insp_year = 2000)""")


@query(f"WITH {SPOTS_SQL} SELECT facility_id, x AS no_of_tags_peryear, round(z, 6) AS z FROM g")
def hot_spots(spark, sf_dir):
    fy = measures.facility_year_measures(v.citations(spark, sf_dir, years=(2000, 2000)), v.SEVERE_TYPES)
    table = fy.select("facility_id", "insp_year", F.col("no_of_tags_peryear").cast("double").alias("no_of_tags_peryear"))
    located = table.join(v.coordinates(spark, sf_dir).drop("x"), "facility_id")
    scored = jobs.hot_spots(located, 2000, ["no_of_tags_peryear"])
    return scored.select("facility_id", "no_of_tags_peryear", F.round("z_no_of_tags_peryear", 6).alias("z"))


@query(r"""SELECT p_partkey, array_to_string(regexp_extract_all('The lpn #' || p_size || ' told rn#' || p_partkey || ' # and ' || p_name,
  '\w+\s?#\d+'), '|') AS people FROM part""")
def person_tokens(spark, sf_dir):
    report = F.concat(
        F.lit("The lpn #"), F.col("p_size").cast("string"), F.lit(" told rn#"), F.col("p_partkey").cast("string"),
        F.lit(" # and "), F.col("p_name"),
    )
    return v.table(spark, sf_dir, "part").select(
        "p_partkey", F.concat_ws("|", t.tokens(report, t.PERSON_PATTERN)).alias("people")
    )


@query("SELECT o_orderkey, o_totalprice AS fine_tot, o_totalprice AS fine_tot_copy FROM orders")
def copied_column(spark, sf_dir):
    orders = v.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("fine_tot"))
    return orders.withColumn("fine_tot_copy", F.col("fine_tot"))


@query("""SELECT c_custkey AS facility_id, c_mktsegment AS city, n_name AS state,
  CASE c_nationkey % 3 WHEN 0 THEN CAST(c_nationkey AS DOUBLE) WHEN 1 THEN 100e0 + c_nationkey END AS lon,
  CASE WHEN c_nationkey % 3 < 2 THEN -CAST(c_nationkey AS DOUBLE) END AS lat,
  CASE c_nationkey % 3 WHEN 0 THEN CAST(1 AS INT) WHEN 1 THEN 2 END AS source_pass, c_nationkey % 3 < 2 AS found
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def geocode_job(spark, sf_dir):
    nations = v.table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("state"))
    homes = v.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("facility_id"), F.col("c_mktsegment").alias("city"), F.col("c_nationkey").alias("n_nationkey")
    ).join(nations, "n_nationkey")
    key = F.col("n_nationkey")

    def reply(shift: int, known):
        hit = F.format_string(
            '{"result":{"addressMatches":[{"coordinates":{"x":%s,"y":%s}}]}}', (key + shift).cast("string"), (-key).cast("string")
        )
        body = F.when(known, hit).when(key % 2 == 0, '{"result":{"addressMatches":[]}}').otherwise("<html>busy")
        return homes.select("city", "state", body.alias("body")).distinct()

    facilities = homes.select("facility_id", "city", "state")
    return jobs.geocoded(facilities, [reply(0, key % 3 == 0), reply(100, key % 3 < 2)], ["city", "state"])
