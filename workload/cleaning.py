"""Filters, casts, renames, dedup and lookups."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from citegrain.functions import values as val
from citegrain.functions.geometry import in_box
from citegrain.operators import columns as cols
from citegrain.operators import dates, lookups, measures, rows, summaries
from citegrain.operators.durable import shared_folder
from citegrain.operators.spatial import valid_points
from citegrain.plans import jobs
from citegrain.sources import files, headed
from workload import views as v
from workload.registry import CITATIONS, COORDINATES, MEASURES, SEVERE, query

ORDER_ROWS = """ord AS (SELECT o_orderkey AS eventid, o_custkey AS facility_id,
  CAST(year(o_orderdate) AS INT) AS insp_year FROM orders)"""


@query(f"WITH {ORDER_ROWS} SELECT * FROM ord WHERE insp_year > 1996 AND insp_year <= 1999")
def range_filter(spark, sf_dir):
    return v.inspected_orders(spark, sf_dir, state=False, years=(1997, 1999))


@query(f"WITH {ORDER_ROWS} SELECT * FROM ord WHERE insp_year BETWEEN 1996 AND 1999")
def closed_range(spark, sf_dir):
    return v.inspected_orders(spark, sf_dir, state=False, years=(1996, 1999))


@query(f"WITH {ORDER_ROWS} SELECT * FROM ord WHERE insp_year = 2000")
def equals_year(spark, sf_dir):
    return v.inspected_orders(spark, sf_dir, state=False, years=(2000, 2000))


@query("""SELECT n_nationkey, n_name AS state FROM nation
WHERE n_name NOT IN ('NATION_2', 'NATION_15', 'NATION_24')""")
def not_in_states(spark, sf_dir):
    states = v.table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("state"))
    return states.where(~F.col("state").isin("NATION_2", "NATION_15", "NATION_24"))


@query(f"WITH {MEASURES} SELECT DISTINCT facility_id, insp_year, state FROM fy WHERE no_of_tags_peryear > 12")
def suspects(spark, sf_dir):
    counted = measures.distinct_counts(
        v.citations(spark, sf_dir), measures.FACILITY_YEAR, ["deficiency_tag"], "no_of_tags_peryear"
    )
    return counted.where(F.col("no_of_tags_peryear") > v.SUSPECT_TAGS).select(
        "facility_id", "insp_year", "state"
    ).distinct()


@query(f"""WITH {COORDINATES} SELECT facility_id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM geo
WHERE lon BETWEEN -97.0 AND -90.0 AND lat BETWEEN 35.0 AND 39.5""")
def bbox_points(spark, sf_dir):
    box = {"lon": (-97.0, -90.0), "lat": (35.0, 39.5)}
    points = valid_points(v.coordinates(spark, sf_dir)).where(in_box(F.col("lon"), F.col("lat"), box))
    return points.select("facility_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query(f"WITH {ORDER_ROWS} SELECT DISTINCT facility_id FROM ord")
def distinct_facilities(spark, sf_dir):
    return v.inspected_orders(spark, sf_dir, state=False).select("facility_id").distinct()


@query(f"WITH {ORDER_ROWS} SELECT facility_id, insp_year, eventid FROM ord WHERE facility_id = 45")
def id_lookup(spark, sf_dir):
    return v.inspected_orders(spark, sf_dir, state=False).where("facility_id = 45").select(
        "facility_id", "insp_year", "eventid"
    )


@query("SELECT user_id, ts, value FROM events WHERE event_type = 'click'")
def catalogue_filter(spark, sf_dir):
    return v.table(spark, sf_dir, "events").where("event_type = 'click'").select("user_id", "ts", "value")


LOCATED = f"""{ORDER_ROWS}, {COORDINATES}, loc AS (
  SELECT ord.*, round(lon, 6) AS lon, round(lat, 6) AS lat FROM ord LEFT JOIN geo USING (facility_id))"""


def located(spark, sf_dir):
    places = v.coordinates(spark, sf_dir).drop("x")
    joined = lookups.with_coordinates(v.inspected_orders(spark, sf_dir, state=False), places)
    return joined.withColumns({c: F.round(c, 6) for c in ("lon", "lat")})


@query(f"WITH {LOCATED} SELECT * FROM loc WHERE lon IS NOT NULL AND lat IS NOT NULL")
def drop_any_null(spark, sf_dir):
    return located(spark, sf_dir).dropna("any")


@query(f"WITH {LOCATED} SELECT eventid, facility_id, insp_year FROM loc WHERE lon IS NULL")
def null_filter(spark, sf_dir):
    return located(spark, sf_dir).where(F.col("lon").isNull()).select("eventid", "facility_id", "insp_year")


@query(f"WITH {CITATIONS} SELECT facility_id, eventid, deficiency_tag, scope_severity FROM cit WHERE {SEVERE}")
def in_severe(spark, sf_dir):
    cited = v.citations(spark, sf_dir, state=False).where(val.is_severe(F.col("scope_severity"), v.SEVERE_TYPES))
    return cited.select("facility_id", "eventid", "deficiency_tag", "scope_severity")


@query(f"""WITH {CITATIONS} SELECT count(DISTINCT facility_id) AS facilities FROM cit
WHERE deficiency_tag = 'Brand#7' AND insp_year = 1998""")
def conjunct_distinct_count(spark, sf_dir):
    cited = v.citations(spark, sf_dir, state=False, years=(1998, 1998))
    chosen = cited.where(F.col("deficiency_tag") == "Brand#7")
    return chosen.agg(F.count_distinct("facility_id").alias("facilities"))


@query("""SELECT CAST(min(o_orderdate) AS DATE) AS first_date, CAST(max(o_orderdate) AS DATE) AS last_date,
  count(*) AS n FROM orders""")
def date_minmax(spark, sf_dir):
    return v.table(spark, sf_dir, "orders").agg(
        F.min("o_orderdate").cast("date").alias("first_date"),
        F.max("o_orderdate").cast("date").alias("last_date"),
        F.count(F.lit(1)).alias("n"),
    )


@query(f"WITH {ORDER_ROWS} SELECT insp_year, count(*) AS n FROM ord GROUP BY insp_year")
def value_counts(spark, sf_dir):
    return summaries.value_counts(v.inspected_orders(spark, sf_dir, state=False), "insp_year", keep_null=True)


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS zip, CAST(o_custkey AS INT) AS zip_number,
  CAST(o_totalprice AS DOUBLE) AS fine_tot, CAST(o_orderkey % 1000 AS BIGINT) AS deficiency_tag1,
  CAST(CAST(o_orderdate AS DATE) AS DATE) AS filedate FROM orders""")
def clean_types(spark, sf_dir):
    raw = v.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("zip"),
        F.col("o_custkey").cast("string").alias("zip_number"),
        F.col("o_totalprice").cast("string").alias("fine_tot"),
        (F.col("o_orderkey") % 1000).cast("string").alias("deficiency_tag1"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("filedate"),
    )
    typed = cols.cast_numbers(raw, ["fine_tot"])
    return typed.withColumns({
        "zip_number": F.col("zip_number").cast("int"),
        "deficiency_tag1": F.col("deficiency_tag1").cast("bigint"),
        "filedate": val.parse_date(F.col("filedate"), "MM/dd/yyyy", "yyyy-MM-dd"),
    })


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS score FROM orders""")
def lenient_numeric(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise(
        F.col("o_totalprice").cast("string")
    )
    raw = v.table(spark, sf_dir, "orders").select("o_orderkey", text.alias("score"))
    return cols.cast_numbers(raw, ["score"], strict=False)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS inspect_date,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(year(o_orderdate) AS INT) END AS insp_year,
  CAST(o_orderdate AS DATE) AS any_format FROM orders""")
def parse_dates(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(
        F.date_format("o_orderdate", "MM/dd/yyyy")
    )
    raw = v.table(spark, sf_dir, "orders").select("o_orderkey", text.alias("inspection_date"))
    dated = raw.withColumns({
        "inspect_date": val.parse_date(F.col("inspection_date")),
        "any_format": val.parse_date(F.col("inspection_date"), "MM/dd/yyyy", "yyyy-MM-dd"),
    })
    return dated.withColumn("insp_year", F.year("inspect_date")).drop("inspection_date")


@query("""SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN true WHEN 'N' THEN false END AS ccrc_facil
FROM lineitem""")
def flag_yn(spark, sf_dir):
    lines = v.table(spark, sf_dir, "lineitem")
    text = F.translate("l_returnflag", "A", "Y")
    return lines.select("l_orderkey", "l_linenumber", val.yes_no(text).alias("ccrc_facil"))


@query("SELECT o_custkey AS facility_id, o_totalprice AS fine_tot FROM orders")
def prefix_drop(spark, sf_dir):
    orders = v.table(spark, sf_dir, "orders").withColumnsRenamed({"o_custkey": "PROVNUM", "o_totalprice": "FINE_TOT"})
    kept = cols.lower_names(cols.drop_prefixed(orders, ("o_order",)))
    return kept.withColumnsRenamed({"provnum": "facility_id", "absent": "ignored"})


@query("SELECT n_nationkey AS facility_id, n_name AS state, n_regionkey AS zone FROM nation")
def positional_rename(spark, sf_dir):
    return cols.rename_positions(v.table(spark, sf_dir, "nation"), ["facility_id", "state", "zone"])


def as_text(df, header: bool = True, encoding: str = "UTF-8") -> str:
    """A table as CSV files in the session's shared folder."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/files-{uuid.uuid4().hex}"
    files.write_csv(df, path, header=header, encoding=encoding)
    return path


@query("""SELECT CAST(c_custkey AS VARCHAR) AS facility_id, c_name AS facility_name, c_mktsegment AS segment
FROM customer""")
def header_promote(spark, sf_dir):
    """The header comes from the files: text without a stated schema, its first record naming the columns."""
    customers = v.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("facility_id"), F.col("c_name").alias("facility_name"), F.col("c_mktsegment").alias("segment")
    )
    return headed.read_headed(spark, as_text(customers))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS eventid, CASE WHEN year(o_orderdate) >= 1997 THEN CAST(o_custkey AS VARCHAR) END AS
  facility_id, o_orderstatus AS status, CASE WHEN year(o_orderdate) < 1999 THEN o_orderpriority END AS priority FROM orders""")
def extracts_of_layouts(spark, sf_dir):
    """Extracts of three layouts, two of them with a saved index, read in one scan and joined by column name."""
    orders = v.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("eventid"), F.col("o_custkey").alias("facility_id"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"), F.year("o_orderdate").alias("y"), F.lit(0).alias("Unnamed: 0"),
    )
    folders = [
        as_text(orders.where("y < 1997").select("Unnamed: 0", "eventid", "status", "priority")),
        as_text(orders.where("y BETWEEN 1997 AND 1998").select("Unnamed: 0", "priority", "facility_id", "eventid", "status")),
        as_text(orders.where("y >= 1999").select("status", "eventid", "facility_id")),
    ]
    return headed.read_extracts(spark, folders, part="part").select("eventid", "facility_id", "status", "priority")


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS id, 'Señor ' || s_name AS name, s_acctbal AS estimate FROM supplier""")
def csv_round_trip(spark, sf_dir):
    """Latin-1 text with and without a header, typed on reading, written to parquet and read again."""
    suppliers = v.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("id"), F.concat(F.lit("Señor "), "s_name").alias("name"), F.col("s_acctbal").alias("estimate")
    )
    schema = suppliers.schema
    bare = files.read_text_columns(spark, as_text(suppliers, header=False, encoding=files.LATIN_1), schema.names, header=False, encoding=files.LATIN_1)
    typed = files.read_typed(spark, as_text(bare, encoding=files.LATIN_1), schema, encoding=files.LATIN_1)
    target = f"{shared_folder(spark).rstrip('/')}/files-{uuid.uuid4().hex}"
    files.write_table(typed, target)
    return files.read_table(spark, target, schema)


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS iso, CAST(o_orderdate AS DATE) AS month_first,
  CAST(o_orderdate AS DATE) AS day_first, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderdate AS DATE) END AS mixed FROM orders""")
def recognised_dates(spark, sf_dir):
    """No format is stated: each column's are found in its rows."""
    day = F.col("o_orderdate")
    mixed = F.when(F.col("o_orderkey") % 5 == 0, "unknown").when(
        F.col("o_orderkey") % 2 == 0, F.date_format(day, "yyyyMMdd")
    ).otherwise(F.date_format(day, "MMMM d, yyyy"))
    raw = v.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.date_format(day, "yyyy-MM-dd").alias("iso"), F.date_format(day, "MM/dd/yyyy").alias("month_first"),
        F.date_format(day, "d/M/yyyy").alias("day_first"), mixed.alias("mixed"),
    )
    return dates.recognise_dates(raw, ["iso", "month_first", "day_first", "mixed"])


WIDE = 41


@query(f"""SELECT o_orderkey AS id, {", ".join(
    f"CASE WHEN o_orderkey % {i % 7 + 2} > 0 THEN CAST(o_custkey + {i} AS DOUBLE) END AS p{i}" for i in range(32, WIDE))},
  lower(o_orderstatus) = 'o' AS ccrc_facil FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT o_orderkey, {", ".join(
    f"CASE WHEN o_orderkey % {i % 7 + 2} > 0 THEN CAST(o_custkey + {i} AS DOUBLE) END" for i in range(32, WIDE))}, NULL
  FROM orders WHERE o_orderstatus = 'P'""")
def extract_by_position(spark, sf_dir):
    """The combined extract's cast of the columns 32 to 40 by their place."""
    orders = v.table(spark, sf_dir, "orders")
    places = {f"p{i}": F.when(F.col("o_orderkey") % (i % 7 + 2) > 0, (F.col("o_custkey") + i).cast("string")).otherwise("none") for i in range(2, WIDE)}
    flag = F.when(F.col("o_orderstatus") == "O", "Y").when(F.col("o_orderstatus") == "F", "N")
    raw = orders.select(F.col("o_orderkey").alias("ID"), flag.alias("ccrc_facil"), *[c.alias(n) for n, c in places.items()])
    typed = jobs.typed_extract(raw)
    return typed.select("id", *[f"p{i}" for i in range(32, WIDE)], "ccrc_facil")


@query("""SELECT c_custkey AS facility_id, c_name AS facility_name, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS balance
FROM customer WHERE c_acctbal >= 0 ORDER BY c_custkey LIMIT 500""")
def capped_batch(spark, sf_dir):
    """The first work items of a batch, blanks in names closed up, NaN counted as missing."""
    customers = v.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("Facility ID"), F.col("c_name").alias("Facility Name"),
        F.when(F.col("c_acctbal") < 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal")).alias("Balance"),
    )
    named = cols.lower_names(customers, underscore=True).withColumn("balance", val.null_if_nan(F.col("balance")))
    return rows.top(named.where(F.col("balance").isNotNull()), ["facility_id"], 500)


@query("""SELECT o_custkey AS facility_id, o_totalprice AS fine_tot, CAST(year(o_orderdate) AS INT) AS file_year
FROM orders""")
def era_union(spark, sf_dir):
    name = F.concat(F.lit("ProviderInfo_Nov"), F.year("o_orderdate").cast("string"), F.lit(".csv"))
    orders = v.table(spark, sf_dir, "orders")
    eras = {
        (1900, 1996): ({"o_custkey": "PROVNUM", "o_totalprice": "FINE_TOT"},
               {"PROVNUM": "Federal Provider Number", "FINE_TOT": "Total Fines"}),
        (1997, 1998): ({"o_custkey": "Federal Provider Number", "o_totalprice": "Total Fines"}, {}),
        (1999, 2099): ({"o_custkey": "CCN", "o_totalprice": "Total Fines"}, {"CCN": "Federal Provider Number"}),
    }

    def era(first: int, last: int):
        dates = [F.lit(f"{y}-01-01 00:00:00").cast("timestamp_ntz") for y in (first, last + 1)]
        rows_ = orders.where((F.col("o_orderdate") >= dates[0]) & (F.col("o_orderdate") < dates[1]))
        return rows_.select("o_custkey", "o_totalprice", val.file_year(name).alias("file_year"))

    parts = [(era(*years).withColumnsRenamed(given), renames) for years, (given, renames) in eras.items()]
    combined = cols.union_eras(parts, ["Federal Provider Number", "Total Fines", "file_year"])
    long_names = {"FACILITY_ID": "Federal Provider Number", "FINE_TOT": "Total Fines"}
    return combined.withColumnsRenamed(cols.short_names(long_names))


@query(f"""WITH {CITATIONS}, {COORDINATES}, d AS (
  SELECT DISTINCT state, insp_year, facility_id, deficiency_tag FROM cit)
SELECT facility_id, insp_year, round(lat, 6) AS lat, round(lon, 6) AS lon, deficiency_tag
FROM d LEFT JOIN geo USING (facility_id)""")
def geo_merge(spark, sf_dir):
    return positions(spark, sf_dir)


def positions(spark, sf_dir):
    extract = lookups.coordinate_extract(v.citations(spark, sf_dir), v.coordinates(spark, sf_dir))
    return extract.withColumns({c: F.round(c, 6) for c in ("lat", "lon")})


@query(f"""WITH {MEASURES}, {COORDINATES}
SELECT fy.*, round(lat, 6) AS lat, round(lon, 6) AS lon FROM fy JOIN geo USING (facility_id)""")
def coords_inner(spark, sf_dir):
    table = measures.facility_year_measures(v.citations(spark, sf_dir), v.SEVERE_TYPES)
    places = v.inspected_orders(spark, sf_dir, state=False).join(v.coordinates(spark, sf_dir), "facility_id")
    places = places.withColumn("insp_year", F.col("insp_year").cast("string"))
    joined = lookups.inner_coordinates(table.drop("known_facility", "list_tags", "scope_list", "severe_pairs"), places)
    return joined.withColumns({c: F.round(c, 6) for c in ("lat", "lon")})


@query(f"""WITH {CITATIONS}, {COORDINATES}, d AS (
  SELECT DISTINCT state, insp_year, facility_id, deficiency_tag FROM cit)
SELECT facility_id, insp_year, round(lat, 6) AS lat, round(lon, 6) AS lon, count(deficiency_tag) AS def_tags
FROM d JOIN geo USING (facility_id) GROUP BY ALL""")
def geo_point_counts(spark, sf_dir):
    return lookups.point_counts(positions(spark, sf_dir))


def homes(spark, sf_dir):
    rows_ = v.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("facility_id"), F.col("c_name").alias("address"),
        F.col("c_mktsegment").alias("city"), F.col("c_nationkey").cast("string").alias("zip"),
    )
    return v.with_state(spark, sf_dir, rows_)


ADDRESS = ["address", "city", "state", "zip"]
HOMES = """homes AS (SELECT c_custkey AS facility_id, c_name AS address, c_mktsegment AS city, n_name AS state,
  CAST(c_nationkey AS VARCHAR) AS zip FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


@query(f"""WITH {HOMES} SELECT facility_id, city, state FROM (
  SELECT *, row_number() OVER (PARTITION BY city, state ORDER BY facility_id) AS n FROM homes) WHERE n = 1""")
def first_per_address(spark, sf_dir):
    first = rows.first_per_key(homes(spark, sf_dir), ["city", "state"], [F.col("facility_id")])
    return first.select("facility_id", "city", "state")


@query(f"WITH {HOMES} SELECT * FROM homes WHERE facility_id % 3 <> 0")
def unmatched_addresses(spark, sf_dir):
    all_homes = homes(spark, sf_dir)
    known = all_homes.where("facility_id % 3 = 0")
    return lookups.unmatched(all_homes, known, ADDRESS).select("facility_id", *ADDRESS)


@query(f"""WITH {HOMES}, {COORDINATES}, p AS (
  SELECT facility_id, CASE WHEN facility_id % 3 = 0 THEN 1 WHEN facility_id % 3 = 1 THEN 2 END AS pass FROM homes)
SELECT facility_id, address, city, state, zip,
  CASE WHEN geo.facility_id IS NOT NULL AND pass IS NOT NULL THEN round(lon, 6) END AS lon,
  CASE WHEN geo.facility_id IS NOT NULL AND pass IS NOT NULL THEN round(lat, 6) END AS lat,
  CASE WHEN geo.facility_id IS NOT NULL THEN CAST(pass AS INT) END AS source_pass,
  geo.facility_id IS NOT NULL AND pass IS NOT NULL AS found
FROM homes JOIN p USING (facility_id) LEFT JOIN geo USING (facility_id)""")
def geocode_backfill(spark, sf_dir):
    all_homes = homes(spark, sf_dir)
    answers = all_homes.join(v.coordinates(spark, sf_dir).drop("x"), "facility_id")
    passes = [answers.where("facility_id % 3 = 0"), answers.where("facility_id % 3 IN (0, 1)")]
    filled = lookups.backfill(all_homes, ADDRESS, passes)
    return filled.withColumns({c: F.round(c, 6) for c in ("lon", "lat")})


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value END AS lon,
  CASE WHEN event_id % 3 = 0 THEN CAST(json_extract(props, '$.k') AS DOUBLE) END AS lat FROM events""")
def geocode_json(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    good = F.format_string(
        '{"result":{"addressMatches":[{"coordinates":{"x":%s,"y":%s}},{"coordinates":{"x":0,"y":0}}]}}',
        F.col("value").cast("string"), k,
    )
    body = (
        F.when(F.col("event_id") % 3 == 0, good)
        .when(F.col("event_id") % 3 == 1, F.lit('{"result":{"addressMatches":[]}}'))
        .otherwise(F.lit("<html>busy"))
    )
    replies = v.table(spark, sf_dir, "events").select("event_id", val.first_match(body).alias("p"))
    return replies.select("event_id", F.col("p.x").alias("lon"), F.col("p.y").alias("lat"))


@query(f"""WITH {HOMES} SELECT facility_id, address || ', ' || city || ', ' || state || ', ' || zip AS address_key,
  regexp_replace(trim(address || '  ' || city), '\\s+', '+', 'g') AS street FROM homes""")
def address_key(spark, sf_dir):
    line = val.address_line(*[F.col(c) for c in ADDRESS])
    street = val.plus_joined(F.concat_ws("  ", "address", "city"))
    return homes(spark, sf_dir).select("facility_id", line.alias("address_key"), street.alias("street"))


@query("""SELECT user_id AS "GEOID", CASE WHEN event_type LIKE '%i%' THEN 'white' ELSE 'non-white' END AS race,
  round(coalesce(sum(value), 0), 4) AS poptot FROM events
WHERE event_type IN ('click', 'signup', 'view', 'error') GROUP BY ALL""")
def race_population(spark, sf_dir):
    estimates = v.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("GEOID"), F.col("event_type").alias("variable"), F.col("value").alias("estimate")
    ).where(F.col("variable").isin("click", "signup", "view", "error"))
    totals = lookups.population_by_group(estimates, part="i")
    return totals.withColumn("poptot", F.round("poptot", 4))
