"""Registry of the queries with the SQL that checks them."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

CITATIONS = """cit AS (
  SELECT n_name AS state, CAST(year(o_orderdate) AS INT) AS insp_year, c_custkey AS facility_id,
         l_orderkey AS eventid, p_brand AS deficiency_tag, p_type AS scope_severity,
         l_quantity, l_extendedprice, l_discount, l_tax
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)"""
SEVERE = "scope_severity IN ('PROMO', 'LARGE', 'SMALL')"
MEASURES = f"""{CITATIONS}, fy AS (
  SELECT state, insp_year, facility_id, count(DISTINCT eventid) AS fac_times_inspected,
         count(DISTINCT deficiency_tag) AS no_of_tags_peryear,
         count(DISTINCT CASE WHEN {SEVERE} THEN scope_severity END) AS severe_tags_applied
  FROM cit GROUP BY ALL)"""
PROVIDERS = """prov AS (
  SELECT facility_id, insp_year, avg(l_quantity) AS bedcert, avg(l_extendedprice) AS restot,
         avg(l_discount) AS aidhrd, avg(l_tax) AS rnhrd
  FROM cit GROUP BY ALL)"""
COORDINATES = """geo AS (
  SELECT vec_id AS facility_id, CAST(embedding[1] AS DOUBLE) * 50 - 95 AS lon,
         CAST(embedding[2] AS DOUBLE) * 20 + 38 AS lat, CAST(label AS DOUBLE) AS x
  FROM embeddings)"""
LABELLED = f"""{CITATIONS}, lab AS (
  SELECT DISTINCT CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS tag_number FROM part),
lab2 AS (
  SELECT tag_number, ['Resident Rights', 'Quality of Life and Care', 'Nursing', 'Pharmacy',
         'Environment'][tag_number % 5 + 1] AS category FROM lab),
lc AS (
  SELECT category, insp_year, state, facility_id, l_quantity AS bedcert FROM cit
  LEFT JOIN lab2 ON CAST(regexp_extract(deficiency_tag, '([0-9]+)', 1) AS BIGINT) = tag_number),
counts AS (SELECT category, insp_year, count(bedcert) AS bedcert_count FROM lc GROUP BY ALL)"""


def query(sql: str | None = None):
    """Register a query under its function name."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql.strip()
        return fn

    return add
