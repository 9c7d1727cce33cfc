"""Neighbours, hot spots and polygons."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from citegrain.operators import polygons, spatial, summaries
from citegrain.plans import jobs
from workload import views as v
from workload.registry import COORDINATES, query

K = 20
XY = ["lon", "lat"]

NEIGHBOURS = f"""{COORDINATES}, pairs AS (
  SELECT a.facility_id, a.x, b.facility_id AS nbr, b.x AS nbr_x,
         sqrt((b.lon - a.lon) * (b.lon - a.lon) + (b.lat - a.lat) * (b.lat - a.lat)) AS gap
  FROM geo a JOIN geo b ON a.facility_id <> b.facility_id),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY facility_id ORDER BY gap, nbr) AS rank
  FROM pairs) WHERE rank <= {K})"""
LOCAL_G = f"""{NEIGHBOURS}, tot AS (SELECT count(*) AS n, sum(x) AS sx, sum(x * x) AS sq FROM geo),
lags AS (SELECT facility_id, x, avg(nbr_x) AS lag, count(*) AS k FROM near GROUP BY facility_id, x),
par AS (SELECT facility_id, x, lag, k, n, (sx - x) / (n - 1) AS m,
  (sq - x * x) / (n - 1) - ((sx - x) / (n - 1)) * ((sx - x) / (n - 1)) AS s2 FROM lags, tot),
g AS (SELECT facility_id, x, (lag - m) / sqrt(s2 * ((n - 1) / k - 1) / (n - 2)) AS z FROM par)"""
CLASS = """CASE WHEN z < -1.959963984540054 THEN 'blue' WHEN z > 1.959963984540054 THEN 'red' ELSE 'grey' END"""
METRES = f"""{COORDINATES}, pairs AS (
  SELECT a.facility_id, b.facility_id AS nbr,
    2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2)
      + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) AS metres
  FROM geo a JOIN geo b ON a.facility_id <> b.facility_id),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY facility_id ORDER BY metres, nbr) AS rank
  FROM pairs) WHERE rank <= {K})"""


@query(f"WITH {NEIGHBOURS} SELECT facility_id, CAST(rank AS INT) AS rank, nbr, round(gap, 6) AS gap FROM near")
def knn(spark, sf_dir):
    found = spatial.nearest_neighbours(v.coordinates(spark, sf_dir), "facility_id", XY, K)
    return found.select("facility_id", "rank", "nbr", F.round("gap", 6).alias("gap"))


@query(f"WITH {LOCAL_G} SELECT facility_id, x, round(z, 6) AS z FROM g")
def local_g(spark, sf_dir):
    scored = spatial.local_g(v.coordinates(spark, sf_dir), "facility_id", XY, ["x"], K)
    return scored.select("facility_id", "x", F.round("z_x", 6).alias("z"))


@query(f"WITH {LOCAL_G} SELECT {CLASS} AS spot, count(*) AS n FROM g GROUP BY ALL")
def hotspot_class(spark, sf_dir):
    scored = spatial.local_g(v.coordinates(spark, sf_dir), "facility_id", XY, ["x"], K)
    return summaries.value_counts(scored.select(F.col("spot_x").alias("spot")), "spot")


@query(f"WITH {LOCAL_G} SELECT round(corr(x, z), 6) AS correlation FROM g")
def g_correlation(spark, sf_dir):
    scored = spatial.local_g(v.coordinates(spark, sf_dir), "facility_id", XY, ["x"], K)
    return scored.agg(F.round(F.corr("x", "z_x"), 6).alias("correlation"))


@query(f"""WITH {LOCAL_G.replace('geo AS (', 'geo0 AS (', 1).replace('), pairs AS', f"""), geo AS (
  SELECT * EXCLUDE (x), lat AS x FROM geo0), pairs AS""", 1)}, zl AS (SELECT facility_id, round(z, 6) AS z_lat FROM g)
SELECT * FROM zl""")
def shared_weights(spark, sf_dir):
    """Measures scored over one kept neighbour table."""
    points = v.coordinates(spark, sf_dir)
    table = spatial.neighbour_table(points, "facility_id", XY, K, f"weights_{uuid.uuid4().hex}")
    scored = spatial.local_g_of(table, points, "facility_id", ["x", "lat"])
    return scored.select("facility_id", F.round("z_lat", 6).alias("z_lat"))


@query(f"WITH {METRES} SELECT facility_id, CAST(rank AS INT) AS rank, round(metres, 3) AS metres FROM near")
def nn_distances(spark, sf_dir):
    found = spatial.great_circle_neighbours(v.coordinates(spark, sf_dir), "facility_id", "lon", "lat", K)
    return found.select("facility_id", "rank", F.round("metres", 3).alias("metres"))


@query(f"""WITH {METRES}, km AS (SELECT CAST(rank AS INT) AS rank, metres / 1000 AS km FROM near WHERE rank IN (1, 11, 20))
SELECT rank, round(min(km), 6) AS min, round(quantile_cont(km, 0.25), 6) AS q1,
  round(quantile_cont(km, 0.5), 6) AS median, round(avg(km), 6) AS mean,
  round(quantile_cont(km, 0.75), 6) AS q3, round(max(km), 6) AS max FROM km GROUP BY rank""")
def nn_summary(spark, sf_dir):
    found = spatial.great_circle_neighbours(v.coordinates(spark, sf_dir), "facility_id", "lon", "lat", K)
    km = found.where(F.col("rank").isin(1, 11, 20)).select("rank", (F.col("metres") / 1000).alias("km"))
    numbers = summaries.six_numbers(km, "km", ["rank"])
    return numbers.withColumns({c: F.round(c, 6) for c in numbers.columns if c != "rank"})


@query(f"""WITH {NEIGHBOURS} SELECT facility_id, nbr, round(gap, 6) AS gap FROM pairs WHERE gap <= 1.0""")
def band_neighbours(spark, sf_dir):
    found = spatial.band_neighbours(v.coordinates(spark, sf_dir), "facility_id", XY, 1.0)
    return found.select("facility_id", "nbr", F.round("gap", 6).alias("gap"))


@query(f"""WITH {NEIGHBOURS} SELECT geo.facility_id, count(nbr) AS others FROM geo
LEFT JOIN pairs ON pairs.facility_id = geo.facility_id AND gap <= 1.0 GROUP BY ALL""")
def band_counts(spark, sf_dir):
    return spatial.band_counts(v.coordinates(spark, sf_dir), "facility_id", XY, 1.0).select("facility_id", "others")


ROUNDED = f"""{COORDINATES}, r AS (SELECT facility_id, round(lon, 1) AS lon, round(lat, 1) AS lat FROM geo)"""


def coarse(spark, sf_dir):
    return v.coordinates(spark, sf_dir).select(
        "facility_id", F.round("lon", 1).alias("lon"), F.round("lat", 1).alias("lat")
    )


@query(f"""WITH {ROUNDED}, f AS (SELECT *, row_number() OVER (PARTITION BY lon, lat ORDER BY facility_id) - 1 AS n FROM r)
SELECT facility_id, n > 0 AS is_repeat, round(lon + n * 1e-10, 11) AS lon, round(lat + n * 2e-10, 11) AS lat FROM f""")
def dedup_coords(spark, sf_dir):
    moved = spatial.shift_repeats(coarse(spark, sf_dir), "facility_id", XY)
    return moved.select("facility_id", "is_repeat", F.round("lon", 11).alias("lon"), F.round("lat", 11).alias("lat"))


@query(f"WITH {ROUNDED} SELECT count(DISTINCT (lon, lat)) AS places FROM r")
def distinct_coords(spark, sf_dir):
    return coarse(spark, sf_dir).select(*XY).distinct().agg(F.count(F.lit(1)).alias("places"))


TRACTS = f"""{COORDINATES}, tr AS (
  SELECT s_suppkey, lpad(CAST(s_suppkey AS VARCHAR), 11, '0') AS geoid,
    lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS statefp,
    -114e0 + (s_suppkey % 20) * 1.9e0 AS x0, 29.5e0 + (s_suppkey // 20 % 8) * 2e0 AS y0 FROM supplier),
hits AS (SELECT s_suppkey, facility_id, lon, lat FROM tr JOIN geo ON lon > x0 AND lat > y0 AND
  CASE WHEN s_suppkey % 2 = 0 THEN lon < x0 + 1.7e0 AND lat < y0 + 1.6e0
  ELSE (lon - x0) + (lat - y0) < 1.8e0 END)"""


@query(f"""WITH {TRACTS} SELECT geoid, statefp, facility_id, round(lon, 6) AS lon, round(lat, 6) AS lat
FROM tr LEFT JOIN hits USING (s_suppkey)""")
def tract_points(spark, sf_dir):
    placed = polygons.points_in_polygons(
        v.tracts(spark, sf_dir), v.coordinates(spark, sf_dir).drop("x"), "geoid", "wkt", "lon", "lat"
    )
    return placed.select(
        "geoid", "statefp", "facility_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat")
    )


@query(f"""WITH {TRACTS} SELECT geoid, facility_id, s_acctbal AS health
FROM tr LEFT JOIN hits USING (s_suppkey) JOIN supplier USING (s_suppkey)
WHERE statefp NOT IN ('02', '15', '78', '74', '72', '69', '66', '60')""")
def tract_health(spark, sf_dir):
    table = jobs.tract_health(
        v.tracts(spark, sf_dir), v.coordinates(spark, sf_dir).drop("x"), v.tract_health_measures(spark, sf_dir)
    )
    return table.select("geoid", "facility_id", "health")
