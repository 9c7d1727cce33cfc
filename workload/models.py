"""Regression and vector statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from citegrain.operators import lookups, measures, regression, summaries
from workload import views as v
from workload.registry import MEASURES, PROVIDERS, query

NUMERIC = [
    "severe_tags_applied", "fac_times_inspected", "count_nh_insp_st_yr", "bedcert", "restot", "aidhrd", "rnhrd",
]
LINES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def tag_model(spark, sf_dir):
    """The studied model with a reproducible split, solved until steps gain nothing."""
    measures = lookups.facility_year_quality(v.citations(spark, sf_dir), severe=v.SEVERE_TYPES)
    merged = lookups.merge_providers(measures, v.provider_info(spark, sf_dir))
    owners = v.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("facility_id"), F.col("c_mktsegment").alias("ownership")
    )
    full = merged.join(owners, "facility_id")
    columns = ["facility_id", "state", "ownership", "no_of_tags_peryear", *NUMERIC]
    section = regression.cross_section(full.select("insp_year", *columns), 2000, columns)
    return regression.fit_tag_model(
        section, "no_of_tags_peryear", NUMERIC, ["ownership"], "state", ["facility_id"],
        F.pmod(F.col("facility_id") * 37, F.lit(100)), tolerance=1e-12,
    )


# The optimum of the elastic net by coordinate descent on the covariances of the scaled features, which shares
# no step with the fitted model: a coordinate is the soft-thresholded partial covariance over its variance plus
# the ridge part.  The label counts in units of its deviation, which scales the ridge part only.
MODEL_SQL = f"""{MEASURES}, {PROVIDERS}, st AS (
  SELECT state, insp_year, count(DISTINCT facility_id) AS count_nh_insp_st_yr FROM cit GROUP BY ALL),
sec AS (
  SELECT DISTINCT facility_id, state, c_mktsegment AS ownership, no_of_tags_peryear AS y, facility_id * 37 % 100 AS side,
    {", ".join(NUMERIC)}
  FROM fy JOIN st USING (state, insp_year) JOIN prov USING (facility_id, insp_year) JOIN customer ON c_custkey = facility_id
  WHERE insp_year = 2000 AND c_mktsegment IS NOT NULL AND {" AND ".join(f"{c} IS NOT NULL" for c in NUMERIC)}),
states AS (SELECT state, row_number() OVER (ORDER BY count(*) DESC, state) - 1 AS code FROM sec GROUP BY state),
owners AS (SELECT ownership, row_number() OVER (ORDER BY count(*) DESC, ownership) - 1 AS code FROM sec GROUP BY ownership),
feat AS (
  SELECT facility_id, side, y, list_concat([{", ".join(f"{c}::DOUBLE" for c in NUMERIC)}, owners.code::DOUBLE],
    [CASE WHEN states.code = k THEN 1e0 ELSE 0e0 END FOR k IN range((SELECT count(*) - 1 FROM states))]) AS f
  FROM sec JOIN states USING (state) JOIN owners USING (ownership)),
raw AS (SELECT facility_id, side, y, unnest(f) AS f, generate_subscripts(f, 1) AS j FROM feat),
sd AS (SELECT j, stddev_samp(f) AS s FROM raw GROUP BY j),
x AS (SELECT facility_id, side, y, j, CASE WHEN s > 0 THEN f / s ELSE 0e0 END AS f FROM raw JOIN sd USING (j)),
train AS (SELECT * FROM x WHERE side < 80),
cov AS (SELECT a.j, b.j AS k, covar_pop(a.f, b.f) AS v FROM train a JOIN train b USING (facility_id) GROUP BY ALL),
lab AS (SELECT j, covar_pop(f, y) AS c, avg(f) AS mx FROM train GROUP BY j),
g AS (SELECT j, list(v ORDER BY k) AS g, any_value(c) AS c, any_value(mx) AS mx FROM cov JOIN lab USING (j) GROUP BY j),
par AS (SELECT count(*) AS p, 0.3 * 0.2 / (SELECT stddev_pop(y) FROM feat WHERE side < 80) AS ridge FROM g),
cd AS (
  SELECT 0 AS step, [0e0 FOR k IN range((SELECT p FROM par))] AS b
  UNION ALL
  SELECT step + 1, list_concat(b[:j - 1], [
    sign(c - list_dot_product(g, b) + g[j] * b[j])
    * greatest(abs(c - list_dot_product(g, b) + g[j] * b[j]) - 0.3 * 0.8, 0) / (g[j] + ridge)], b[j + 1:])
  FROM cd, par, g WHERE j = step % p + 1 AND step < 60 * p),
best AS (SELECT arg_max(b, step) AS b FROM cd),
coef AS (SELECT j, b[j] AS b, mx FROM g, best),
line AS (SELECT (SELECT avg(y) FROM feat WHERE side < 80) - sum(b * mx) AS a FROM coef),
names AS (
  SELECT unnest([{", ".join(f"'{c}'" for c in NUMERIC)}, 'ownership_index']) AS feature, unnest(range(1, {len(NUMERIC) + 2})) AS j
  UNION ALL SELECT state, code + {len(NUMERIC) + 2} FROM states WHERE code < (SELECT max(code) FROM states)),
pred AS (SELECT facility_id, side, y, a + sum(b * f) AS p FROM x JOIN coef USING (j), line GROUP BY facility_id, side, y, a)"""


@query(f"""WITH RECURSIVE {MODEL_SQL}
SELECT 0::INT AS position, 'intercept' AS feature, round(a, 5) AS coefficient FROM line
UNION ALL SELECT j::INT, feature, round(b, 5) FROM coef JOIN names USING (j)""")
def regression_coefficients(spark, sf_dir):
    return tag_model(spark, sf_dir).coefficients().withColumn("coefficient", F.round("coefficient", 5))


@query(f"""WITH RECURSIVE {MODEL_SQL} SELECT facility_id, y AS no_of_tags_peryear, round(p, 5) AS predicted
FROM pred WHERE side >= 80""")
def regression_predictions(spark, sf_dir):
    return tag_model(spark, sf_dir).predictions().select(
        "facility_id", "no_of_tags_peryear", F.round("pr_no_of_tags_peryear", 5).alias("predicted")
    )


@query(f"""WITH RECURSIVE {MODEL_SQL}, tr AS (SELECT * FROM pred WHERE side < 80)
SELECT 'train_rmse' AS metric, round(sqrt(avg((y - p) ** 2)), 6) AS value FROM tr
UNION ALL SELECT 'train_mae', round(avg(abs(y - p)), 6) FROM tr
UNION ALL SELECT 'train_r2', round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) FROM tr
UNION ALL SELECT 'test_rmse', round(sqrt(avg((y - p) ** 2)), 6) FROM pred WHERE side >= 80""")
def regression_metrics(spark, sf_dir):
    return tag_model(spark, sf_dir).metrics().withColumn("value", F.round("value", 6))


# One predictor and the model's settings (0.3, 0.8) leave a soft-thresholded slope in closed form.
LINE_SQL = f"""{MEASURES}, sec AS (
  SELECT facility_id, no_of_tags_peryear AS y, fac_times_inspected AS x FROM fy WHERE insp_year = 2000),
sc AS (SELECT facility_id, y, x / (SELECT stddev_samp(x) FROM sec) AS x, facility_id * 37 % 100 AS side FROM sec),
fit AS (SELECT covar_pop(x, y) AS c, var_pop(x) AS v, stddev_pop(y) AS s, avg(x) AS mx, avg(y) AS my
  FROM sc WHERE side < 80),
line AS (SELECT my - b * mx AS a, b FROM (
  SELECT *, sign(c) * greatest(abs(c) - 0.3 * 0.8, 0) / (v + 0.3 * 0.2 / s) AS b FROM fit)),
pred AS (SELECT facility_id, y, side, a + b * x AS p FROM sc, line)"""


def tag_line(spark, sf_dir):
    fy = measures.facility_year_measures(v.citations(spark, sf_dir, years=(2000, 2000)), v.SEVERE_TYPES)
    columns = ["facility_id", "no_of_tags_peryear", "fac_times_inspected"]
    section = regression.cross_section(fy.select("insp_year", *columns), 2000, columns)
    side = F.pmod(F.col("facility_id") * 37, F.lit(100))
    return regression.fit_tag_model(
        section, "no_of_tags_peryear", ["fac_times_inspected"], [], None, ["facility_id"], side, tolerance=1e-12
    )


@query(f"""WITH {LINE_SQL} SELECT CAST(0 AS INT) AS position, 'intercept' AS feature, round(a, 6) AS coefficient FROM line
UNION ALL SELECT CAST(1 AS INT), 'fac_times_inspected', round(b, 6) FROM line""")
def regression_line_coefficients(spark, sf_dir):
    return tag_line(spark, sf_dir).coefficients().withColumn("coefficient", F.round("coefficient", 6))


@query(f"WITH {LINE_SQL} SELECT facility_id, y AS no_of_tags_peryear, round(p, 6) AS predicted FROM pred WHERE side >= 80")
def regression_line_predictions(spark, sf_dir):
    return tag_line(spark, sf_dir).predictions().select(
        "facility_id", "no_of_tags_peryear", F.round("pr_no_of_tags_peryear", 6).alias("predicted")
    )


@query(f"""WITH {LINE_SQL}, tr AS (SELECT * FROM pred WHERE side < 80)
SELECT 'train_rmse' AS metric, round(sqrt(avg((y - p) ** 2)), 4) AS value FROM tr
UNION ALL SELECT 'train_mae', round(avg(abs(y - p)), 4) FROM tr
UNION ALL SELECT 'train_r2', round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 4) FROM tr
UNION ALL SELECT 'test_rmse', round(sqrt(avg((y - p) ** 2)), 4) FROM pred WHERE side >= 80""")
def regression_line_metrics(spark, sf_dir):
    return tag_line(spark, sf_dir).metrics().withColumn("value", F.round("value", 4))


@query(f"""WITH {MEASURES}, sec AS (SELECT facility_id, state, fac_times_inspected AS x FROM fy WHERE insp_year = 2000),
codes AS (SELECT state, row_number() OVER (ORDER BY count(*) DESC, state) - 1 AS code FROM sec GROUP BY state)
SELECT facility_id, state, CAST(code AS DOUBLE) AS state_index,
  CASE WHEN code < (SELECT max(code) FROM codes) THEN code END AS level,
  round(x / (SELECT stddev_samp(x) FROM sec), 9) AS scaled FROM sec JOIN codes USING (state)""")
def regression_features(spark, sf_dir):
    fy = measures.facility_year_measures(v.citations(spark, sf_dir, years=(2000, 2000)), v.SEVERE_TYPES)
    section = fy.select("facility_id", "state", "fac_times_inspected")
    made = regression.encoded_features(section, ["fac_times_inspected"], [], "state")
    return made.select(
        "facility_id", "state", "state_index", "level", F.round(F.get("scaled", F.lit(0)), 9).alias("scaled")
    )


def pair_sql(source: str, prefix: str = "") -> str:
    pairs = [(a, b) for i, a in enumerate(LINES) for b in LINES[i:]]
    return " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({prefix}{a}, {prefix}{b}), 6) AS correlation "
        f"FROM {source}" for a, b in pairs
    )


@query(pair_sql("lineitem"))
def vector_corr_pearson(spark, sf_dir):
    lines = v.table(spark, sf_dir, "lineitem").select(*LINES)
    return regression.vector_correlations(lines, LINES).withColumn("correlation", F.round("correlation", 6))


RANKS = "WITH ranked AS (SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS r_{c}" for c in LINES
) + " FROM lineitem) "


@query(RANKS + pair_sql("ranked", "r_"))
def vector_corr_spearman(spark, sf_dir):
    lines = v.table(spark, sf_dir, "lineitem").select(*LINES)
    return summaries.rank_correlations(lines, LINES).withColumn("correlation", F.round("correlation", 6))


@query(" UNION ALL ".join(
    f"SELECT CAST({i} AS INT) AS position, '{kind}' AS kind, round({mean}, 3) AS mean, count(*) AS count FROM lineitem"
    for i, c in enumerate(LINES)
    for kind, mean in (("plain", f"avg({c})"), ("weighted", f"sum({c} * l_quantity) / sum(l_quantity)"))
))
def vector_summary(spark, sf_dir):
    vectors = regression.as_vector(v.table(spark, sf_dir, "lineitem").select(*LINES), LINES)
    plain = regression.vector_summary(vectors).withColumn("kind", F.lit("plain"))
    weighted = regression.vector_summary(vectors, weight=F.col("l_quantity")).withColumn("kind", F.lit("weighted"))
    return plain.unionByName(weighted).withColumn("mean", F.round("mean", 3))
