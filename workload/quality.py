"""Facility, state and year measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from citegrain.operators import lookups, measures, rows, summaries
from citegrain.operators.columns import wide_to_long
from citegrain.plans import jobs
from workload import views as v
from workload.registry import CITATIONS, LABELLED, MEASURES, PROVIDERS, SEVERE, query

YEAR_LIST = v.YEARS


def fy(spark, sf_dir):
    return measures.facility_year_measures(v.citations(spark, sf_dir), v.SEVERE_TYPES)


def tag_counts(spark, sf_dir):
    """Of the facility-year measures the number of tags alone."""
    cited = v.citations(spark, sf_dir, state=False)
    return measures.distinct_counts(cited, ["insp_year", "facility_id"], ["deficiency_tag"], "no_of_tags_peryear")


@query(f"""WITH {CITATIONS}, fy AS (
  SELECT state, insp_year, facility_id, count(DISTINCT eventid) AS fac_times_inspected,
         count(DISTINCT deficiency_tag) AS no_of_tags_peryear,
         count(DISTINCT CASE WHEN {SEVERE} THEN scope_severity END) AS severe_tags_applied,
         coalesce(array_to_string(list_sort(list(DISTINCT deficiency_tag)), '|'), '') AS list_tags,
         coalesce(array_to_string(list_sort(list(DISTINCT scope_severity)), '|'), '') AS scope_list,
         coalesce(array_to_string(list_sort(list(DISTINCT deficiency_tag || '-' || scope_severity)
           FILTER (WHERE {SEVERE})), '|'), '') AS severe_pairs
  FROM cit GROUP BY ALL)
SELECT fy.*, count_nh_insp_st_yr, count_events_st_yr FROM fy JOIN (
  SELECT state, insp_year, count(DISTINCT facility_id) AS count_nh_insp_st_yr,
         count(DISTINCT (facility_id, eventid)) AS count_events_st_yr
  FROM cit GROUP BY ALL) USING (state, insp_year)""")
def facility_year_quality(spark, sf_dir):
    table = lookups.facility_year_quality(v.citations(spark, sf_dir), severe=v.SEVERE_TYPES)
    lists = ("list_tags", "scope_list", "severe_pairs")
    return table.withColumns({c: F.concat_ws("|", c) for c in lists})


@query(f"""WITH {CITATIONS} SELECT state, insp_year, count(DISTINCT facility_id) AS count_nh_insp_st_yr
FROM cit GROUP BY ALL""")
def state_year_facilities(spark, sf_dir):
    return measures.state_year_facilities(v.citations(spark, sf_dir, tags=False))


EVENTS_BY_STATE = f"""{CITATIONS}, ev AS (
  SELECT state, insp_year, count(DISTINCT (facility_id, eventid)) AS n_events FROM cit GROUP BY ALL)"""


@query(f"WITH {EVENTS_BY_STATE} SELECT * FROM ev")
def state_year_events(spark, sf_dir):
    return measures.state_year_events(v.citations(spark, sf_dir, tags=False))


@query(f"WITH {CITATIONS} SELECT insp_year, deficiency_tag, count(*) AS n FROM cit GROUP BY ALL")
def tag_year_counts(spark, sf_dir):
    return measures.row_counts(v.citations(spark, sf_dir, state=False), ["insp_year", "deficiency_tag"])


@query(f"WITH {CITATIONS} SELECT insp_year, scope_severity, count(*) AS n FROM cit GROUP BY ALL")
def severity_year_counts(spark, sf_dir):
    counted = measures.row_counts(v.citations(spark, sf_dir, state=False), ["insp_year", "scope_severity"])
    return counted.orderBy("scope_severity", "insp_year")


@query(f"""WITH {CITATIONS} SELECT state, insp_year, facility_id,
  array_to_string(list_sort(list(DISTINCT deficiency_tag)), '|') AS list_tags FROM cit GROUP BY ALL""")
def facility_tag_list(spark, sf_dir):
    return measures.tag_lists(v.citations(spark, sf_dir)).withColumn("list_tags", F.concat_ws("|", "list_tags"))


PIVOT_SQL = f"""{CITATIONS}, piv AS (SELECT state, facility_id, """ + ", ".join(
    f"CAST(nullif(count(*) FILTER (WHERE insp_year = {y}), 0) AS DOUBLE) AS y{y}" for y in YEAR_LIST
) + " FROM cit GROUP BY ALL)"
FLAGS_SQL = f"""{PIVOT_SQL}, flags AS (SELECT state, facility_id, """ + ", ".join(
    f"CAST(y{y} IS NOT NULL AS INT) AS y{y}" for y in YEAR_LIST
) + " FROM piv)"


def pivoted(spark, sf_dir):
    return measures.facility_year_pivot(v.citations(spark, sf_dir, tags=False), YEAR_LIST)


@query(f"WITH {PIVOT_SQL} SELECT * FROM piv")
def facility_year_pivot(spark, sf_dir):
    return pivoted(spark, sf_dir)


@query(f"WITH {FLAGS_SQL} SELECT *, {' + '.join(f'y{y}' for y in YEAR_LIST)} AS yrs_inspected FROM flags")
def years_inspected(spark, sf_dir):
    return measures.years_inspected(pivoted(spark, sf_dir), YEAR_LIST)


@query(f"WITH {FLAGS_SQL} " + " UNION ALL ".join(
    f"SELECT state, facility_id, 'y{y}' AS insp_year, y{y} AS flag FROM flags" for y in YEAR_LIST))
def facility_year_long(spark, sf_dir):
    flags = measures.years_inspected(pivoted(spark, sf_dir), YEAR_LIST)
    return wide_to_long(flags, ["state", "facility_id"], measures.year_columns(YEAR_LIST), "insp_year", "flag")


@query(f"""WITH {EVENTS_BY_STATE}, d AS (
  SELECT *, n_events - lag(n_events) OVER (PARTITION BY state ORDER BY insp_year) AS p_chg FROM ev)
SELECT *, round(p_chg / n_events, 6) AS per_ch FROM d""")
def yoy_change(spark, sf_dir):
    changed = measures.yearly_change(state_year_events(spark, sf_dir), "state", "insp_year", "n_events")
    return changed.withColumn("per_ch", F.round("per_ch", 6))


@query(f"WITH {EVENTS_BY_STATE} SELECT state, n_events FROM ev WHERE insp_year = 2000")
def fewest_in_year(spark, sf_dir):
    cited = v.citations(spark, sf_dir, tags=False, years=(2000, 2000))
    return measures.state_year_events(cited).select("state", "n_events").orderBy("n_events", "state")


@query(f"""WITH {CITATIONS}, k AS (SELECT facility_id, insp_year,
  count(DISTINCT eventid) AS inspections_per_year FROM cit GROUP BY ALL)
SELECT facility_id, insp_year, eventid, deficiency_tag, inspections_per_year
FROM cit JOIN k USING (facility_id, insp_year)""")
def events_per_facility_broadcast(spark, sf_dir):
    cited = v.citations(spark, sf_dir, state=False).select("facility_id", "insp_year", "eventid", "deficiency_tag")
    return measures.attach_distinct_count(
        cited, ["facility_id", "insp_year"], "eventid", "inspections_per_year"
    )


@query(f"""WITH {CITATIONS}, k AS (SELECT facility_id, insp_year, eventid,
  count(DISTINCT deficiency_tag) AS tags_per_inspection FROM cit GROUP BY ALL)
SELECT facility_id, insp_year, eventid, deficiency_tag, tags_per_inspection
FROM cit JOIN k USING (facility_id, insp_year, eventid)""")
def tags_per_event_broadcast(spark, sf_dir):
    cited = v.citations(spark, sf_dir, state=False).select("facility_id", "insp_year", "eventid", "deficiency_tag")
    return measures.attach_distinct_count(
        cited, ["facility_id", "insp_year", "eventid"], "deficiency_tag", "tags_per_inspection"
    )


def labelled(spark, sf_dir):
    tag_number = F.regexp_extract("deficiency_tag", r"([0-9]+)", 1)
    cited = v.citations(spark, sf_dir, extra=("l_quantity",)).withColumnRenamed("l_quantity", "bedcert")
    return cited.withColumn("tag_text", tag_number)


def label_counts(spark, sf_dir):
    return jobs.labelled_counts(labelled(spark, sf_dir), v.tag_categories(spark, sf_dir), "tag_text", "tag_number")


@query(f"WITH {LABELLED} SELECT * FROM counts")
def label_join_counts(spark, sf_dir):
    return label_counts(spark, sf_dir)


@query(f"WITH {LABELLED} SELECT category, " + ", ".join(
    f"avg(bedcert_count) FILTER (WHERE insp_year = {y}) AS y{y}" for y in YEAR_LIST
) + " FROM counts GROUP BY category")
def category_year_pivot(spark, sf_dir):
    return measures.year_pivot(label_counts(spark, sf_dir), "category", "insp_year", "bedcert_count", YEAR_LIST)


@query(f"""WITH {LABELLED} SELECT * FROM counts
ORDER BY bedcert_count DESC, category NULLS LAST, insp_year LIMIT 10""")
def category_topk(spark, sf_dir):
    order = [F.desc("bedcert_count"), F.asc_nulls_last("category"), F.asc("insp_year")]
    return rows.top(label_counts(spark, sf_dir), order, 10)


@query(f"""WITH {LABELLED} SELECT * FROM counts
ORDER BY insp_year, category NULLS LAST LIMIT 5 OFFSET 20""")
def row_slice(spark, sf_dir):
    order = [F.asc("insp_year"), F.asc_nulls_last("category")]
    return rows.top(label_counts(spark, sf_dir), order, 5, skip=20)


MARGINS_SQL = f"""{LABELLED}, care AS (
  SELECT state, insp_year FROM lc WHERE category = 'Quality of Life and Care'),
cells AS (SELECT coalesce(state, 'All') AS state, insp_year, count(*) AS n
  FROM care GROUP BY CUBE (state, insp_year)),
mar AS (SELECT state, """ + ", ".join(
    f"coalesce(max(n) FILTER (WHERE insp_year = {y}), 0) AS y{y}" for y in YEAR_LIST
) + ", max(n) FILTER (WHERE insp_year IS NULL) AS total FROM cells GROUP BY state)"


def care(spark, sf_dir):
    both = lookups.label_tags(labelled(spark, sf_dir), v.tag_categories(spark, sf_dir), "tag_text", "tag_number")
    return both.where(F.col("category") == "Quality of Life and Care")


@query(f"WITH {MARGINS_SQL} SELECT * FROM mar")
def state_year_margins(spark, sf_dir):
    return measures.margins(care(spark, sf_dir), "state", "insp_year", YEAR_LIST).orderBy(F.desc("total"), "state")


@query(f"""WITH {MARGINS_SQL} SELECT state, y1996, y1997, y1998, total,
  round((y1997 / nullif(y1996, 0) - 1) * 100, 6) AS growth_1996_1997,
  round((y1998 / nullif(y1997, 0) - 1) * 100, 6) AS growth_1997_1998 FROM mar""")
def category_growth(spark, sf_dir):
    grown = jobs.category_growth(care(spark, sf_dir), [1996, 1997, 1998])
    names = ("growth_1996_1997", "growth_1997_1998")
    return grown.withColumns({c: F.round(c, 6) for c in names}).orderBy(F.desc("y1998"), "state")


@query(f"""WITH {MEASURES} SELECT insp_year, round(avg(no_of_tags_peryear), 6) AS mean_tags,
  round(quantile_cont(no_of_tags_peryear, 0.99), 6) AS q99_tags, max(no_of_tags_peryear) AS max_tags,
  count(*) AS n FROM fy GROUP BY insp_year""")
def year_summary(spark, sf_dir):
    # percentile keeps one counter per distinct tag count, which the tag list bounds
    return tag_counts(spark, sf_dir).groupBy("insp_year").agg(
        F.round(F.avg("no_of_tags_peryear"), 6).alias("mean_tags"),
        F.round(F.percentile("no_of_tags_peryear", 0.99), 6).alias("q99_tags"),
        F.max("no_of_tags_peryear").alias("max_tags"),
        F.count(F.lit(1)).alias("n"),
    )


def rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in df.columns if c.startswith("mean_")})


@query(f"""WITH {MEASURES} SELECT state, insp_year, round(avg(no_of_tags_peryear), 6) AS
  mean_no_of_tags_peryear, round(avg(severe_tags_applied), 6) AS mean_severe_tags_applied, count(*) AS n
FROM fy GROUP BY ALL""")
def state_year_means(spark, sf_dir):
    return rounded(summaries.grouped_means(
        fy(spark, sf_dir), ["state", "insp_year"], ["no_of_tags_peryear", "severe_tags_applied"]
    ))


STAFFED = f"""{MEASURES}, {PROVIDERS}, st AS (
  SELECT *, insp_year > 1998 AS later FROM fy JOIN prov USING (facility_id, insp_year))"""


def staffed(spark, sf_dir):
    merged = lookups.merge_providers(fy(spark, sf_dir), v.provider_info(spark, sf_dir))
    return merged.select(
        "state", "insp_year", "facility_id", "no_of_tags_peryear", "bedcert", "restot", "aidhrd", "rnhrd"
    ).dropna().withColumn("later", F.col("insp_year") > 1998)


@query(f"""WITH {STAFFED} SELECT no_of_tags_peryear, round(avg(aidhrd), 6) AS mean_aidhrd,
  round(avg(rnhrd), 6) AS mean_rnhrd, round(avg(bedcert), 6) AS mean_bedcert, count(*) AS n
FROM st GROUP BY ALL""")
def tagcount_means(spark, sf_dir):
    return rounded(summaries.grouped_means(
        staffed(spark, sf_dir), ["no_of_tags_peryear"], ["aidhrd", "rnhrd", "bedcert"]
    ))


@query(f"""WITH {STAFFED} SELECT no_of_tags_peryear, later, round(avg(rnhrd), 6) AS mean_rnhrd,
  round(avg(bedcert), 6) AS mean_bedcert, count(*) AS n FROM st GROUP BY ALL""")
def tagcount_period_means(spark, sf_dir):
    return rounded(summaries.grouped_means(
        staffed(spark, sf_dir), ["no_of_tags_peryear", "later"], ["rnhrd", "bedcert"]
    ))


@query(f"""WITH {MEASURES}, lim AS (SELECT min(no_of_tags_peryear) AS lo, max(no_of_tags_peryear) AS hi FROM fy)
SELECT insp_year, CAST(least(floor((no_of_tags_peryear - lo) / (CAST(hi - lo AS DOUBLE) / 20)) + 1, 20) AS INT)
  AS bin, count(*) AS n FROM fy, lim GROUP BY ALL""")
def histogram(spark, sf_dir):
    return summaries.histogram(tag_counts(spark, sf_dir), "no_of_tags_peryear", ["insp_year"])


@query(f"""WITH {MEASURES} SELECT state, round(avg(insp_year), 6) AS mean_insp_year,
  round(avg(fac_times_inspected), 6) AS mean_fac_times_inspected,
  round(avg(no_of_tags_peryear), 6) AS mean_no_of_tags_peryear,
  round(avg(severe_tags_applied), 6) AS mean_severe_tags_applied FROM fy GROUP BY state""")
def numeric_means(spark, sf_dir):
    return rounded(summaries.numeric_means(fy(spark, sf_dir).drop("facility_id", "known_facility"), ["state"]))


@query(f"WITH {MEASURES} SELECT insp_year = 2000 AS covid, count(*) AS n FROM fy GROUP BY ALL")
def period_flag_counts(spark, sf_dir):
    visits = v.citations(spark, sf_dir, tags=False).select(*measures.FACILITY_YEAR).distinct()
    return summaries.value_counts(visits.select((F.col("insp_year") == 2000).alias("covid")), "covid")


@query(f"""WITH {MEASURES}, {PROVIDERS} SELECT fy.*, round(bedcert, 8) AS bedcert, round(restot, 8) AS restot,
  round(aidhrd, 8) AS aidhrd, round(rnhrd, 8) AS rnhrd FROM fy LEFT JOIN prov USING (facility_id, insp_year)""")
def provider_merge(spark, sf_dir):
    merged = lookups.merge_providers(
        fy(spark, sf_dir).drop("known_facility", "list_tags", "scope_list", "severe_pairs"), v.provider_info(spark, sf_dir)
    )
    # averages of cents over 32 rows end in a 5 at the seventh digit, so six digits would round ties
    return merged.withColumns({c: F.round(c, 8) for c in ("bedcert", "restot", "aidhrd", "rnhrd")})
