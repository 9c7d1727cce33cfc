"""Facility-year measures on inline rows."""

import random

import pytest
from pyspark.sql import functions as F

from citegrain.operators import columns as cols
from citegrain.operators import lookups, measures, rows, summaries

SCHEMA = "state string, insp_year int, facility_id string, eventid string, deficiency_tag string, scope_severity string"
CITED = [
    ("AL", 2019, "01", "e1", "F1", "J"),
    ("AL", 2019, "01", "e1", "F1", "D"),
    ("AL", 2019, "01", "e2", "F2", None),
    ("AL", 2019, "02", "e3", "F3", "B"),
    ("AL", 2019, None, "e4", "F4", "K"),
    ("AL", 2020, "01", "e5", None, "L"),
    ("AK", 2019, "07", "e6", "F1", "J"),
    ("AK", 2019, "07", "e6", "F1", "J"),
    ("AK", 2019, "07", "e6", "F2", "L"),
]


@pytest.fixture
def cited(spark):
    return spark.createDataFrame(CITED, SCHEMA)


def test_facility_year_quality(cited):
    got = {(r.state, r.insp_year, r.facility_id): r for r in lookups.facility_year_quality(cited).collect()}
    assert len(got) == 4  # the unknown facility is no row, but counts in its state and year
    one = got["AL", 2019, "01"]
    assert (one.fac_times_inspected, one.no_of_tags_peryear, one.severe_tags_applied) == (2, 2, 1)
    assert one.severe_pairs == ["F1-J"] and one.list_tags == ["F1", "F2"] and one.scope_list == ["D", "J"]
    assert (one.count_nh_insp_st_yr, one.count_events_st_yr) == (3, 4)
    assert got["AL", 2019, "02"].severe_pairs == [] and got["AL", 2019, "02"].severe_tags_applied == 0
    unknown_tag = got["AL", 2020, "01"]
    assert unknown_tag.no_of_tags_peryear == 1 and unknown_tag.severe_pairs == []
    assert got["AK", 2019, "07"].severe_pairs == ["F1-J", "F2-L"]


def test_row_order_and_partitions_do_not_matter(spark, cited):
    expected = sorted(map(str, lookups.facility_year_quality(cited).collect()))
    mixed = CITED[:]
    random.Random(4).shuffle(mixed)
    other = spark.createDataFrame(mixed, SCHEMA).repartition(5)
    assert sorted(map(str, lookups.facility_year_quality(other).collect())) == expected


def test_state_totals_share_the_measure_shuffle(spark, cited, tmp_path):
    cited.write.parquet(str(tmp_path / "cited"))
    table = lookups.facility_year_quality(spark.read.parquet(str(tmp_path / "cited")))
    table.collect()
    plan = table._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    shared = [line for line in plan.splitlines() if "ReusedExchange" in line and "is_event" in line]
    assert len(shared) == 1 and plan.count("FileScan") == 1


def test_distinct_counts_keep_null_values(cited):
    counted = measures.state_year_facilities(cited)
    assert {(r.state, r.insp_year): r.count_nh_insp_st_yr for r in counted.collect()} == {
        ("AL", 2019): 3, ("AL", 2020): 1, ("AK", 2019): 1
    }
    attached = measures.attach_distinct_count(cited, ["state", "insp_year"], "deficiency_tag", "tags")
    assert attached.count() == len(CITED)
    assert {(r.state, r.insp_year): r.tags for r in attached.collect()}["AL", 2020] == 1


def test_pivot_and_flags(cited):
    known = cited.dropna(subset=["facility_id"])
    pivoted = measures.facility_year_pivot(known, [2019, 2020])
    got = {r.facility_id: (r.y2019, r.y2020) for r in pivoted.collect()}
    assert got == {"01": (3.0, 1.0), "02": (1.0, None), "07": (3.0, None)}
    flags = measures.years_inspected(pivoted, [2019, 2020])
    assert {r.facility_id: r.yrs_inspected for r in flags.collect()} == {"01": 2, "02": 1, "07": 1}
    long = cols.wide_to_long(pivoted, ["facility_id"], ["y2019", "y2020"], "year", "n")
    assert long.count() == 4


def test_yearly_change(spark):
    counts = spark.createDataFrame([("A", 1, 10), ("A", 2, 0), ("A", 3, 5)], "s string, y int, n bigint")
    current = measures.yearly_change(counts, "s", "y", "n").orderBy("y").collect()
    assert [r.p_chg for r in current] == [None, -10, 5] and [r.per_ch for r in current] == [None, None, 1.0]
    previous = measures.yearly_change(counts, "s", "y", "n", base="previous").orderBy("y").collect()
    assert [r.per_ch for r in previous] == [None, -1.0, None]


def test_margins_and_growth(spark):
    df = spark.createDataFrame(
        [("AL", 2016), ("AL", 2017), ("AL", 2017), ("AK", 2017), (None, 2016)], "state string, insp_year int"
    )
    table = measures.margins(df, "state", "insp_year", [2016, 2017])
    grown = measures.year_growth(table, "y2016", "y2017", "g")
    got = {r.state: (r.y2016, r.y2017, r.total, r.g) for r in grown.collect()}
    assert got == {"AL": (1, 2, 3, 100.0), "AK": (0, 1, 1, None), "All": (1, 3, 4, 200.0)}


def test_label_join_keeps_unknown_tags(spark):
    cited = spark.createDataFrame([("0880",), ("9",), ("x",)], "deficiency_tag string")
    labels = spark.createDataFrame([(880, "Infection")], "number bigint, category string")
    got = {r.deficiency_tag: r.category for r in lookups.label_tags(cited, labels, "deficiency_tag", "number").collect()}
    assert got == {"0880": "Infection", "9": None, "x": None}


def test_provider_merge_keeps_unmatched_years(spark):
    left = spark.createDataFrame([(2018, "01"), (2019, "01")], "insp_year int, facility_id string")
    right = spark.createDataFrame([(2019, "01", 90.0)], "insp_year int, facility_id string, bedcert double")
    assert {r.insp_year: r.bedcert for r in lookups.merge_providers(left, right).collect()} == {2018: None, 2019: 90.0}


def test_backfill_passes(spark):
    homes = spark.createDataFrame([(i, f"a{i}") for i in range(1, 7)], "id int, address string")
    first = spark.createDataFrame([("a1", 1.0, 1.0), ("a2", None, None)], "address string, lon double, lat double")
    second = spark.createDataFrame([(f"a{i}", 2.0, 2.0) for i in (1, 2, 5)], "address string, lon double, lat double")
    got = {r.id: (r.lon, r.source_pass, r.found)
           for r in lookups.backfill(homes, ["address"], [first, second]).collect()}
    assert got[1] == (1.0, 1, True) and got[2] == (2.0, 2, True) and got[5] == (2.0, 2, True)
    assert got[3] == (None, None, False)
    assert not any(r.found for r in lookups.backfill(homes, ["address"], []).collect())


def test_a_null_position_gives_way_to_a_whole_one(spark):
    cited = spark.createDataFrame([("AL", 2020, "1", "880"), ("AL", 2020, "2", "880")], "state string, insp_year int, facility_id string, deficiency_tag string")
    places = spark.createDataFrame([("1", None, None), ("1", 32.0, -86.0), ("1", 40.0, None), ("2", None, None)], "facility_id string, lat double, lon double")
    got = {r.facility_id: (r.lat, r.lon) for r in lookups.coordinate_extract(cited, places).collect()}
    assert got == {"1": (32.0, -86.0), "2": (None, None)}


def test_population_totals_without_estimates_are_zero(spark):
    df = spark.createDataFrame(
        [("1", "B01001A_014", None), ("1", "B01001B_014", 4.0), ("1", "B01001C_014", 3.0)],
        "GEOID string, variable string, estimate double",
    )
    assert {r.race: r.poptot for r in lookups.population_by_group(df).collect()} == {"white": 0.0, "non-white": 7.0}


def test_first_rows_and_slices(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(30)], "id int, k int")
    assert sorted(r.id for r in rows.first_per_key(df, ["k"], [F.col("id")]).collect()) == [0, 1, 2]
    assert [r.id for r in rows.top(df, [F.col("id")], 5, skip=20).collect()] == [20, 21, 22, 23, 24]
    flagged = {r.id: r.is_repeat for r in rows.repeat_flag(df, ["k"], "id").collect()}
    assert sorted(i for i, repeat in flagged.items() if not repeat) == [0, 1, 2]


def test_column_helpers(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["Footnote a", "Cycle B", "cycle c"])
    kept = cols.drop_prefixed(df, ("Footnote", "cycle"))
    assert kept.columns == ["Cycle B"]
    assert cols.lower_names(kept).columns == ["cycle b"]
    assert cols.lower_names(kept, underscore=True).columns == ["cycle_b"]
    assert cols.rename_positions(df, ["x", "y"]).columns == ["x", "y", "cycle c"]
    assert cols.short_names({"PROVNUM": "Federal Provider Number"}) == {"Federal Provider Number": "provnum"}


def test_header_row_anywhere(spark):
    df = spark.createDataFrame([("1", "x"), ("id", "name"), (None, "y")], "_c0 string, _c1 string")
    assert sorted(map(str, cols.promote_header(df, ["id", "name"]).collect())) == [
        "Row(id='1', name='x')", "Row(id=None, name='y')"
    ]


@pytest.mark.parametrize("values", [[1.0] * 50 + [2.0, 9.0], list(map(float, range(1000))), [3.0], [5.0, None, float("nan"), 1.0]])
def test_exact_quantiles(spark, values):
    import numpy as np

    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    known = [v for v in values if v is not None and v == v]
    wanted = {"a": 0.0, "b": 0.1, "c": 0.25, "d": 0.5, "e": 0.99, "f": 1.0}
    got = summaries.exact_quantiles(df, "v", wanted, ["g"]).first()
    for name, p in wanted.items():
        assert got[name] == pytest.approx(np.quantile(known, p), abs=1e-9)
    assert summaries.exact_quantiles(df, "v", wanted).first()["d"] == pytest.approx(np.quantile(known, 0.5))


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in range(21)], "v double")
    got = {r.bin: r.n for r in summaries.histogram(df, "v").collect()}
    assert got == {**{b: 1 for b in range(1, 20)}, 20: 2}
    same = spark.createDataFrame([(4.0,), (4.0,)], "v double")
    assert [(r.bin, r.n) for r in summaries.histogram(same, "v").collect()] == [(1, 2)]


def test_value_counts_and_nulls(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "x string")
    assert summaries.value_counts(df, "x").count() == 1
    assert summaries.value_counts(df, "x", keep_null=True).count() == 2


def test_rank_correlation(spark):
    import pandas as pd

    rng = random.Random(2)
    data = [(float(rng.randint(0, 4)), rng.random(), float(rng.randint(0, 50))) for _ in range(400)]
    data += [(1.0, 0.5, 2.0)] * 200
    expected = pd.DataFrame(data, columns=["a", "b", "c"]).rank().corr()
    df = spark.createDataFrame(data, "a double, b double, c double")
    for r in summaries.rank_correlations(df, ["a", "b", "c"]).collect():
        assert r.correlation == pytest.approx(expected.loc[r.column_a, r.column_b])
