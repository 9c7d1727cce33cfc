"""Regression, vector statistics and reports on small data."""

import random

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from citegrain.operators import regression, reports


def people(n=600):
    rng = random.Random(9)
    rows = []
    for i in range(n):
        a, b = rng.uniform(0, 10), rng.uniform(0, 10)
        state, owner = rng.choice(["AL", "AK", "TX"]), rng.choice(["x", "y"])
        rows.append((i, 2022, state, owner, a, b, 3 * a + rng.gauss(0, 0.1)))
    return rows


def test_model_recovers_the_line(spark):
    df = spark.createDataFrame(people(), "id int, insp_year int, state string, owner string, a double, b double, y double")
    section = regression.cross_section(df, 2022, ["id", "state", "owner", "a", "b", "y"])
    model = regression.fit_tag_model(section, "y", ["a", "b"], ["owner"], "state", ["id"])
    table = {r.feature: r.coefficient for r in model.coefficients().collect()}
    assert list(table)[:4] == ["intercept", "a", "b", "owner_index"] and len(table) == 6
    scale = df.agg(F.stddev("a")).first()[0]
    assert table["a"] / scale == pytest.approx(3, abs=0.15) and abs(table["b"]) < 0.05
    metrics = {r.metric: r.value for r in model.metrics().collect()}
    assert metrics["train_r2"] > 0.98 and metrics["test_rmse"] < 1.0
    assert model.train.count() + model.test.count() == 600
    assert 60 < model.test.count() < 180
    assert model.predictions().columns[-1] == "pr_y"


def test_split_does_not_depend_on_partitions(spark):
    df = spark.range(1000)
    parts = [sorted(r.id for r in regression.split(df.repartition(n), ["id"])[1].collect()) for n in (1, 7)]
    assert parts[0] == parts[1] and 130 < len(parts[0]) < 270


def test_cross_section_drops_incomplete_and_repeated_rows(spark):
    df = spark.createDataFrame([(2022, 1), (2022, 1), (2022, None), (2021, 5)], "insp_year int, v int")
    assert [r.v for r in regression.cross_section(df, 2022, ["v"]).collect()] == [1]


def test_vector_statistics(spark):
    data = [(1.0, 0.0, 3.0), (4.0, 5.0, 3.5), (6.0, 7.0, 8.0), (9.0, 0.0, 1.0)]
    df = spark.createDataFrame(data, ["a", "b", "c"])
    expected = np.corrcoef(np.array(data).T)
    for r in regression.vector_correlations(df, ["a", "b", "c"]).collect():
        i, j = "abc".index(r.column_a), "abc".index(r.column_b)
        assert r.correlation == pytest.approx(expected[i][j])
    vectors = spark.createDataFrame(
        [(1.0, Vectors.dense(1.0, 1.0, 1.0)), (0.0, Vectors.dense(1.0, 2.0, 3.0))], ["weight", "features"]
    )
    weighted = regression.vector_summary(vectors, weight=F.col("weight")).orderBy("position").collect()
    assert [r["mean"] for r in weighted] == [1.0, 1.0, 1.0] and weighted[0]["count"] == 1
    plain = regression.vector_summary(vectors).orderBy("position").collect()
    assert [r["mean"] for r in plain] == [1.0, 1.5, 2.0]


def test_co_mentions(spark):
    text = "R#1 told LPN # 3 and r#1. Then NA#7 left! R#1 met lpn#3."
    docs = spark.createDataFrame([(1, text), (2, "nobody here."), (3, None)], "doc int, t string")
    edges = reports.co_mentions(docs, "doc", "t").collect()
    assert [(r.doc, r.a, r.b, r.n) for r in edges] == [(1, "lpn#3", "r#1", 2)]
    sentences = reports.sentence_rows(docs, "doc", "t").where("doc = 1").orderBy("pos").collect()
    assert [r.sentence for r in sentences][1] == "Then NA#7 left!"


def test_text_table_and_years(spark):
    df = spark.createDataFrame(
        [("1", "e", "t", "F1", "J", "2019-05-01")],
        "facility_id string, eventid string, inspection_text string, deficiency_tag string, scope_severity string, d string",
    )
    assert reports.text_table(df).columns[2] == "inspection_text"
    assert [tuple(r) for r in reports.reports_by_year(df.withColumn("d", F.to_date("d")), "d").collect()] == [(2019, 1)]
