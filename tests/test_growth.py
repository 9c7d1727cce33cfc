"""Steps whose work must not grow faster than their input."""

import re
from datetime import datetime

from pyspark.sql import functions as F

from citegrain.functions.values import format_outline, parse_date
from citegrain.operators import dates, polygons, spatial
from citegrain.sources import headed
from workload import studies, views


def square(x: int) -> str:
    return f"POLYGON (({x} 0, {x + 1} 0, {x + 1} 1, {x} 1, {x} 0))"


def test_polygons_of_equal_text_share_one_search(spark, monkeypatch):
    kept = []
    cut = polygons.durable
    monkeypatch.setattr(polygons, "durable", lambda df: kept.append(cut(df)) or kept[-1])
    monkeypatch.setattr(polygons, "PIECE", 7)
    rows = [(f"g{i:03}", square(i % 2), i) for i in range(300)] + [("away", square(50), -1), ("none", None, -2), (None, square(0), -3)]
    areas = spark.createDataFrame(rows, "geoid string, wkt string, n int")
    points = spark.createDataFrame([(i, (i + 0.5) / 20, 0.5) for i in range(40)], "id int, lon double, lat double")
    found = polygons.points_in_polygons(areas, points, "geoid", "wkt", "lon", "lat")
    assert found.columns == ["geoid", "wkt", "n", "id", "lon", "lat"]
    got = {(r.geoid, r.n, r.id) for r in found.collect()}
    inside = {(f"g{i:03}", i, p) for i in range(300) for p in range(40) if p // 20 == i % 2}
    assert got == inside | {("away", -1, None), ("none", -2, None), (None, -3, None)} and found.count() == len(got)
    assert [df.count() for df in kept] == [2, 40]  # shapes, and points in them, not points in polygons
    within = polygons.points_in_polygons(areas, points, "geoid", "wkt", "lon", "lat", keep_empty=False)
    assert {(r.geoid, r.n, r.id) for r in within.collect()} == inside and within.count() == len(inside)


def test_pairs_of_a_band_are_not_shuffled(spark):
    points = [(i, (i % 12) / 2, (i // 12 % 10) / 2) for i in range(240)]  # two rows at each place
    df = spark.createDataFrame(points, "id int, lon double, lat double")
    found = spatial.band_neighbours(df, "id", ["lon", "lat"], 1.0)
    counted = spatial.band_counts(df, "id", ["lon", "lat"], 1.0)
    near = {(i, j) for i, x, y in points for j, v, w in points if i != j and (x - v) ** 2 + (y - w) ** 2 <= 1}
    assert sorted((r["id"], r["nbr"]) for r in found.collect()) == sorted(near)
    assert {r["id"]: r["others"] for r in counted.collect()} == {i: sum(i == p for p, _ in near) for i, *_ in points}
    above = found._jdf.queryExecution().sparkPlan().toString().split("Generate")[0]
    assert "Join" not in above and "Exchange" not in above


def test_lines_meet_inspections_over_all_partitions(spark, tmp_path):
    tables = {
        "nation": [(0, "N", 0)], "customer": [(i, "c", 0, 0.0, "s") for i in range(3)],
        "part": [(i, "p", f"Brand#{i}", "PROMO", 1, 1.0) for i in range(4)],
        "orders": [(i, i % 3, "O", 1.0, datetime(1996, 1, 1 + i), "1") for i in range(20)],
        "lineitem": [(i % 20, i % 4, 0, i, 1.0, 1.0, 0.0, 0.0, "N", "O", datetime(1996, 2, 1)) for i in range(60)],
    }
    for name, rows in tables.items():
        spark.createDataFrame(rows, views.SCHEMAS[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    cited = views.citations(spark, str(tmp_path))
    assert cited.columns == ["eventid", "facility_id", "insp_year", "state", "deficiency_tag", "scope_severity"]
    assert cited.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted((r.eventid, r.deficiency_tag) for r in cited.collect()) == sorted((i % 20, f"Brand#{i % 4}") for i in range(60))
    ingested = studies.ingest_citations(spark, str(tmp_path))
    assert ingested._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 2


def test_extracts_are_read_as_wide_as_their_headers(spark, tmp_path, monkeypatch):
    texts = ["a,\"b,\"\"x\",é\n1,2\n3,4,5,6\n", "é,a\n7,8\né,a\n"]
    kept = []
    cut = headed.stored
    monkeypatch.setattr(headed, "stored", lambda df: kept.append(len(df.columns)) or cut(df))
    want = {("1", "2", None), ("3", "4", "5"), ("8", None, "7"), ("a", None, "é")}
    for multi_line, blank in ((False, "\n \n"), (True, "")):
        folder = tmp_path / str(multi_line)
        folder.mkdir()
        for i, text in enumerate([*texts, ""]):
            (folder / f"f{i}.csv").write_bytes(f"{blank}{text}".encode("ISO-8859-1"))
        found = headed.read_headed(spark, str(folder), encoding="ISO-8859-1", multi_line=multi_line)
        assert found.columns == ["a", 'b,"x', "é"] and {tuple(r) for r in found.collect()} == want
    assert max(kept) <= 3  # the columns that headers name, not as many as a record may have


def test_text_without_the_outline_of_a_format_is_not_parsed(spark):
    formats = dates.FORMATS
    texts = ["1997-03-05", "1997-03-05 10:11:12", "3/5/1997", "13/5/1997", "3/31/1997", "0003/05/1997", "19970305", "19971305",
             "March 5, 1997", "march 5, 1997", "March 35, 1997", "unknown", "", "+1997-03-05", "12345-03-05", "1997-02-30", "3/5/97",
             "1997-03-05\n", "1997-03-05x", "-1997-03-05", "March  5, 1997", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = [F.try_to_timestamp("t", F.lit(f)).cast("date").cast("string") for f in formats]
    rows = df.select("t", F.array(*plain).alias("plain"), F.array(*[parse_date(F.col("t"), f).cast("string") for f in formats]).alias("days")).collect()
    assert all(r.plain == r.days for r in rows) and sum(d is not None for r in rows for d in r.days) >= 9
    outlines = {f: re.compile(format_outline(f)) for f in formats}
    assert [f for f in formats if outlines[f].search("13/5/1997")] == ["d/M/yyyy"]
    assert not any(o.search("unknown") for o in outlines.values())
    assert format_outline("yyyy[-MM]") is None and format_outline("yyyy'x'") is None
