"""Files in and out, and the jobs around them."""

import datetime

import pytest
from pyspark.sql import types as T

from citegrain import constants as c
from citegrain.plans import jobs
from citegrain.sources import files, headed, schemas


def test_parquet_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("045267", 2019), ("1", 2020)], "facility_id string, insp_year int")
    path = str(tmp_path / "t")
    files.write_table(df, path, by=["insp_year"])
    assert sorted(map(tuple, files.read_table(spark, path).select("facility_id", "insp_year").collect())) == [
        ("045267", 2019), ("1", 2020)
    ]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        files.write_table(df, path)
    files.write_table(df.limit(1), path, overwrite=True)
    assert files.read_table(spark, path).count() == 1


def test_csv_without_header(spark, tmp_path):
    df = spark.createDataFrame([("01", "x"), ("02", None)], "a string, b string")
    path = str(tmp_path / "c")
    files.write_csv(df, path)
    files.write_csv(df, path)
    got = files.read_text_columns(spark, path, ["facility_id", "name"], header=False)
    assert sorted(map(tuple, got.collect()), key=str) == [("01", "x"), ("02", None)]
    assert files.read_text_columns(spark, path, header=False).columns == ["_c0", "_c1"]


def test_latin_1_and_leading_zeros(spark, tmp_path):
    (tmp_path / "p.csv").write_bytes("id,name\n007,Señor\n".encode("latin-1"))
    got = files.read_text_columns(spark, str(tmp_path / "p.csv"), encoding=files.LATIN_1)
    assert [tuple(r) for r in got.collect()] == [("007", "Señor")]


def test_extracts_by_name(spark, tmp_path):
    (tmp_path / "text_a.csv").write_text(",facility_id,x\n0,01,a\n1,02,\"two\nlines\"\n")
    (tmp_path / "text_b.csv").write_text(",facility_id,y\n0,03,b\n")
    (tmp_path / "other.csv").write_text(",facility_id,x\n0,99,z\n")
    got = headed.read_extracts(spark, str(tmp_path), multi_line=True)
    assert got.columns == ["facility_id", "x", "y"]
    assert sorted(map(tuple, got.collect()), key=str) == [
        ("01", "a", None), ("02", "two\nlines", None), ("03", None, "b")
    ]
    with pytest.raises(FileNotFoundError):
        headed.read_extracts(spark, str(tmp_path), part="absent")


def test_typed_source_and_local_rows(spark, tmp_path):
    (tmp_path / "acs.csv").write_text("GEOID,variable,estimate\n01001,B01001A_014,12.5\n01001,B01001B_014,NA\n")
    got = files.read_typed(spark, str(tmp_path / "acs.csv"), schemas.ESTIMATES)
    assert [tuple(r) for r in got.orderBy("variable").collect()] == [
        ("01001", "B01001A_014", 12.5), ("01001", "B01001B_014", None)
    ]
    rows = files.local_rows(spark, [("a", float("nan")), (None, 1.0)], T.StructType(
        [T.StructField("k", T.StringType()), T.StructField("v", T.DoubleType())]
    ))
    assert [tuple(r) for r in rows.collect()] == [("a", None), (None, 1.0)]


def test_ingest(spark, tmp_path):
    source = tmp_path / "raw.csv"
    source.write_text(
        "facility_id,inspection_date,deficiency_tag,scope_severity,inspection_text,IDR,IIDR,complaint,standard\n"
        "01,03/09/2020,880,J,\"a\nb\",,,Y,N\n"
        "01,03/09/2020,880,J,\"a\nb\",,,Y,N\n"
        "02,not a date,880,J,,,,,\n03,,1,B,,,,,\n04,01/01/2013,1,B,,,,,\n"
    )
    target = str(tmp_path / "out")
    jobs.ingest(spark, str(source), target, multi_line=True)
    got = files.read_table(spark, target)
    assert {"IDR", "complaint", "inspection_text"}.isdisjoint(got.columns)
    assert [(r.facility_id, r.inspect_date, r.insp_year) for r in got.collect()] == [
        ("01", datetime.date(2020, 3, 9), 2020)
    ]


def test_provider_eras(spark, tmp_path):
    short, long = list(c.PROVIDER_LONG_NAMES), list(c.PROVIDER_LONG_NAMES.values())
    ccn = [next(iter(c.PROVIDER_2023_NAMES)) if n == "Federal Provider Number" else n for n in long]
    paths = []
    for name, header, date in (
        ("ProviderInfo_Nov2019.csv", short, "2019-11-01"),
        ("NH_ProviderInfo_Nov2021.csv", long, "2021-11-01"),
        ("NH_ProviderInfo_Nov2023.csv", ccn, "2023-11-01"),
    ):
        values = {"PROVNUM": "015009", "FILEDATE": date, "OWNERSHIP": "Señor", "BEDCERT": "57", "RESTOT": "bad"}
        line = ",".join(values.get(s, "1") for s in short)
        (tmp_path / name).write_bytes(f"{','.join(header)},extra\n{line},0\n".encode("latin-1"))
        paths.append(str(tmp_path / name))
    got = jobs.provider_table(spark, paths)
    rows = got.orderBy("insp_year").collect()
    assert [r.insp_year for r in rows] == [2019, 2021, 2023]
    assert all((r.facility_id, r.ownership, r.bedcert, r.restot) == ("015009", "Señor", 57.0, None) for r in rows)
    assert "extra" not in got.columns
    cited = spark.createDataFrame(
        [("AL", y, "015009", "e", "F1", "J") for y in (2018, 2019)],
        "state string, insp_year int, facility_id string, eventid string, deficiency_tag string, scope_severity string",
    )
    merged = {r.insp_year: r.bedcert for r in jobs.facility_table(cited, got).collect()}
    assert merged == {2018: None, 2019: 57.0}


def test_typed_extract(spark):
    raw = spark.createDataFrame(
        [("045267", "00123", "2019-05-01", "N", "12", "5", "x", "1")],
        ["Facility_ID", "zip", "filedate", "ccrc_facil", "bedcert", "overall_rating", "Footnote 1", "deficiency_tag"],
    )
    row = jobs.typed_extract(raw).first()
    assert row.asDict() == {
        "facility_id": "045267", "zip": "00123", "filedate": datetime.date(2019, 5, 1), "ccrc_facil": False,
        "bedcert": 12.0, "deficiency_tag": 1.0,
    }


def test_extract_drops_text_and_casts_late_columns_leniently(spark):
    names = [f"n{i:02d}" for i in range(45)]
    raw = spark.createDataFrame([["bad"] * 45 + ["1 Main St", "Home", "555", "long text"]], [*names, "address", "facility_name", "phone", "inspection_text"])
    row = jobs.typed_extract(raw).first().asDict()
    assert list(row) == names
    assert [n for n in names if row[n] is None] == names[32:41] and row["n31"] == row["n41"] == "bad"


def test_a_saved_index_does_not_keep_copies_apart(spark, tmp_path):
    rows = [",facility_id,inspection_date,deficiency_tag,inspection_text", '0,"01",05/01/2019,880,same text', '1,"01",05/01/2019,880,same text',
            '2,"01",05/01/2019,880,other text']
    (tmp_path / "in.csv").write_text("\n".join(rows))
    jobs.ingest(spark, str(tmp_path / "in.csv"), str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert "_c0" not in got.columns and got.count() == 2


def test_tract_table_is_read_with_its_schema(spark, tmp_path):
    from citegrain.sources import schemas

    (tmp_path / "tracts.csv").write_text('geoid,statefp,wkt\n01001,01,"POLYGON ((0 0, 1 0, 1 1, 0 0))"\n')
    read = files.read_typed(spark, str(tmp_path / "tracts.csv"), schemas.TRACTS)
    assert read.schema == schemas.TRACTS and read.first().geoid == "01001"


def test_tract_table_is_written(spark, tmp_path):
    jobs.write_tracts(spark.createDataFrame([("01001", 5.0)], "geoid string, health double"), str(tmp_path / "t"))
    assert files.read_text_columns(spark, str(tmp_path / "t")).first().asDict() == {"geoid": "01001", "health": "5.0"}


def test_senior_population(spark):
    df = spark.createDataFrame(
        [("01001", "B01001A_014", 5.0), ("01001", "B01001G_031", 2.0), ("01001", "B01001A_003", 9.0),
         ("02001", "B01001A_014", 7.0)],
        "GEOID string, variable string, estimate double",
    )
    got = {(r.GEOID, r.race): r.poptot for r in jobs.senior_population(df).collect()}
    assert got == {("01001", "white"): 5.0, ("01001", "non-white"): 2.0}


def test_hot_spots_and_regression_jobs(spark):
    import random

    rng = random.Random(1)
    rows = []
    for i in range(120):
        corner = i < 30
        lat, lon = (30.0, -85.0) if i in (40, 41) else (30 + rng.random() * (1 if corner else 9), -85 - rng.random() * 9)
        tags = 30 + rng.random() if corner and lon > -88 else rng.random() * 5
        rows.append((f"{i:05d}", 2022, rng.choice(["AL", "TX"]), lat, lon, tags, rng.random(), "Y" if i % 2 else "N",
                     rng.choice(["a", "b"]), *[rng.random() for _ in c.REGRESSION_NUMERIC if _ != "severe_tags_applied"]))
    names = ["facility_id", "insp_year", "state", "lat", "lon", "no_of_tags_peryear", "severe_tags_applied",
             "resfamcouncil", "ownership", *[n for n in c.REGRESSION_NUMERIC if n != "severe_tags_applied"]]
    table = spark.createDataFrame(rows, names)
    spots = jobs.hot_spots(table, 2022, k=5).collect()
    assert len(spots) == 120 and {"red"} <= {r.spot_no_of_tags_peryear for r in spots}
    assert len({(r.lat, r.lon) for r in spots}) == 120
    model = jobs.tag_regression(table)
    assert model.coefficients().count() == 1 + len(c.REGRESSION_NUMERIC) + 2 + 1


def test_headers_of_many_files(spark, tmp_path):
    """Two hundred files of three layouts; headers come from the files, and the files are read by one job."""
    layouts = [["id", "name", "n"], ["", "n", "id"], ["id", "", "name", "name"]]
    expected = []
    for i in range(200):
        layout = layouts[i % 3]
        rows = [{"id": f"{i:03d}", "name": f"a,{j}", "n": str(j)} for j in range(i % 4)]
        lines = [",".join(layout)] + [",".join(f'"{r.get(c, "x")}"' for c in layout) for r in rows]
        if rows and i % 3 == 0:
            lines.append(lines[0])  # a row like the header, further down
            rows.append({"id": "id", "name": "name", "n": "n"})
        (tmp_path / f"text_{i:03d}.csv").write_text("\n".join(lines) + "\n")
        expected += [
            (r["id"], r["name"] if "name" in layout else None, r["n"] if "n" in layout else None,
             "x" if i % 3 == 2 else None, r["name"] if i % 3 == 2 else None)
            for r in rows
        ]
    tracker, group = spark.sparkContext.statusTracker(), "headed"
    spark.sparkContext.setJobGroup(group, group)
    got = headed.read_headed(spark, str(tmp_path), saved_index=True)
    spark.sparkContext.setJobGroup("rest", "rest")
    assert got.columns == ["id", "name", "n", "_c1", "name3"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)
    assert len(tracker.getJobIdsForGroup(group)) < 20  # far fewer than files
    assert "csv" not in got._jdf.queryExecution().optimizedPlan().toString().lower()


def test_headers_of_odd_files(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "alone.csv").write_text("a,b\n")
    got = headed.read_headed(spark, str(tmp_path))
    assert got.columns == ["a", "b"] and got.count() == 0
    (tmp_path / "wide.csv").write_text(",".join("abcde") + "\n1,2,3,4,5\n")
    with pytest.raises(ValueError, match="more than 4 fields"):
        headed.read_headed(spark, str(tmp_path), most_columns=4)
