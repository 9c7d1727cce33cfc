"""Column expressions on inline rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from citegrain import constants as c
from citegrain.functions import text as t
from citegrain.functions import values as v
from citegrain.operators import reports


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.select(expression(F.col("x")).alias("y"), "i").orderBy("i").collect()]


def test_dates(spark):
    given = ["03/09/2020", "2020-03-09", "x/1", None, "13/40/2020"]
    day = datetime.date(2020, 3, 9)
    assert column(spark, given, "string", v.parse_date) == [day, None, None, None, None]
    both = column(spark, given, "string", lambda x: v.parse_date(x, "MM/dd/yyyy", "yyyy-MM-dd"))
    assert both == [day, day, None, None, None]


def test_numbers(spark):
    assert column(spark, ["1.5", " 7 ", "n/a", None], "string", v.lenient_number) == [1.5, 7.0, None, None]
    assert column(spark, ["1.5", None], "string", v.strict_number) == [1.5, None]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        column(spark, ["n/a"], "string", v.strict_number)


def test_flags(spark):
    assert column(spark, ["Y", "N", "", None, "y "], "string", v.yes_no) == [True, False, None, None, True]
    assert column(spark, [1.0, float("nan"), None], "double", v.null_if_nan) == [1.0, None, None]
    assert column(spark, [3, None], "int", v.presence) == [1, 0]


def test_labels(spark):
    race = column(spark, ["B01001A_014", "B01001B_014", None], "string",
                  lambda x: v.substring_label(x, "A", "white", "non-white"))
    assert race == ["white", "non-white", "non-white"]
    assert column(spark, [-2.0, 0.0, 2.0, None], "double", v.hot_cold) == ["blue", "grey", "red", None]
    assert column(spark, ["J", "A", None], "string", v.is_severe) == [True, False, None]


def test_file_years(spark):
    names = ["NH_ProviderInfo_Nov2021.csv", "x19.csv", "none.csv"]
    assert column(spark, names, "string", v.file_year) == [2021, 19, None]


def test_addresses(spark):
    assert column(spark, [" 1  Main St "], "string", v.plus_joined) == ["1+Main+St"]
    df = spark.createDataFrame([("1  Main", "Troy", None, "00123")], "a string, c string, s string, z string")
    line = df.select(v.address_line(*[F.col(x) for x in "acsz"])).first()[0]
    assert line == "1 Main, Troy, 00123"


def test_geocoder_replies(spark):
    good = '{"result":{"addressMatches":[{"coordinates":{"x":-86.5,"y":32.1}},{"coordinates":{"x":0,"y":0}}]}}'
    replies = [good, '{"result":{"addressMatches":[]}}', "<html>", "", None]
    got = column(spark, replies, "string", v.first_match)
    assert [tuple(p) if p else None for p in got] == [(-86.5, 32.1), None, None, None, None]


def test_report_text(spark):
    raw = ["R #227 spoke to LPN # 3<br/>at x# noon", "nobody", None, " NA#7 and r#2, r#2"]
    assert column(spark, raw, "string", t.normalise) == [
        "r#227 spoke to lpn#3at x#noon", "nobody", None, " na#7 and r#2, r#2"
    ]
    assert column(spark, raw, "string", lambda x: t.actors(t.normalise(x))) == [
        ["lpn#3", "x#"], [], None, ["na#7", "r#2"]
    ]


def test_tokens(spark):
    text = "R#227 told LPN#3: déjà vu!"
    assert column(spark, [text], "string", t.tokens)[0] == [
        "R", "#", "227", "told", "LPN", "#", "3", ":", "déjà", "vu", "!"
    ]
    assert column(spark, [text], "string", lambda x: t.tokens(x, t.PERSON_PATTERN))[0] == ["R#227", "LPN#3"]
    assert column(spark, ["One. Two!  Three?? "], "string", t.sentences)[0] == ["One.", "Two!", "Three??"]
    docs = spark.createDataFrame([(1, "R#1 told LPN#3 and RN#2. RN#2 left.")], "id int, text string")
    pairs = {(r.a, r.b): r.n for r in reports.co_mentions(docs, "id", "text").collect()}
    assert pairs == {("lpn#3", "r#1"): 1, ("lpn#3", "rn#2"): 1, ("r#1", "rn#2"): 1}


def test_fixed_values():
    assert len(c.SENIOR_VARIABLES) == 42 and c.SENIOR_VARIABLES[5] == "B01001A_031"
    assert len(c.PROVIDER_LONG_NAMES) == 30
    assert len(c.RATING_DROPS) == 14
