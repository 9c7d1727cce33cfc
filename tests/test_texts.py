"""Dates without a stated format and sentence ends without labels."""

import datetime

import pytest

from citegrain.operators import boundaries, dates


def test_dates_of_unknown_format(spark):
    rows = [("2020-03-09", "03/09/2020", "9/3/2020", " 20200309", "x"), ("2020-12-31", "12/31/2020", "31/12/2020", "December 31, 2020", None)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string")
    got = dates.recognise_dates(df, ["a", "b", "c", "d", "e"]).collect()
    first, last = datetime.date(2020, 3, 9), datetime.date(2020, 12, 31)
    assert sorted(map(tuple, got)) == [(first,) * 4 + (None,), (last,) * 4 + (None,)]
    assert dates.date_formats(df, ["b", "c", "e"]) == {"b": ["M/d/yyyy"], "c": ["d/M/yyyy"], "e": []}


@pytest.mark.parametrize("days", [["03/09/2020", "01/02/2021"], ["13/09/2020", "09/13/2020", "01/02/2021"]])
def test_days_and_months_that_cannot_be_told_apart(spark, days):
    df = spark.createDataFrame([(d,) for d in days], "day string")
    with pytest.raises(ValueError, match="column day"):
        dates.recognise_dates(df, ["day"])


def test_equal_days_are_not_ambiguous(spark):
    df = spark.createDataFrame([("02/02/2020",), ("05/05/2021",)], "day string")
    assert [r.day for r in dates.recognise_dates(df, ["day"]).orderBy("day").collect()] == [
        datetime.date(2020, 2, 2), datetime.date(2021, 5, 5)
    ]
    assert dates.recognise_dates(df.limit(0), ["day"]).count() == 0


def test_sentence_ends_learned_from_the_corpus(spark):
    plain = "The nurse saw the resident. The room was cold. She left. Staff were told. It was late. The nurse came. "
    corpus = [(i, plain + f"Then Dr. Lee gave {i}.5 mg. of it. Dr. Roe spoke of the staff. Dr. Lee saw him") for i in range(60)]
    labelled = [
        "Dr. Lee saw the resident. She gave 3.5 mg. at noon.",
        "What was given? 3.5 mg. The nurse left!",
        "J. Smith told Dr. Roe. Staff came.",
        "He (Dr. Lee) left... then came.  \n It was late",
    ]
    expected = [
        ["Dr. Lee saw the resident.", "She gave 3.5 mg. at noon."],
        ["What was given?", "3.5 mg.", "The nurse left!"],
        ["J. Smith told Dr. Roe.", "Staff came."],
        ["He (Dr. Lee) left...", "then came.", "It was late"],
    ]
    docs = spark.createDataFrame(corpus + [(1000 + i, t) for i, t in enumerate(labelled)] + [(2000, None), (2001, " "), (2002, "end.")], "doc long, t string")
    rows = boundaries.sentence_rows(docs, "doc", "t").where("doc >= 1000").orderBy("doc", "pos").collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc, []).append(r.sentence)
    assert [got[1000 + i] for i in range(4)] == expected
    assert got[2002] == ["end."] and 2000 not in got and 2001 not in got


def test_statistics_of_nothing(spark):
    none = spark.createDataFrame([], "doc long, t string")
    assert boundaries.stop_statistics(none, "t").count() == 0
    assert boundaries.sentence_rows(none, "doc", "t").count() == 0
