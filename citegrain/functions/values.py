"""Casts, dates, flags and labels."""

from __future__ import annotations

import re
from functools import reduce
from itertools import groupby
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from citegrain.constants import NORMAL_975, SEVERE_LETTERS


def parse_date(text: Column, *formats: str) -> Column:
    """First format that fits; unreadable text gives null instead of an ANSI error.

    Text without a format's outline is not parsed: a failed parse costs many times a match.
    """
    formats = formats or ("MM/dd/yyyy",)
    days = []
    for f in formats:
        day, outline = F.try_to_timestamp(text, F.lit(f)).cast("date"), format_outline(f)
        days.append(F.when(text.rlike(outline), day) if outline else day)
    return F.coalesce(*days)


# Text of the date fields whose values end early.
FIELD_TEXT = {"M": "[+-]?0*(?:[1-9]|1[0-2])", "d": "[+-]?0*(?:[1-9]|[12][0-9]|3[01])"}


def format_outline(format_: str) -> str | None:
    """A pattern that every text of a date format meets; None for formats with more than plain fields and marks."""
    if not re.fullmatch(r"[yMdHms/:,. -]+", format_):
        return None
    runs = ["".join(run) for _, run in groupby(format_)]
    fields = [
        re.escape(r) if not r.isalpha() else "(?s:.+)" if r.startswith("MMM") else FIELD_TEXT.get(r[0], "[+-]?[0-9]+")
        for r in runs
    ]
    return f"^{''.join(fields)}$"


def strict_number(text: Column) -> Column:
    """Numeric cast that fails the query on bad text."""
    return F.trim(text).cast("double")


def lenient_number(text: Column) -> Column:
    """Numeric cast that turns bad text into null."""
    return F.trim(text).try_cast("double")


def null_if_nan(value: Column) -> Column:
    """One missing marker: NaN becomes null."""
    return F.when(~F.isnan(value), value)


def yes_no(text: Column) -> Column:
    """`Y` and `N` to boolean, anything else to null."""
    letter = F.upper(F.trim(text))
    return F.when(letter == "Y", True).when(letter == "N", False)


def presence(value: Column) -> Column:
    """1 where a value is there, 0 where it is null."""
    return F.when(value.isNull(), 0).otherwise(1)


def row_sum(columns: list[Column]) -> Column:
    """Sum across columns of one row."""
    return reduce(add, columns)


def is_severe(letter: Column, severe=SEVERE_LETTERS) -> Column:
    """Whether a scope-severity letter counts as severe."""
    return letter.isin(*severe)


def substring_label(text: Column, part: str, label: str, otherwise: str) -> Column:
    """`label` where the text holds `part`, else `otherwise` (null text included)."""
    return F.when(F.contains(text, F.lit(part)), label).otherwise(otherwise)


def hot_cold(z: Column, cut: float = NORMAL_975) -> Column:
    """Hot spot red, cold spot blue, the rest grey; a null score has no class."""
    return (
        F.when(z.isNull(), None)
        .when(z < -cut, "blue")
        .when(z > cut, "red")
        .otherwise("grey")
    )


def file_year(name: Column) -> Column:
    """First run of 2-4 digits in a file name; null where there is none."""
    return F.regexp_extract(name, r"([0-9]{2,4})", 1).try_cast("int")


def plus_joined(text: Column, separator: str = "+") -> Column:
    """Words joined by one separator."""
    return F.regexp_replace(F.trim(text), r"\s+", separator)


def address_line(*parts: Column) -> Column:
    """Comma-separated address key, whitespace normalised, missing parts left out."""
    return F.concat_ws(", ", *[plus_joined(p.cast("string"), " ") for p in parts])


GEOCODE_SCHEMA = (
    "struct<result: struct<addressMatches: array<struct<coordinates: struct<x: double, y: double>>>>>"
)


def first_match(body: Column) -> Column:
    """Coordinates of the first match in a stored geocoder reply; empty or corrupt gives null."""
    matches = F.from_json(body, GEOCODE_SCHEMA)["result"]["addressMatches"]
    return F.try_element_at(matches, F.lit(1))["coordinates"]
