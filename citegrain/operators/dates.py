"""Dates in text columns whose format nobody states."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrain.functions.values import parse_date

# Formats that are tried, most specific first.
FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "M/d/yyyy", "d/M/yyyy", "yyyyMMdd", "MMMM d, yyyy")


def date_formats(df: DataFrame, columns: Sequence[str], formats: Sequence[str] = FORMATS) -> dict[str, list[str]]:
    """The formats in use in each text column, by one aggregate over the rows.

    Formats that read some rows are in use, also several of them in one column.  Where two read the same row as
    different days, the one that alone reads other rows of the column is meant; a column in which neither or both
    do so is ambiguous and raises ValueError.  A column that no format reads has none.
    """
    read, counts = [], []
    for n, c in enumerate(columns):
        days = {f: F.col(f"_{n}_{i}") for i, f in enumerate(formats)}
        read += [parse_date(F.trim(F.col(f"`{c}`")), f).alias(f"_{n}_{i}") for i, f in enumerate(formats)]
        counts += [F.count(day).alias(f"{c}|{f}") for f, day in days.items()]
        for f, g in combinations(formats, 2):
            counts.append(F.count(F.when(days[f] != days[g], 1)).alias(f"{c}|{f}|{g}"))
            for one, other in ((f, g), (g, f)):
                alone = days[one].isNotNull() & days[other].isNull()
                counts.append(F.count(F.when(alone, 1)).alias(f"{c}|{one}|not|{other}"))
    # each text is read once by each format, and the counts look at the days
    seen = df.select(*read).agg(*counts).first().asDict() if counts else {}
    found = {}
    for c in columns:
        used = [f for f in formats if seen[f"{c}|{f}"]]
        for f, g in combinations(list(used), 2):
            if seen[f"{c}|{f}|{g}"]:
                sure = [one for one, other in ((f, g), (g, f)) if seen[f"{c}|{one}|not|{other}"]]
                if len(sure) != 1:
                    raise ValueError(f"column {c}: {seen[f'{c}|{f}|{g}']} rows are other days by {f} than by {g}")
                used = [u for u in used if u in sure or u not in (f, g)]
        found[c] = used
    return found


def recognise_dates(df: DataFrame, columns: Sequence[str], formats: Sequence[str] = FORMATS) -> DataFrame:
    """Text columns as dates, each by the formats found in it; what they do not read becomes null."""
    found = date_formats(df, columns, formats)
    days = {c: parse_date(F.trim(F.col(f"`{c}`")), *f) if f else F.lit(None).cast("date") for c, f in found.items()}
    return df.withColumns(days)
