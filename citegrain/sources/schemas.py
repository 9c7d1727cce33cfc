"""Declared schemas.  Raw files are read as text; types come from one cast projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import types as T

ESTIMATES = T.StructType([
    T.StructField("GEOID", T.StringType()),
    T.StructField("variable", T.StringType()),
    T.StructField("estimate", T.DoubleType()),
])
TRACTS = T.StructType([
    T.StructField("geoid", T.StringType()),
    T.StructField("statefp", T.StringType()),
    T.StructField("wkt", T.StringType()),
])


def all_text(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])
