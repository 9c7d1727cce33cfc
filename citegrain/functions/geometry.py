"""Points, distances and polygons as plain columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citegrain.constants import FLORIDA_BOX

EARTH_RADIUS_M = 6371008.8


def planar(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Straight-line distance in the units of the coordinates."""
    dx, dy = x2 - x1, y2 - y1
    return F.sqrt(dx * dx + dy * dy)


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres on the mean-radius sphere."""
    s_lat = F.sin(F.radians(lat2 - lat1) / 2)
    s_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = s_lat * s_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * s_lon * s_lon
    return F.asin(F.sqrt(F.least(a, F.lit(1.0)))) * (2 * EARTH_RADIUS_M)


def unit_vector(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    """Position on the unit sphere; chord order equals great-circle order."""
    lam, phi = F.radians(lon), F.radians(lat)
    return F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)


def valid_position(lon: Column, lat: Column) -> Column:
    return lon.between(-180, 180) & lat.between(-90, 90)


def in_box(lon: Column, lat: Column, box=FLORIDA_BOX) -> Column:
    """Whether a position lies in a map window, edges included."""
    return lon.between(*box["lon"]) & lat.between(*box["lat"])


def wkt_point(wkt: Column) -> Column:
    """`POINT (x y)` to a struct; other text to null."""
    number = r"(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
    pattern = rf"(?i)^\s*POINT\s*\(\s*{number}\s+{number}\s*\)\s*$"
    x = F.regexp_extract(wkt, pattern, 1).try_cast("double")
    y = F.regexp_extract(wkt, pattern, 2).try_cast("double")
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))


def wkt_rings(wkt: Column) -> Column:
    """Rings of a POLYGON or MULTIPOLYGON: array<array<struct<x, y>>>."""

    def vertex(text: Column) -> Column:
        parts = F.split(F.trim(text), r"\s+")
        return F.struct(
            F.get(parts, F.lit(0)).cast("double").alias("x"),
            F.get(parts, F.lit(1)).cast("double").alias("y"),
        )

    rings = F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), F.lit(1))
    return F.transform(rings, lambda ring: F.transform(F.split(ring, ","), vertex))


def ring_edges(rings: Column) -> Column:
    """Consecutive vertex pairs of every ring, the last with the first: array<struct<a, b>>."""

    def edges(ring: Column) -> Column:
        following = F.concat(F.slice(ring, F.lit(2), F.size(ring) - 1), F.slice(ring, F.lit(1), F.lit(1)))
        return F.arrays_zip(ring.alias("a"), following.alias("b"))

    return F.flatten(F.transform(rings, edges))
