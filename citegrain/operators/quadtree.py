"""An adaptive quadtree (an octree in space) over located rows, as tables.

Cells with more rows than a leaf may hold are split, top down, some levels at a time: only rows of cells that
are still crowded are counted again.  Each row is listed once, in its leaf.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrain.operators.durable import durable

# Cells of the finest level are 2 ** -48 of the span wide, so that a far outlier leaves the others apart.
MAX_LEVEL = 48
# Levels that are split at once where cells are still crowded after the first look.
STEP = 6


def finite(df: DataFrame, id_col: str, coords: Sequence[str]) -> DataFrame:
    """Rows with an id and finite coordinates."""
    bounded = df.dropna(subset=[id_col, *coords])
    for c in coords:
        bounded = bounded.where(F.abs(F.col(c)) < float("inf"))
    return bounded


class Grid:
    """Scaled coordinates and cell numbers of a point set; `rows` is its number of points."""

    def __init__(self, points: DataFrame, coords: Sequence[str]):
        self.coords = list(coords)
        self.units = [f"_u{i}" for i in range(len(self.coords))]
        self.cells = [f"_c{i}" for i in range(len(self.coords))]
        self.keys = ["_level", *self.cells]
        ends = [f"double({end}(`{c}`))" for end in ("min", "max") for c in self.coords]
        *ends, self.rows = points.selectExpr(*ends, "count(*)").first()
        ends = [v if v is not None else 0.0 for v in ends]
        self.low, self.high = ends[: len(self.coords)], ends[len(self.coords) :]
        self.span = max(h - v for v, h in zip(self.low, self.high)) or 1.0

    def scaled(self, value: str, axis: int) -> str:
        return f"(({value} - {self.low[axis]!r}D) / {self.span!r}D)"

    def place(self, df: DataFrame) -> DataFrame:
        """Add scaled coordinates in [0, 1]."""
        units = [f"{self.scaled(f'`{c}`', i)} AS {u}" for i, (c, u) in enumerate(zip(self.coords, self.units))]
        return df.selectExpr("*", *units)

    @staticmethod
    def cell(unit: str, level: str = "_level") -> str:
        """Cell number of a scaled coordinate; coarser cells are exact unions of finer ones."""
        finest = f"bigint(least(floor(least(greatest({unit}, 0D), 1D) * {1 << MAX_LEVEL}), {(1 << MAX_LEVEL) - 1}))"
        return f"shiftright({finest}, {MAX_LEVEL} - {level})"

    def at_levels(self, df: DataFrame, levels: str) -> DataFrame:
        """One row per point and level, with the cell it lies in."""
        spread = df.selectExpr("*", f"explode({levels}) AS _level")
        return spread.selectExpr("*", *[f"{self.cell(u)} AS {c}" for u, c in zip(self.units, self.cells)])

    def cover(self, df: DataFrame, spans: Sequence[tuple[str, str]]) -> DataFrame:
        """One row per cell of `_level` between the given ends, one pair of scaled ends per axis."""
        for c, (first, last) in zip(self.cells, spans):
            df = df.selectExpr("*", f"explode(sequence({self.cell(first)}, {self.cell(last)})) AS {c}")
        return df

    def around(self, reach: str) -> list[tuple[str, str]]:
        return [(f"({u} - {reach})", f"({u} + {reach})") for u in self.units]

    def gap2(self) -> str:
        """Squared distance between a point's and its counterpart's coordinates."""
        return " + ".join(f"(`nbr_{c}` - `{c}`) * (`nbr_{c}` - `{c}`)" for c in self.coords)


def level_for(reach: str) -> str:
    """Finest level whose cells are at least `reach` wide, so that a box meets few of them."""
    return f"int(least(greatest(floor(-log2(greatest({reach}, {2.0**-MAX_LEVEL!r}D))), 0), {MAX_LEVEL}))"


def in_leaves(rows: DataFrame, grid: Grid, capacity: int) -> tuple[DataFrame, int]:
    """The rows (with scaled coordinates), each with the level and cell of its leaf, and a bound of the levels.

    A leaf holds at most `capacity` rows, its parent more; cells of the finest level may hold any number.
    """
    parts, waiting, low = [], rows, 0
    axes = min(len(grid.coords), 2)
    high = min(MAX_LEVEL, math.ceil(max(math.log2(max(grid.rows, 1) / capacity), 0) / axes) + 2)
    while True:
        fine = waiting.selectExpr("*", *[f"{grid.cell(u, str(high))} AS {c}" for u, c in zip(grid.units, grid.cells)])
        counted = fine.groupBy(*grid.cells).agg(F.count(F.lit(1)).alias("_n"))
        ancestors = counted.selectExpr("*", f"explode(sequence({low}, {high})) AS _level").selectExpr(
            "*", *[f"shiftright({c}, {high} - _level) AS _a{c}" for c in grid.cells]
        )
        above = ["_level", *[f"_a{c}" for c in grid.cells]]
        crowded = ancestors.groupBy(*above).agg(F.sum("_n").alias("_all")).where(F.col("_all") > capacity)
        split = durable(ancestors.join(crowded, above).groupBy(*grid.cells).agg(F.max("_level").alias("_split")))
        owned = fine.join(split, grid.cells, "left").withColumn("_level", F.expr(f"coalesce(_split + 1, {low})"))
        last = high == MAX_LEVEL or not split.where(F.col("_split") == high).limit(1).count()
        leaf = F.expr(f"least(_level, {high})").alias("_level")
        up = [F.expr(f"shiftright({c}, {high} - least(_level, {high}))").alias(c) for c in grid.cells]
        parts.append((owned if last else owned.where(F.col("_level") <= high)).select(*rows.columns, leaf, *up))
        if last:
            break
        waiting = durable(owned.where(F.col("_level") > high).select(*rows.columns))
        low, high = high + 1, min(high + STEP, MAX_LEVEL)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole, high


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Dealt over all of the session's shuffle partitions: few bytes ahead of much work are not put together."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def leaves(rows: DataFrame, grid: Grid, capacity: int, entry: Column) -> tuple[DataFrame, int]:
    """One row per leaf: `_leaf`, its level and cell, the box of its rows and `_rows`, the array of their entries.

    A crowded cell of the finest level gives several such rows, so that an array stays near `capacity` entries.
    The second result bounds the levels.
    """
    owned, deepest = in_leaves(rows, grid, capacity)
    keys = list(grid.keys)
    if deepest == MAX_LEVEL:
        finest = owned.where(F.col("_level") == MAX_LEVEL).groupBy(*keys).agg(F.count(F.lit(1)).alias("_crowd"))
        parts = F.ceil(F.coalesce("_crowd", F.lit(1)) / capacity)
        owned = owned.join(finest, keys, "left").withColumn("_part", F.pmod(F.xxhash64(*rows.columns), parts))
        keys.append("_part")
    low = [F.min(u).alias(f"_lo{i}") for i, u in enumerate(grid.units)]
    high = [F.max(u).alias(f"_hi{i}") for i, u in enumerate(grid.units)]
    made = owned.groupBy(*keys).agg(*low, *high, F.collect_list(entry).alias("_rows"))
    return made.drop("_part").withColumn("_leaf", F.monotonically_increasing_id()), deepest


def box_gap2(axes: int, a: str, b: str) -> str:
    """Squared gap between two boxes whose ends are named <prefix>lo<i> and <prefix>hi<i>; 0 where they meet."""
    sides = [f"greatest({a}lo{i} - {b}hi{i}, {b}lo{i} - {a}hi{i}, 0D)" for i in range(axes)]
    return " + ".join(f"{s} * {s}" for s in sides)


def leaf_pairs(searching: DataFrame, found: DataFrame, grid: Grid, deepest: int) -> DataFrame:
    """(_leaf, _other): for each searching leaf the leaves whose box lies within its `_reach`, itself among them.

    A leaf looks at the few cells, about as wide as its box and reach, that these touch.  Finer leaves are listed
    at the cells above them, coarser ones are looked up above the cell; a leaf stands for all of its rows.
    """
    axes = len(grid.coords)
    columns = ["_leaf", *grid.keys, "_reach", *[f"_{e}{i}" for i in range(axes) for e in ("lo", "hi")]]
    light = searching.select(*columns)
    width = "greatest(" + ", ".join(f"_hi{i} - _lo{i}" for i in range(axes)) + ") / 2 + _reach"
    spans = [(f"(_lo{i} - _reach)", f"(_hi{i} + _reach)") for i in range(axes)]
    sought = grid.cover(light.drop(*grid.keys).selectExpr("*", f"least({level_for(width)}, {deepest}) AS _level"), spans)

    def upwards(df: DataFrame, levels: str, kind: str) -> DataFrame:
        """The cells above (_level, cells) at some levels."""
        spread = df.selectExpr("*", f"explode({levels}) AS _l")
        cells = [f"shiftright({c}, _level - _l) AS {c}" for c in grid.cells]
        return spread.selectExpr(*[c for c in df.columns if c not in grid.keys], "_l AS _level", *cells, f"'{kind}' AS _kind")

    searches = upwards(sought, "array(_level)", "under").unionByName(
        upwards(sought.where("_level > 0"), "sequence(0, _level - 1)", "own").distinct()
    )
    listed = found.select(*columns).withColumnsRenamed({c: f"_o{c}" for c in columns if c not in grid.keys})
    targets = upwards(listed, "sequence(0, _level)", "under").unionByName(upwards(listed, "array(_level)", "own"))
    met = searches.join(targets, [*grid.keys, "_kind"])
    near = met.where(f"sqrt({box_gap2(axes, '_', '_o_')}) <= _reach")
    return near.select("_leaf", F.col("_o_leaf").alias("_other")).distinct()
