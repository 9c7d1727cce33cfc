"""Points in polygons through cells that know their polygon's edges.

A polygon's edges are cut up by square cells, small ones where there are many edges.  A cell lists the edges that
touch it and whether its lower left corner lies inside; a cell that none touches lies wholly inside or outside.
A point meets its own cell only: it is inside where the walk from it to the corner, along the cell's left side,
crosses an odd number of the cell's edges more or less than the corner says.

Corners are settled row by row from the right: the edges of a cell that cross its lower side change the state
from one corner to the next.  Walks are taken a hair above and to the right of the line, a side being decided by
one formula everywhere, so that vertices on cell borders or at a point's height count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citegrain.functions.geometry import ring_edges, wkt_rings
from citegrain.operators.durable import durable
from citegrain.operators.quadtree import MAX_LEVEL, Grid, finite, level_for, spread

# Edges for each of which a polygon's box gets about one cell in each direction's square root.
EDGES_PER_CELL = 8
# Points of a shape that are handed to its polygons in one piece.
PIECE = 1000
# Edges are listed in cells that they miss by this share of a cell, so that rounding loses none.
MARGIN = 1e-6


def _side(e: str, x: str, y: str) -> str:
    """Positive on the left of an edge, seen from its start."""
    return f"(({e}.bx - {e}.ax) * ({y} - {e}.ay) - ({e}.by - {e}.ay) * ({x} - {e}.ax))"


def right_of(e: str, x: str, y: str) -> str:
    """Whether the edge crosses the height just above `y` to the right of `x`."""
    side = _side(e, x, y)
    return f"((({e}.ay > {y}) != ({e}.by > {y})) AND if({e}.by > {e}.ay, {side} > 0, {side} < 0))"


def above(e: str, x: str, y: str) -> str:
    """Whether the edge crosses the line just right of `x` above `y`."""
    side, rises = _side(e, x, y), f"({e}.by != {e}.ay AND ({e}.by > {e}.ay) = ({e}.bx > {e}.ax))"
    return f"((({e}.ax > {x}) != ({e}.bx > {x})) AND if({side} = 0, {rises}, ({side} < 0) = ({e}.bx > {e}.ax)))"


def touches(e: str, x: str, y: str) -> str:
    """Whether a point lies on the edge."""
    sides = [f"{v} BETWEEN least({e}.a{c}, {e}.b{c}) AND greatest({e}.a{c}, {e}.b{c})" for c, v in (("x", x), ("y", y))]
    return f"({_side(e, x, y)} = 0 AND {' AND '.join(sides)})"


def _corner(grid: Grid, cell: str, axis: int) -> str:
    """The position of a cell's lower end; the same number for the cell before."""
    return f"({grid.low[axis]!r}D + ({cell}) / _m * {grid.span!r}D)"


def near_polygons(polygons: DataFrame, polygon_id: str, wkt: str, grid: Grid) -> DataFrame:
    """(_polygon, _e, _level): the edges and the level of cells of each polygon whose box meets the grid's extent."""
    ringed = polygons.select(F.col(polygon_id).alias("_polygon"), ring_edges(wkt_rings(F.col(wkt))).alias("_e"))
    ends = {
        f"_{axis}{n}": F.expr(f"{end}(transform(_e, e -> e.a.{axis}))")
        for axis in "xy" for n, end in enumerate(("array_min", "array_max"))
    }
    bounded = ringed.withColumns(ends).where(
        (F.col("_x1") >= grid.low[0]) & (F.col("_x0") <= grid.high[0])
        & (F.col("_y1") >= grid.low[1]) & (F.col("_y0") <= grid.high[1])
    )
    half = f"(greatest(_x1 - _x0, _y1 - _y0) / 2 / {grid.span!r}D)"
    finer = f"int(greatest(floor(log2(size(_e) / {EDGES_PER_CELL}D) / 2), 0))"
    return bounded.selectExpr("_polygon", "_e", f"least({level_for(half)} + {finer}, {MAX_LEVEL}) AS _level")


def cell_index(near: DataFrame, grid: Grid) -> DataFrame:
    """(_polygon, _level, _i, _j, _inside, _edges): cells of the grid's extent in a polygon or touching its border.

    `_inside` tells of the lower left corner; `_edges` is null in cells wholly inside.
    """
    cut = near.selectExpr("_polygon", "_level", "inline(_e)").selectExpr(
        "_polygon", "_level", "a.x AS ax", "a.y AS ay", "b.x AS bx", "b.y AS by", "pow(2D, _level) AS _m"
    )
    for p in "ab":
        cut = cut.selectExpr("*", f"{grid.scaled(f'{p}x', 0)} * _m AS _u{p}", f"{grid.scaled(f'{p}y', 1)} * _m AS _v{p}")
    top = "bigint(floor(_m))"
    # rows of cells an edge meets, then the cells of a row; what lies beyond the extent to the right is one cell
    rows = cut.selectExpr(
        "*", f"greatest(bigint(floor(least(_va, _vb) - {MARGIN}D)), 0) AS _j0",
        f"least(bigint(floor(greatest(_va, _vb) + {MARGIN}D)), {top}) AS _j1",
    ).where("_j0 <= _j1").selectExpr("*", "explode(sequence(_j0, _j1)) AS _j")
    at = "if(_vb = _va, {0}, least(greatest((_j + {1} - _va) / (_vb - _va), 0D), 1D))"
    strip = rows.selectExpr(
        "*", f"_ua + {at.format('0D', -MARGIN)} * (_ub - _ua) AS _s", f"_ua + {at.format('1D', 1 + MARGIN)} * (_ub - _ua) AS _t"
    )
    listed = strip.selectExpr(
        "*", f"least(greatest(bigint(floor(least(_s, _t) - {MARGIN}D)), 0), {top} + 1) AS _i0",
        f"least(bigint(floor(greatest(_s, _t) + {MARGIN}D)), {top} + 1) AS _i1",
    ).where("_i0 <= _i1").selectExpr("_polygon", "_level", "_m", "struct(ax, ay, bx, by) AS _e", "_j", "explode(sequence(_i0, _i1)) AS _i")
    left, right, low = _corner(grid, "_i", 0), _corner(grid, "_i + 1", 0), _corner(grid, "_j", 1)
    change = F.expr(f"int({right_of('_e', left, low)} != ({right_of('_e', right, low)} AND _i <= {top}))")
    cells = listed.groupBy("_polygon", "_level", "_m", "_j", "_i").agg(
        F.sum(change).alias("_change"), F.collect_list("_e").alias("_edges")
    )
    from_right = Window.partitionBy("_polygon", "_j").orderBy(F.desc("_i"))
    settled = cells.withColumn("_inside", F.sum("_change").over(from_right) % 2 == 1).withColumn(
        "_before", F.coalesce(F.lead("_i").over(from_right), F.lit(-1).cast("bigint"))
    )
    border = settled.where(f"_i <= {top}").select("_polygon", "_level", "_i", "_j", "_inside", "_edges")
    whole = settled.where("_inside and _before + 1 < _i").selectExpr(
        "_polygon", "_level", "explode(sequence(_before + 1, _i - 1)) AS _i", "_j", "_inside", "null AS _edges"
    )
    return border.unionByName(whole)


def points_in_polygons(
    polygons: DataFrame,
    points: DataFrame,
    polygon_id: str,
    wkt: str,
    lon: str,
    lat: str,
    keep_empty: bool = True,
) -> DataFrame:
    """Polygon rows joined to the points they contain; empty polygons stay with null point columns.

    A point is looked up in one cell for each size of cell in use.  Points on a border are outside.  Polygons
    whose box misses the points' extent are not listed, and of the others only cells within it.  Only shapes,
    positions and edges travel to the match; a polygon's other columns join afterwards, so ids are unique.

    Polygons of equal text share one search.  A shape's points meet its polygons in pieces, which are taken apart
    where the result is written: no row of the result is shuffled, and a crowded shape is spread by its pieces.
    """
    located = finite(points, lon, [lon, lat])
    grid = Grid(located, [lon, lat])
    # one text per id; rings of rows that share an id make one shape
    texts = F.array_join(F.array_sort(F.collect_list(F.col(wkt))), " ")
    shaped = polygons.dropna(subset=[polygon_id]).groupBy(polygon_id).agg(texts.alias("_wkt"))
    shaped = shaped.withColumn("_shape", F.sha2("_wkt", 256))
    near = durable(near_polygons(shaped.select("_shape", "_wkt").distinct(), "_shape", "_wkt", grid))
    index = cell_index(near, grid)
    used = sorted(r[0] for r in near.select("_level").distinct().collect())  # at most MAX_LEVEL + 1
    levels = f"array({', '.join(map(str, used))})" if used else "cast(array() AS array<int>)"
    x, y = (grid.scaled(f"`{c}`", i) for i, c in enumerate((lon, lat)))
    at_cells = located.selectExpr("*", f"explode({levels}) AS _level").selectExpr(
        "*", "pow(2D, _level) AS _m", f"bigint(floor({x} * pow(2D, _level))) AS _i", f"bigint(floor({y} * pow(2D, _level))) AS _j"
    )
    met = at_cells.join(index, ["_level", "_i", "_j"]).selectExpr(
        "*", f"`{lon}` AS _x", f"`{lat}` AS _y", f"{_corner(grid, '_i', 0)} AS _left", f"{_corner(grid, '_j', 1)} AS _low"
    )
    along = f"int({right_of('e', '_x', '_y')} != {right_of('e', '_left', '_y')})"
    down = f"int({above('e', '_left', '_y')} != {above('e', '_left', '_low')})"
    odd = f"aggregate(_edges, int(_inside), (n, e) -> n + {along} + {down}) % 2 = 1"
    inside = f"_edges IS NULL OR ({odd} AND NOT exists(_edges, e -> {touches('e', '_x', '_y')}))"
    point = F.struct(*[F.col(f"`{c}`") for c in points.columns]).alias("_point")
    matched = durable(met.where(inside).select(
        F.col("_polygon").alias("_shape"), point, F.xxhash64(F.monotonically_increasing_id()).alias("_deal")
    ))
    parts = matched.groupBy("_shape").agg(F.ceil(F.count(F.lit(1)) / PIECE).alias("_parts"))
    pieces = matched.join(parts, "_shape").withColumn("_part", F.pmod("_deal", "_parts")).groupBy("_shape", "_part").agg(
        F.collect_list("_point").alias("_points")
    )
    how, outer = ("left", "_outer") if keep_empty else ("inner", "")
    rows = polygons.join(shaped.select(polygon_id, "_shape"), polygon_id, how).join(parts, "_shape", how)
    rows = rows.selectExpr("*", f"explode{outer}(sequence(0L, _parts - 1)) AS _part")
    at = ["_shape", "_part"]
    named = [polygon_id, *(c for c in polygons.columns if c != polygon_id)]
    return spread(rows, *at).join(spread(pieces, *at), at, how).selectExpr(*[f"`{c}`" for c in named], f"inline{outer}(_points)")
