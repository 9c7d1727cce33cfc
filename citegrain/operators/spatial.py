"""Nearest neighbours, distance bands and local hot spots.

Candidates meet through cells of a square grid hierarchy: level 0 is one cell over all points and
every level halves the cell side.  Neighbour searches list points in the leaves of an adaptive quadtree over it.
No operator pairs points without near cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citegrain.functions.geometry import haversine, unit_vector, valid_position
from citegrain.functions.values import hot_cold
from citegrain.operators.durable import durable
from citegrain.operators.quadtree import Grid, finite, leaf_pairs, leaves, spread
from citegrain.operators.rows import repeat_flag
from citegrain.operators.summaries import placed_values

# A leaf holds so many times the candidates that a search wants.
LEAF_FILL = 4
# Rows of a leaf whose pairs within a distance are looked for.
BAND_FILL = 1000
# Repeated positions move by multiples of so many degrees.
OFFSET_STEP = 1e-10


def valid_points(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Rows with a usable position."""
    return df.where(valid_position(F.col(lon), F.col(lat)))


def shift_repeats(df: DataFrame, id_col: str, coords: Sequence[str]) -> DataFrame:
    """Move rows that repeat a position apart by small offsets, other ones on each axis; the smallest id stays.

    The offset counts the ids at the place, so copies never meet; rows that share id and position stay together.
    Ids are counted by ordered buckets, so that a place may hold any share of the rows.
    """
    flagged = repeat_flag(df, coords, id_col)
    repeats = flagged.where("is_repeat").groupBy(*coords, id_col).agg(F.lit(1).cast("bigint").alias("n"))
    number = placed_values(repeats, id_col, list(coords)).select(*coords, id_col, (F.col("before") + 1).alias("_number"))
    numbered = flagged.join(number, [*coords, id_col], "left")
    moved = {c: F.col(c) + F.coalesce(F.col("_number") * ((i + 1) * OFFSET_STEP), F.lit(0.0)) for i, c in enumerate(coords)}
    return numbered.withColumns(moved).select(*flagged.columns)


def nearest_neighbours(
    points: DataFrame,
    id_col: str,
    coords: Sequence[str],
    k: int,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Exact k nearest other points, ties by id.

    Output: the point's columns plus `rank`, `nbr`, `gap` (straight-line distance over `coords`) and
    `nbr_<c>` for the coordinates and every carried column.

    Points at one place share one search, and a place shows at most its k+1 smallest ids as candidates, which no
    ranking can look past; so copies cost nothing.  Candidates lie in the leaves of an adaptive quadtree, each
    once.  A place's reach is its k+1st distance within its leaf, or the diagonal of the crowded cell above a
    leaf that holds fewer.  Leaves meet the leaves within their places' reach, and then places meet candidates.
    Adaptive execution splits crowded joins.  Positions that are not finite are left out.
    """
    coords, carry = list(coords), list(carry)
    located = finite(points, id_col, coords)
    grid, axes = Grid(located, coords), range(len(coords))
    at_place = Window.partitionBy(*coords).orderBy("nbr")
    candidates = durable(
        grid.place(
            located.select(F.col(id_col).alias("nbr"), *coords, *carry)
            .withColumn("_n", F.row_number().over(at_place))
            .where(F.col("_n") <= k + 1)
        )
    )
    entry = F.struct("nbr", "_n", *grid.units, *coords, *carry)
    held, deepest = leaves(candidates, grid, LEAF_FILL * (k + 1), entry)
    gap2 = " + ".join(f"(p.`{c}` - q.`{c}`) * (p.`{c}` - q.`{c}`)" for c in coords)
    last = f"element_at(array_sort(transform(_rows, q -> sqrt({gap2}) / {grid.span!r}D)), {k + 1})"
    # the cell above holds k+1 candidates; a set that fits one leaf is searched whole
    above = f"if(_level = 0, {2.0 * len(coords)}D, {2 * len(coords) ** 0.5!r}D * pow(2D, -_level))"
    # widened a little so that rounding cannot lose a neighbour at the rim
    reach = f"(if(size(_rows) > {k}, {last}, {above}) * (1 + 1e-9D) + 1e-12D)"
    places = f"transform(filter(_rows, p -> p._n = 1), p -> struct(p AS p, {reach} AS reach))"
    held = durable(
        spread(held, "_leaf").withColumn("_places", F.expr(places)).withColumn("_reach", F.expr("array_max(transform(_places, p -> p.reach))"))
        .withColumn("_reach", F.expr("coalesce(_reach, 0D)"))
    )
    pairs = leaf_pairs(held.where("size(_places) > 0"), held, grid, deepest)
    targets = held.select(F.col("_leaf").alias("_other"), "_rows", *[F.col(f"_{e}{i}") for i in axes for e in ("lo", "hi")])
    met = spread(pairs, "_leaf", "_other").join(held.select("_leaf", "_places"), "_leaf").join(targets, "_other")
    away = " + ".join(f"pow(greatest(_lo{i} - _s.p._u{i}, _s.p._u{i} - _hi{i}, 0D), 2)" for i in axes)
    searching = met.selectExpr("_rows", *[f"_{e}{i}" for i in axes for e in ("lo", "hi")], "explode(_places) AS _s")
    searching = searching.where(f"sqrt({away}) <= _s.reach").selectExpr(
        "_s.p.nbr AS _place", *[f"_s.p.`{c}`" for c in coords], "_s.reach AS _reach", "explode(_rows) AS _q"
    )
    wanted = [f"nbr_{c}" for c in (*coords, *carry)]
    near = searching.selectExpr(
        "_place", *[f"`{c}`" for c in coords], "_reach", "_q.nbr AS nbr", *[f"_q.`{c}` AS `nbr_{c}`" for c in (*coords, *carry)]
    ).withColumn("_gap2", F.expr(grid.gap2())).where(f"sqrt(_gap2) / {grid.span!r}D <= _reach")
    in_search = Window.partitionBy("_place").orderBy("_gap2", "nbr")
    ranked = near.withColumn("_rank", F.row_number().over(in_search)).where(F.col("_rank") <= k + 1)
    entry = F.struct("_rank", "nbr", F.sqrt("_gap2").alias("gap"), *wanted)
    lists = ranked.groupBy("_place", *coords).agg(F.array_sort(F.collect_list(entry)).alias("_near"))

    owned = located.join(lists.drop("_place"), coords)
    others = F.slice(F.filter("_near", lambda e: e["nbr"] != F.col(id_col)), 1, k)
    listed = owned.select(*points.columns, F.posexplode(others).alias("_pos", "_e"))
    return listed.selectExpr(
        *[f"`{c}`" for c in points.columns], "_pos + 1 AS rank", *[f"_e.`{c}`" for c in ("nbr", "gap", *wanted)]
    )


def near_rows(rows: DataFrame, coords: Sequence[str], distance: float, entry: Column) -> DataFrame:
    """(_p, _q): the entries of all ordered pairs of rows at most `distance` apart, a row and itself among them.

    Rows lie in the leaves of an adaptive quadtree.  Leaves within the distance meet as a whole and are taken apart
    where they have met, so that no pair of rows is shuffled.
    """
    grid = Grid(rows, coords)
    held, deepest = leaves(grid.place(rows), grid, BAND_FILL, entry)
    held = durable(held.withColumn("_reach", F.lit(distance / grid.span * (1 + 1e-9) + 1e-12)))
    own = held.select("_leaf", F.col("_rows").alias("_own"))
    targets = held.select(F.col("_leaf").alias("_other"), "_rows")
    met = spread(leaf_pairs(held, held, grid, deepest).join(own, "_leaf").drop("_leaf"), "_other").join(targets, "_other")
    paired = met.selectExpr("_rows", "explode(_own) AS _p").selectExpr("_p", "explode(_rows) AS _q")
    return paired.where(f"{between('_p', '_q', coords)} <= {distance!r}D")


def between(p: str, q: str, coords: Sequence[str]) -> str:
    """Straight-line distance of two entries."""
    return "sqrt(" + " + ".join(f"({q}.`{c}` - {p}.`{c}`) * ({q}.`{c}` - {p}.`{c}`)" for c in coords) + ")"


def band_neighbours(points: DataFrame, id_col: str, coords: Sequence[str], distance: float) -> DataFrame:
    """Ordered pairs of different points at most `distance` apart; positions that are not finite are left out."""
    located = finite(points, id_col, coords).select(id_col, *coords)
    entry = F.struct(F.col(id_col).alias("id"), *coords)
    found = near_rows(located, coords, distance, entry).where("_p.id != _q.id")
    return found.selectExpr(f"_p.id AS `{id_col}`", "_q.id AS nbr", f"{between('_p', '_q', coords)} AS gap")


def band_counts(points: DataFrame, id_col: str, coords: Sequence[str], distance: float) -> DataFrame:
    """Every point with `others`, the number of other points at most `distance` apart.

    Places are paired, not points: copies count through their number, however many there are.
    """
    located = finite(points, id_col, coords)
    places = durable(
        located.groupBy(*coords).agg(F.count(F.lit(1)).alias("_n")).withColumn("_place", F.monotonically_increasing_id())
    )
    pairs = near_rows(places, coords, distance, F.struct("_place", "_n", *coords)).where("_p._place != _q._place")
    own = places.select("_place", (F.col("_n") - 1).alias("_n"))
    others = own.unionByName(pairs.selectExpr("_p._place AS _place", "_q._n AS _n")).groupBy("_place").agg(F.sum("_n").alias("others"))
    return located.join(places.join(others, "_place").drop("_place", "_n"), list(coords))


def neighbour_table(points: DataFrame, id_col: str, coords: Sequence[str], k: int, name: str) -> DataFrame:
    """The k nearest others of each point, kept as the table `name`: (point, nbr, rank, gap).

    The table is bucketed by `nbr` over the session's shuffle partitions, so that measures of any number join it
    without a shuffle of its rows and without a second search.
    """
    found = nearest_neighbours(points.select(id_col, *coords), id_col, coords, k)
    buckets = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = found.select(F.col(id_col).alias("point"), "nbr", "rank", "gap").repartition(buckets, "nbr")
    table.write.mode("overwrite").bucketBy(buckets, "nbr").sortBy("nbr").saveAsTable(name)
    return points.sparkSession.table(name)


def _moments(usable: DataFrame, values: Sequence[str]) -> tuple[int, list]:
    totals = usable.agg(F.count(F.lit(1)), *[f(v) for v in values for f in (F.avg, F.var_pop)]).first()
    return totals[0], list(totals[1:])


def _scored(lags: DataFrame, n: int, moments: list, values: Sequence[str]) -> DataFrame:
    """z-scores and classes from centred values _v<i>, their neighbours' means _lag_v<i> and numbers _k."""
    factor = F.try_divide((n - 1) / F.col("_k") - 1, F.lit(float(n - 2)))
    scores = {}
    for i, v in enumerate(values):
        c, others = f"_v{i}", F.lit(float(n - 1))
        mean = F.try_divide(-F.col(c), others)
        square = F.try_divide(n * (moments[2 * i + 1] or 0.0) - F.col(c) * F.col(c), others)
        variance = (square - mean * mean) * factor
        spread = F.sqrt(F.when(variance > 1e-12 * square, variance))
        scores[f"z_{v}"] = F.try_divide(F.col(f"_lag{c}") - mean, spread)
    scored = lags.withColumns(scores)
    return scored.withColumns({f"spot_{v}": hot_cold(F.col(f"z_{v}")) for v in values})


def _centred(values: Sequence[str], moments: list) -> dict:
    return {f"_v{i}": F.col(v) - F.lit(moments[2 * i]) for i, v in enumerate(values)}


def local_g(points: DataFrame, id_col: str, coords: Sequence[str], values: Sequence[str], k: int) -> DataFrame:
    """Local G z-score of each measure with equal weights on the k nearest others, and its class.

    One neighbour search serves all measures.  Values are taken about their mean, which keeps the
    variance of close values exact; without variance the score is null.
    """
    usable = finite(points, id_col, coords).dropna(subset=list(values))
    n, moments = _moments(usable, values)
    own = [f"_v{i}" for i in range(len(values))]
    centred = usable.select(id_col, *coords, *values).withColumns(_centred(values, moments))
    lags = (
        nearest_neighbours(centred, id_col, coords, k, carry=own)
        .groupBy(id_col, *coords, *values, *own)
        .agg(F.count(F.lit(1)).alias("_k"), *[F.avg(f"nbr_{c}").alias(f"_lag{c}") for c in own])
    )
    scores = [f"{kind}_{v}" for kind in ("z", "spot") for v in values]
    return _scored(lags, n, moments, values).select(id_col, *coords, *values, *scores)


def local_g_of(table: DataFrame, measures: DataFrame, id_col: str, values: Sequence[str]) -> DataFrame:
    """Local G of measures over a kept neighbour table; points without a value take no part.

    `table` comes from `neighbour_table` over the same points; a neighbour without a value is left out of the mean.
    """
    usable = measures.select(id_col, *values).dropna(subset=[id_col, *values])
    n, moments = _moments(usable, values)
    centred = usable.withColumns(_centred(values, moments))
    of_nbr = centred.select(F.col(id_col).alias("nbr"), *[F.col(f"_v{i}").alias(f"nbr_v{i}") for i in range(len(values))])
    lags = table.join(of_nbr, "nbr").groupBy("point").agg(
        F.count(F.lit(1)).alias("_k"), *[F.avg(f"nbr_v{i}").alias(f"_lag_v{i}") for i in range(len(values))]
    )
    joined = centred.join(lags.withColumnRenamed("point", id_col), id_col)
    scores = [f"{kind}_{v}" for kind in ("z", "spot") for v in values]
    return _scored(joined, n, moments, values).select(id_col, *values, *scores)


def great_circle_neighbours(
    points: DataFrame, id_col: str, lon: str, lat: str, k: int, carry: Sequence[str] = ()
) -> DataFrame:
    """k nearest others by great-circle distance, in metres.

    The search runs on unit-sphere positions, whose chords order pairs as great circles do, so the
    date line and the poles need no special case.
    """
    axes = ["_x", "_y", "_z"]
    positions = unit_vector(F.col(lon), F.col(lat))
    on_sphere = valid_points(points, lon, lat).withColumns(dict(zip(axes, positions)))
    found = nearest_neighbours(on_sphere, id_col, axes, k, [lon, lat, *carry])
    metres = haversine(F.col(lon), F.col(lat), F.col(f"nbr_{lon}"), F.col(f"nbr_{lat}"))
    return found.select(
        *points.columns, "rank", "nbr", metres.alias("metres"), *[f"nbr_{c}" for c in carry]
    )
