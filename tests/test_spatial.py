"""Spatial operators against brute force on small point sets."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from citegrain.functions import geometry as g
from citegrain.operators import polygons, quadtree
from citegrain.operators import spatial as sp
from citegrain.plans import jobs


def brute_knn(points, k):
    out = {}
    for i, *p in points:
        others = sorted((math.dist(p, q), j) for j, *q in points if j != i)
        out[i] = [j for _, j in others[:k]]
    return out


def cloud(kind, seed=5):
    rng = random.Random(seed)
    if kind == "uniform":
        return [(i, rng.uniform(-100, -70), rng.uniform(25, 45)) for i in range(300)]
    if kind == "crowded":  # a third in one spot-sized cluster, the rest far apart
        return [
            (i, -80 + rng.gauss(0, 1e-4), 26 + rng.gauss(0, 1e-4))
            if i % 3 == 0
            else (i, rng.uniform(-120, -70), rng.uniform(25, 49))
            for i in range(240)
        ]
    if kind == "copies":  # a third at exactly one place
        return [
            (i, -80.0, 26.0) if i % 3 == 0 else (i, rng.uniform(-90, -70), rng.uniform(25, 30))
            for i in range(150)
        ]
    if kind == "few":
        return [(i, float(i), 0.0) for i in range(4)]
    if kind == "same":
        return [(i, 1.0, 2.0) for i in range(12)]
    if kind == "outlier":
        return [*cloud("uniform"), (300, 1e12, 3.0)]
    if kind == "line":
        return [(i, float(i), 7.0) for i in range(60)]
    raise ValueError(kind)


@pytest.mark.parametrize("kind", ["uniform", "crowded", "copies", "few", "same", "line", "outlier"])
def test_nearest_neighbours_match_brute_force(spark, kind):
    points = cloud(kind)
    df = spark.createDataFrame(points, "id int, lon double, lat double")
    rows = sp.nearest_neighbours(df, "id", ["lon", "lat"], 6).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["id"], r["rank"])):
        got.setdefault(r["id"], []).append(r["nbr"])
    assert got == brute_knn(points, 6)


def test_unusual_column_names(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 5.0, 0.0)], ["my id", "lon deg", "lat deg"])
    rows = sp.nearest_neighbours(df, "my id", ["lon deg", "lat deg"], 1).collect()
    assert {r["my id"]: r["nbr"] for r in rows} == {1: 2, 2: 1, 3: 2}
    assert sp.band_neighbours(df, "my id", ["lon deg", "lat deg"], 1.0).count() == 2


def test_great_circle_neighbours_cross_the_date_line(spark):
    points = [(1, 179.9, 0.0), (2, -179.9, 0.0), (3, 170.0, 0.0), (4, 0.0, 89.9), (5, 180.0, 89.9)]
    df = spark.createDataFrame(points, "id int, lon double, lat double")
    rows = sp.great_circle_neighbours(df, "id", "lon", "lat", 1).collect()
    assert {r["id"]: r["nbr"] for r in rows} == {1: 2, 2: 1, 3: 1, 4: 5, 5: 4}
    near = next(r["metres"] for r in rows if r["id"] == 1)
    assert near == pytest.approx(math.radians(0.2) * g.EARTH_RADIUS_M)


@pytest.mark.parametrize("kind", ["crowded", "copies", "same"])
def test_band_matches_brute_force(spark, kind):
    points = cloud(kind)
    df = spark.createDataFrame(points, "id int, lon double, lat double")
    got = {(r["id"], r["nbr"]) for r in sp.band_neighbours(df, "id", ["lon", "lat"], 1.5).collect()}
    assert got == {
        (i, j) for i, *p in points for j, *q in points if i != j and math.dist(p, q) <= 1.5
    }


@pytest.mark.parametrize("kind", ["crowded", "copies", "same", "outlier"])
def test_band_counts_match_brute_force(spark, kind):
    points = cloud(kind)
    df = spark.createDataFrame(points, "id int, lon double, lat double")
    got = {r["id"]: r["others"] for r in sp.band_counts(df, "id", ["lon", "lat"], 1.5).collect()}
    assert got == {i: sum(i != j and math.dist(p, q) <= 1.5 for j, *q in points) for i, *p in points}


def test_local_g_matches_formula(spark):
    rng = np.random.default_rng(3)
    pts = [(i, float(x), float(y), float(v)) for i, (x, y, v) in enumerate(rng.normal(size=(60, 3)))]
    df = spark.createDataFrame(pts, "id int, lon double, lat double, v double")
    got = {r["id"]: r["z_v"] for r in sp.local_g(df, "id", ["lon", "lat"], ["v"], 5).collect()}
    v = np.array([p[3] for p in pts])
    n = len(v)
    for i, nbrs in brute_knn([p[:3] for p in pts], 5).items():
        rest = np.delete(v, i)
        mean, var = rest.mean(), rest.var()
        z = (v[nbrs].mean() - mean) / math.sqrt(var * ((n - 1) / 5 - 1) / (n - 2))
        assert got[i] == pytest.approx(z, rel=1e-9)


def test_local_g_without_variance_is_null(spark):
    df = spark.createDataFrame([(i, float(i), 0.0, 4.0) for i in range(8)], "id int, lon double, lat double, v double")
    rows = sp.local_g(df, "id", ["lon", "lat"], ["v"], 2).collect()
    assert len(rows) == 8 and all(r["z_v"] is None and r["spot_v"] is None for r in rows)


def candidate_pairs(df):
    """Rows that the joins of a plan made, after it has run."""
    df.collect()
    total, stack = 0, [df._jdf.queryExecution().executedPlan()]
    while stack:
        node = stack.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            stack.append(node.executedPlan())
            continue
        if "QueryStage" in name:
            stack.append(node.plan())
        if "Join" in name:
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
    return total


def test_polygons_away_from_the_points_meet_none(spark):
    far = [(f"p{i}", f"POLYGON (({50 + i} 0, {51 + i} 0, {51 + i} 1, {50 + i} 0))") for i in range(50)]
    areas = spark.createDataFrame(far, "geoid string, wkt string")
    points = spark.createDataFrame([(i, i / 100, i / 200) for i in range(200)], "id int, lon double, lat double")
    found = polygons.points_in_polygons(areas, points, "geoid", "wkt", "lon", "lat", keep_empty=False)
    assert candidate_pairs(found) == 0 and found.count() == 0
    assert polygons.points_in_polygons(areas, points, "geoid", "wkt", "lon", "lat").count() == 50


def test_positions_that_are_not_finite_are_left_out(spark):
    points = [(i, float(i), 0.0) for i in range(6)] + [(6, math.inf, 0.0), (7, 1.0, -math.inf), (8, math.nan, 1.0)]
    df = spark.createDataFrame(points, "id int, lon double, lat double")
    assert {r["id"] for r in sp.nearest_neighbours(df, "id", ["lon", "lat"], 2).collect()} == set(range(6))
    assert sp.band_neighbours(df, "id", ["lon", "lat"], 1.0).count() == 10


def test_points_in_polygons(spark):
    areas = spark.createDataFrame(
        [
            ("sq", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))"),
            ("hole", "POLYGON ((10 0, 16 0, 16 6, 10 6, 10 0), (12 2, 14 2, 14 4, 12 4, 12 2))"),
            ("multi", "MULTIPOLYGON (((20 0, 22 0, 20 2, 20 0)), ((30 0, 32 0, 30 2, 30 0)))"),
            ("empty", "POLYGON ((50 50, 51 50, 51 51, 50 50))"),
        ],
        "geoid string, wkt string",
    )
    spots = {
        1: (1, 1), 2: (0, 2), 3: (4, 4), 4: (13, 3), 5: (11, 1), 6: (20.5, 0.5), 7: (30.5, 0.5),
        8: (21.9, 1.9), 9: (100, -40), 10: (3.999, 0.001),
    }
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in spots.items()], "id int, lon double, lat double")
    rows = polygons.points_in_polygons(areas, points, "geoid", "wkt", "lon", "lat").collect()
    assert sorted(((r["geoid"], r["id"]) for r in rows), key=str) == sorted(
        [("sq", 1), ("sq", 10), ("hole", 5), ("multi", 6), ("multi", 7), ("empty", None)], key=str
    )


def test_shift_repeats_separates_copies(spark):
    df = spark.createDataFrame([(i, 1.0, 2.0) for i in range(1, 6)] + [(9, 3.0, 4.0)], "id int, lon double, lat double")
    rows = {r["id"]: (r["lon"], r["lat"]) for r in sp.shift_repeats(df, "id", ["lon", "lat"]).collect()}
    assert rows[1] == (1.0, 2.0) and rows[9] == (3.0, 4.0)
    assert len(set(rows.values())) == 6
    many = spark.range(300).selectExpr("id", "1D AS lon", "2D AS lat")
    moved = sp.shift_repeats(many, "id", ["lon", "lat"])
    assert moved.select("lon", "lat").distinct().count() == 300
    assert moved.select("lon").distinct().count() == 300 and moved.where("lon = 1").count() == 1


def test_wkt_points(spark):
    df = spark.createDataFrame([("POINT (-86.5 32.25)",), ("point(1e1 -2)",), ("POINT EMPTY",), (None,)], "w string")
    got = [r["p"] for r in df.select(g.wkt_point(F.col("w")).alias("p")).collect()]
    assert [tuple(p) if p else None for p in got] == [(-86.5, 32.25), (10.0, -2.0), None, None]


def ring_text(ring):
    return "(" + ", ".join(f"{x!r} {y!r}" for x, y in [*ring, ring[0]]) + ")"


def brute_inside(rings, x, y):
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]]):
            side = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
            if side == 0 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
                return False
            if (ay > y) != (by > y) and (side > 0 if by > ay else side < 0):
                odd = not odd
    return odd


def polygon_hits(spark, shapes, spots):
    areas = spark.createDataFrame(
        [(k, "POLYGON (" + ", ".join(map(ring_text, rings)) + ")") for k, rings in shapes.items()], "geoid string, wkt string"
    )
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(spots)], "id int, lon double, lat double")
    found = polygons.points_in_polygons(areas, points, "geoid", "wkt", "lon", "lat", keep_empty=False)
    rows = found.select("geoid", "id").collect()
    return sorted((r["geoid"], r["id"]) for r in rows)


@pytest.mark.parametrize("seed", range(4))
def test_polygons_on_a_lattice(spark, seed):
    """Vertices, borders and points share coordinates with cells and each other; polygons may cross themselves."""
    rng = random.Random(seed)
    size = 8
    shapes = {
        f"p{n}": [[(rng.randrange(size + 1), rng.randrange(size + 1)) for _ in range(rng.randrange(3, 40))] for _ in range(rng.randrange(1, 3))]
        for n in range(12)
    }
    shapes["wide"] = [[(-50, -50), (50, -50), (50, 50), (-50, 50)], [(2, 2), (6, 2), (6, 6), (2, 6)]]
    spots = [(x / 2, y / 2) for x in range(2 * size + 1) for y in range(2 * size + 1)]
    expected = sorted((k, i) for k, rings in shapes.items() for i, (x, y) in enumerate(spots) if brute_inside(rings, x, y))
    assert polygon_hits(spark, shapes, spots) == expected


def test_polygon_of_many_vertices(spark):
    rng = random.Random(2)
    n = 100_000
    ring = []
    for i in range(n):
        r = 10 + math.sin(40 * math.pi * i / n) + rng.uniform(0, 0.01)
        ring.append((r * math.cos(2 * math.pi * i / n), r * math.sin(2 * math.pi * i / n)))
    spots = [(rng.uniform(-14, 14), rng.uniform(-14, 14)) for _ in range(1500)]
    ax, ay = np.array(ring).T
    bx, by = np.roll(ax, -1), np.roll(ay, -1)
    expected = []
    for i, (x, y) in enumerate(spots):
        side = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        if ((((ay > y) != (by > y)) & np.where(by > ay, side > 0, side < 0)).sum()) % 2:
            expected.append(("big", i))
    assert polygon_hits(spark, {"big": [ring]}, spots) == expected
    # a point meets the edges of its own cell
    areas = spark.createDataFrame([("big", f"POLYGON ({ring_text(ring)})")], "geoid string, wkt string")
    points = spark.createDataFrame(spots, "lon double, lat double")
    grid = quadtree.Grid(points, ["lon", "lat"])
    index = polygons.cell_index(polygons.near_polygons(areas, "geoid", "wkt", grid), grid)
    most, whole = index.agg(F.max(F.size("_edges")), F.count(F.when(F.col("_edges").isNull(), 1))).first()
    assert most < n / 100 and whole > 1000


def test_each_candidate_is_in_one_leaf(spark):
    for kind in ("uniform", "crowded", "outlier"):
        df = spark.createDataFrame(cloud(kind), "id int, lon double, lat double")
        grid = quadtree.Grid(df, ["lon", "lat"])
        held, deepest = quadtree.leaves(grid.place(df), grid, 10, F.col("id"))
        rows = held.collect()
        assert sorted(i for r in rows for i in r["_rows"]) == sorted(p[0] for p in cloud(kind))
        assert max(r["_level"] for r in rows) <= deepest
        assert all(len(r["_rows"]) <= 10 for r in rows if r["_level"] < quadtree.MAX_LEVEL)
        places = {(r["_level"], r["_c0"], r["_c1"]) for r in rows}
        assert not any((level - up, x >> up, y >> up) in places for level, x, y in places for up in range(1, level + 1))


def test_copies_of_a_position_never_meet(spark):
    rows = [(f"F{i}", 2022, 30.0, -90.0, 1.0 * (i % 7)) for i in range(3000)]
    df = spark.createDataFrame(rows, "facility_id string, insp_year int, lat double, lon double, v double")
    spots = jobs.hot_spots(df, 2022, ["v"], k=3)
    assert spots.select("lat", "lon").distinct().count() == 3000


def test_measures_share_a_neighbour_table(spark):
    rng = np.random.default_rng(7)
    rows = [(i, float(x), float(y), float(v), float(w)) for i, (x, y, v, w) in enumerate(rng.normal(size=(80, 4)))]
    df = spark.createDataFrame(rows, "id int, lon double, lat double, v double, w double")
    table = sp.neighbour_table(df, "id", ["lon", "lat"], 5, "weights_of_test")
    shared = sp.local_g_of(table, df, "id", ["v", "w"])
    direct = {r["id"]: (r["z_v"], r["z_w"], r["spot_v"]) for r in sp.local_g(df, "id", ["lon", "lat"], ["v", "w"], 5).collect()}
    got = {r["id"]: (r["z_v"], r["z_w"], r["spot_v"]) for r in shared.collect()}
    assert got.keys() == direct.keys()
    for i, (v, w, spot) in got.items():
        assert (v, w) == pytest.approx(direct[i][:2], rel=1e-9) and spot == direct[i][2]
    # the kept table meets measures without a shuffle: between its scan and the join there is no exchange
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = table.join(df.withColumnRenamed("id", "nbr"), "nbr")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    above_scan = plan.split("Bucketed: true")[0].splitlines()
    assert "Bucketed: true" in plan and plan.count("Exchange") == 1 and "Exchange" not in "".join(above_scan[-3:])
    spark.sql("DROP TABLE weights_of_test")
