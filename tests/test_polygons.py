"""The cell cover, the points that it finds in polygons, and the ledger of assignments, against plain tests of every point."""

import re

import numpy as np
from pyspark.sql import functions as F

from terraza.operators import cells as C
from terraza.operators import districts as D
from terraza.plans import polygons as P

SQUARE, INNER, HOLE = [(0, 0), (8, 0), (8, 8), (0, 8)], [(2, 2), (6, 2), (6, 6), (2, 6)], [(3.1, 3.3), (5.2, 3.0), (4.7, 5.9)]
SHAPES = {1: [[SQUARE, HOLE]], 2: [[[(4, 4), (12, 5), (10, 13), (5, 11), (4, 4)]], [[(20, 20), (21, 20), (20, 21)]]], 3: [[SQUARE, INNER], [[(3, 3), (5, 3), (5, 5), (3, 5)]]], 4: [[[(1, 1), (2, 2)]]], 5: [[[(-3, -3), (9, -2.5), (-2, 7.5), (-1, 1)]]]}


def shapes(spark, of=SHAPES):
    rows = [(k, [[[(float(x), float(y)) for x, y in ring] for ring in part] for part in parts]) for k, parts in of.items()]
    return spark.createDataFrame(rows, "polygon int, parts array<array<array<struct<x: double, y: double>>>>")


def holds(ring, x, y):
    inside, n = False, len(ring)
    if len(set(ring)) < 3:
        return False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        dx, dy = bx - ax, by - ay
        if dx or dy:
            t = min(1, max(0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy)))
            if np.hypot(x - ax - t * dx, y - ay - t * dy) <= 1e-10:
                return True
        if (ay > y) != (by > y) and x < dx * (y - ay) / dy + ax:
            inside = not inside
    return inside


def found(x, y, of=SHAPES):
    return {k for k, parts in of.items() if any(holds(p[0], x, y) and not any(holds(h, x, y) for h in p[1:]) for p in parts)}


def test_points_in_polygons(spark):
    rng = np.random.default_rng(3)
    points = [(float(x), float(y)) for x, y in rng.uniform(-4, 22, (1500, 2))] + [(x / 2, y / 2) for x in range(-8, 30) for y in range(-8, 30)]  # the lattice lies on borders
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(points)] + [(9000, None, 1.0)], "point long, x double, y double")
    want = {(i, k) for i, (x, y) in enumerate(points) for k in found(x, y)}
    for width in (0.7, 5.0):
        assert {(r["point"], r["polygon"]) for r in C.within(df, shapes(spark), "polygon", width).collect()} == want
    assert {k for _, k in want} == {1, 2, 3, 5}


def test_full_cells_hold_only_points_inside(spark):
    rows = C.cover(shapes(spark), "polygon", 0.5).collect()
    full = [r for r in rows if r["full"]]
    assert len(full) > 100 and len({(r["polygon"], r["part"], r["cx"], r["cy"]) for r in rows}) == len(rows)
    for r in full:
        for x, y in ((0, 0), (0.499, 0), (0.499, 0.499), (0, 0.499), (0.25, 0.25)):
            assert r["polygon"] in found(r["cx"] * 0.5 + x, r["cy"] * 0.5 + y)


def test_cover_is_as_large_as_the_polygon(spark):
    cells = C.cover(shapes(spark, {1: [[[(0, 0), (10, 0), (10, 10), (0, 10)]]]}), "polygon", 1.0)
    assert cells.where("full").count() == 64 and cells.count() <= 144  # 8 x 8 inside; the border meets the rows on either side of it


def test_assigned_and_excluded_add_up(spark):
    rows = [(1, 7, 1.0, 1.0, True), (2, 7, 4.0, 4.0, True), (3, 7, 30.0, 30.0, True), (4, 7, None, 1.0, True), (5, 7, 1.5, 1.0, False), (6, 8, 1.0, 1.0, True), (7, None, 1.0, 1.0, True), (8, 7, 0.0, 0.0, True), (9, 9, 21.0, 20.0, True), (10, 9, 20.2, 20.2, True)]
    df = spark.createDataFrame(rows, "listing_id long, district_id int, lat double, lon double, reconciled boolean")
    polygons = shapes(spark, {7: [[[(0, 0), (5, 0), (5, 5), (0, 5)]]], 8: [[[(3, 3), (6, 3), (6, 6), (3, 6)]]], 9: [[[(20, 20), (21, 20), (20, 21)]]]})
    own = D.assignments(df, polygons, 0.5, high_load=2)
    got = {r["listing_id"]: r for r in own.collect()}
    assert {i: r["reason"] for i, r in got.items()} == {1: None, 2: None, 3: "outside_district_polygon", 4: "invalid_coordinates", 5: "not_reconciled", 6: "not_high_load", 7: "not_high_load", 8: "invalid_coordinates", 9: None, 10: None}
    assert (got[2]["found"], got[3]["found"], got[3]["stage"], got[5]["stage"], got[5]["quadrant"]) == (2, 0, "geography", "reconciliation", "NE")  # 1.5 is the median
    for r in D.model(own).collect():
        assert r["observed"] == r["counted"] + r["invalid_coordinates"] + r["outside_district_polygon"] + r["not_reconciled"] and r["polygon_valid"] == r["nw"] + r["ne"] + r["sw"] + r["se"]
    assert sum(r["listings"] for r in D.exclusions(own).collect()) == len(rows)


def test_without_points_or_polygons(spark):
    none = spark.createDataFrame([], "point long, x double, y double")
    assert C.within(none, shapes(spark), "polygon", 1.0).count() == 0
    assert C.within(none.unionByName(spark.createDataFrame([(1, 1.0, 1.0)], none.schema)), shapes(spark).where("false"), "polygon", 1.0).select(F.count("*")).first()[0] == 0


def test_points_at_one_place_are_looked_up_once(spark):
    df = spark.range(900).selectExpr("id AS point", "CAST(1 + id % 2 * 3 AS DOUBLE) AS x", "CAST(1 + id % 2 * 3 AS DOUBLE) AS y", "id AS extra")
    out = C.within(df, shapes(spark), "polygon", 0.7)
    assert {(r["point"], r["polygon"], r["extra"]) for r in out.collect()} == {(i, k, i) for i in range(900) for k in found(*[(1.0, 1.0), (4.0, 4.0)][i % 2])}
    assert "zip_with" not in out._jdf.queryExecution().executedPlan().toString()  # no geometry for single points


def test_lists_of_listings_are_not_broadcast(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    data = "/root/testdata/sf0.001"
    assert "BroadcastHashJoin" not in plan(P.listings(spark, data))
    for sets in P._scenarios(spark, data).values():
        assert not re.search("BroadcastHashJoin.*Left(Semi|Anti)", plan(sets))
