"""The index of polygons against all edges, overlays against unit cells and against sampled points."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from hillspan.operators import polygons as Y

RINGS = "poly long, ring array<struct<x:double,y:double>>"


def edges(ring):
    return list(zip(ring, [*ring[1:], *ring[:1]], strict=True))


def holds(rings, x, y):
    """Even-odd rule by a ray to the right."""
    return sum(((a[1] > y) != (b[1] > y)) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for r in rings for a, b in edges(r)) % 2 == 1


def d2(rings, x, y):
    out = float("inf")
    for r in rings:
        for (ax, ay), (bx, by) in edges(r):
            dx, dy = bx - ax, by - ay
            if dx or dy:
                t = max(0.0, min(1.0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy)))
                out = min(out, (x - (ax + t * dx)) ** 2 + (y - (ay + t * dy)) ** 2)
    return out


def star(r, cx, cy, size, n, whole=False):
    import math

    out = []
    for k in range(n):
        far = size * r.uniform(0.3, 1)
        x, y = cx + far * math.cos(2 * math.pi * k / n), cy + far * math.sin(2 * math.pi * k / n)
        out.append((float(round(x)), float(round(y))) if whole else (x, y))
    return out


def layer(spark, polygons):  # a row for each ring
    return spark.createDataFrame([(k, r) for k, rings in polygons.items() for r in rings], RINGS).repartition(3)


@pytest.mark.parametrize("size", [0.7, 5.0, 1000.0])
@pytest.mark.parametrize("whole", [False, True])
def test_points_in_polygons(spark, size, whole):
    r = random.Random(int(size) + whole)
    polygons = {k: [star(r, r.uniform(0, 40), r.uniform(0, 40), r.uniform(2, 20), r.choice([3, 5, 40, 400]), whole) for _ in range(r.choice([1, 1, 2]))] for k in range(12)}
    polygons[50] = [[(0.0, 0.0), (30.0, 0.0), (30.0, 30.0), (0.0, 30.0)], [(10.0, 10.0), (10.0, 20.0), (20.0, 20.0), (20.0, 10.0)]]
    polygons[51] = [[(1.0, 1.0), (1.0, 1.0)], [(2.0, 2.0)]]
    points = [(i, float(r.randint(-5, 45)), float(r.randint(-5, 45))) if i % 2 else (i, r.uniform(-5, 45), r.uniform(-5, 45)) for i in range(400)]
    p = spark.createDataFrame([*points, (1000, None, 3.0)], "id long, x double, y double")
    index = Y.polygon_index(Y.ring_edges(layer(spark, polygons)), size)
    got = {tuple(x) for x in Y.containing(p, "id", index, size).collect()}
    assert got == {(i, k) for i, x, y in points for k, rings in polygons.items() if holds(rings, x, y)}


def test_mask_with_tolerances(spark):
    r = random.Random(4)
    land = {k: [star(r, 10 + 15 * k, 20, 12, 30)] for k in range(3)}
    lakes = {k: [star(r, 10 + 15 * k, 20, 6, 20)] for k in range(3)}
    points = [(i, r.uniform(-5, 55), r.uniform(5, 35)) for i in range(600)]
    got = dict(map(tuple, Y.land_mask(spark.createDataFrame(points, "id long, x double, y double"), "id", layer(spark, land), layer(spark, lakes), 0.8, 1.1, 3.0).collect()))
    for i, x, y in points:
        firm = any(holds(s, x, y) or d2(s, x, y) <= 0.8**2 for s in land.values())
        assert got[i] == (firm and not any(holds(s, x, y) and d2(s, x, y) > 1.1**2 for s in lakes.values()))


def blocks(r, n=12):
    """Unit cells of a shape, and the rings around them: every cell's own, whose common edges cancel."""
    cells = {(r.randrange(n), r.randrange(n)) for _ in range(40)}
    return cells, [[(float(i), float(j)), (i + 1.0, float(j)), (i + 1.0, j + 1.0), (float(i), j + 1.0)] for i, j in cells]


@pytest.mark.parametrize("size", [1.0, 3.0, 50.0])
def test_overlay_against_unit_cells(spark, size):
    """Shapes that touch in points and along edges, their own and each other's."""
    r = random.Random(int(size))
    a, b = ({k: blocks(r) for k in range(4)} for _ in range(2))
    la, lb = (layer(spark, {k: rings for k, (_, rings) in x.items()}) for x in (a, b))
    shared = Y.intersection(la, lb, size).groupBy("a", "b").agg(F.sum(Y.trapezoid_area()).alias("area"))
    assert {(x.a, x.b): round(x.area, 9) for x in shared.collect()} == {(i, j): len(a[i][0] & b[j][0]) for i in a for j in b if a[i][0] & b[j][0]}
    one = {7: b[0]}
    left = Y.difference(la, layer(spark, {7: one[7][1]}), size).groupBy("a").agg(F.sum(Y.trapezoid_area()).alias("area"))
    assert {x.a: round(x.area, 9) for x in left.collect()} == {i: len(a[i][0] - one[7][0]) for i in a if a[i][0] - one[7][0]}
    assert {x.poly: round(x.area, 9) for x in Y.polygon_areas(la, size).collect()} == {i: len(c) for i, (c, _) in a.items()}


def test_overlay_of_ragged_shapes(spark):
    """What two stars share and what is left of the first add up to it, and trapezoids hold the points that both do."""
    r = random.Random(9)
    a, b = {1: [star(r, 10, 10, 9, 60)]}, {2: [star(r, 14, 11, 9, 60), star(r, 14, 11, 2, 9)]}
    la, lb = layer(spark, a), layer(spark, b)
    both, rest = Y.intersection(la, lb, 2.5).collect(), Y.difference(la, lb, 2.5).collect()
    area = lambda rows: sum((t.y2 - t.y1) * (t.right1 - t.left1 + t.right2 - t.left2) / 2 for t in rows)
    assert area(both) + area(rest) == pytest.approx(Y.polygon_areas(la, 4.0).first().area, rel=1e-12)

    def within(rows, x, y):
        for t in rows:
            if t.y1 <= y < t.y2:
                s = (y - t.y1) / (t.y2 - t.y1)
                if t.left1 + s * (t.left2 - t.left1) <= x < t.right1 + s * (t.right2 - t.right1):
                    return True
        return False

    for _ in range(1500):
        x, y = r.uniform(0, 24), r.uniform(0, 22)
        assert within(both, x, y) == (holds(a[1], x, y) and holds(b[2], x, y))
        assert within(rest, x, y) == (holds(a[1], x, y) and not holds(b[2], x, y))


def test_overlays_of_many_polygons_are_not_broadcast(spark, monkeypatch):
    """Exploded edges count as few bytes in a plan's estimate, so that they would go through the driver; strips may run over batches."""
    from hillspan.operators import relational

    r = random.Random(4)
    a, b = ({k: [star(r, 10, 10, 9, 12)] for k in range(n)} for n in (6, 3))
    la, lb = layer(spark, a), layer(spark, b)
    area = lambda df, *keys: {tuple(x[:-1]): x.area for x in df.groupBy(*keys).agg(F.sum(Y.trapezoid_area()).alias("area")).collect()}
    few = area(Y.intersection(la, lb, 2.5), "a", "b"), area(Y.difference(la, lb.where("poly = 0"), 2.5), "a")
    monkeypatch.setattr(relational, "FEW_ROWS", 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        both, rest = Y.intersection(la, lb, 2.5), Y.difference(la, lb.where("poly = 0"), 2.5)
        for df in (both, rest):
            assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
        many = area(both, "a", "b"), area(rest, "a")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert many[0] == pytest.approx(few[0]) and many[1] == pytest.approx(few[1]) and len(few[0]) == 18


def test_no_polygons(spark):
    none, p = layer(spark, {}), spark.createDataFrame([(1, 0.0, 0.0)], "id long, x double, y double")
    assert Y.containing(p, "id", Y.polygon_index(Y.ring_edges(none), 1.0), 1.0).collect() == []
    assert [tuple(x) for x in Y.land_mask(p, "id", none, none, 1.0, 1.0, 1.0).collect()] == [(1, False)]
    assert Y.intersection(none, none, 1.0).collect() == Y.difference(none, none, 1.0).collect() == []
