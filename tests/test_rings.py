"""Rings from ways against plain Python."""

from __future__ import annotations

import random

from hillspan.operators.rings import nested, stitched

KIND = "way long, a long, b long, points array<struct<x:double,y:double>>"


def square(x, y, size, n):
    """A square's corners, each side in n parts."""
    corners = [(x, y), (x + size, y), (x + size, y + size), (x, y + size)]
    return [(p[0] + (q[0] - p[0]) * k / n, p[1] + (q[1] - p[1]) * k / n) for p, q in zip(corners, corners[1:] + corners[:1], strict=True) for k in range(n)]


def test_rings_of_many_ways(spark):
    r = random.Random(1)
    numbers = list(range(400))
    r.shuffle(numbers)
    ways, want, node = [], {}, 0
    for ring, parts in enumerate([1, 2, 3, 5, 8, 40, 90]):
        points = square(ring * 10.0, 0.0, 5.0, max(parts, 2))
        cuts = sorted(r.sample(range(len(points)), parts))
        names = [node + i for i in range(parts)]
        node += parts
        own = []
        for i, (start, end) in enumerate(zip(cuts, [*cuts[1:], cuts[0] + len(points)], strict=True)):
            line = [points[k % len(points)] for k in range(start, end + 1)]
            way, a, b = numbers.pop(), names[i], names[(i + 1) % parts]
            if r.random() < 0.5 and parts > 2:
                line, a, b = line[::-1], b, a
            ways.append((way, a, b, line))
            own.append((way, line))
        want[min(w for w, _ in own)] = (parts, {frozenset(p) for p in zip(points, points[1:] + points[:1], strict=True)}, min(own)[1])
    ways += [(500, 900, 901, [(0.0, 0.0), (1.0, 1.0)]), (501, 901, 902, [(1.0, 1.0), (2.0, 0.0)])]  # a line
    ways += [(502 + i, 910, 911 + i, [(0.0, 0.0), (1.0, float(i))]) for i in range(3)]  # a fork
    ways += [(510, None, 1, [(0.0, 0.0)]), (511, 2, 2, None)]
    got = stitched(spark.createDataFrame(ways, KIND).repartition(3)).collect()
    assert {x.ring for x in got} == set(want)
    for x in got:
        n, edges, first = want[x.ring]
        points = [(p.x, p.y) for p in x.points]
        assert x.n_ways == n and {frozenset(p) for p in zip(points, points[1:] + points[:1], strict=True)} == edges
        assert points[: len(first) - 1] == first[:-1]
    assert stitched(spark.createDataFrame([], KIND)).collect() == []


def test_shells_and_holes(spark):
    rings = [(1, square(0, 0, 100, 3)), (2, square(10, 10, 80, 2)), (3, square(20, 20, 10, 5)), (4, square(40, 40, 30, 1)), (5, square(45, 45, 5, 1)), (6, square(200, 0, 5, 1))]
    df = spark.createDataFrame([(k, [(float(x), float(y)) for x, y in p]) for k, p in rings], "ring long, points array<struct<x:double,y:double>>")
    assert {tuple(x) for x in nested(df, 7.0).collect()} == {(1, 0, 1), (2, 1, 1), (3, 2, 3), (4, 2, 4), (5, 3, 4), (6, 0, 6)}
