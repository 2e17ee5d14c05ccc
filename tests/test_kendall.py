"""Kendall's coefficient against all pairs, in one piece and in ranges."""

from __future__ import annotations

import itertools
import math
import random
import time

import numpy as np
import pytest

from hillspan.operators.stats import concordance, kendall


def sign(x):
    return (x > 0) - (x < 0)


def plain(rows):
    pairs = list(itertools.combinations([r for r in rows if r[0] is not None and r[1] is not None], 2))
    c = sum(sign(a[0] - b[0]) * sign(a[1] - b[1]) for a, b in pairs)
    na, nb = (sum(a[k] != b[k] for a, b in pairs) for k in (0, 1))
    return c, c / math.sqrt(na * nb) if na * nb else None


def test_concordance():
    r = random.Random(1)
    for n in (0, 1, 2, 3, 17, 64, 200):
        for most in (1, 3, 1000):
            rows = [(r.randint(0, most), r.randint(0, most)) for _ in range(n)]
            a, b = (np.array([x[k] for x in rows], float) for k in (0, 1))
            assert concordance(a, b) == plain(rows)[0]


@pytest.mark.parametrize("large, ranges", [(10**6, 64), (20, 2), (20, 7)])
def test_groups_in_ranges(spark, large, ranges):
    r = random.Random(2)
    groups = {"a": [(r.random(), r.random()) for _ in range(300)], "b": [(float(r.randint(0, 5)), float(r.randint(0, 9))) for _ in range(200)], "c": [(1.0, float(i)) for i in range(50)], "d": [(1.0, 2.0)], "e": [(1.0, 2.0), (2.0, None), (3.0, 1.0)], None: [(float(i), float(-i)) for i in range(90)], "f": [(float(i // 40), float(i)) for i in range(120)]}
    rows = [(g, i, *x) for g, xs in groups.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "g string, k long, x double, y double")
    got = {x.g: x.tau for x in kendall(df, ["g"], "k", "x", "y", large, ranges).collect()}
    want = {g: plain(xs)[1] for g, xs in groups.items() if g != "d"}
    assert got.keys() == want.keys()
    for g, tau in want.items():
        assert got[g] == tau if tau is None else got[g] == pytest.approx(tau, abs=1e-12)
    one = kendall(df.where("g = 'b'"), [], "k", "x", "y", large, ranges).first().tau
    assert one == pytest.approx(want["b"], abs=1e-12)


def test_a_group_of_a_million(spark):
    df = spark.range(1_000_000).selectExpr("1 AS g", "id", "id AS x", "CASE WHEN id % 2 = 0 THEN id ELSE -id END AS y")
    began = time.perf_counter()
    (row,) = kendall(df, ["g"], "id", "x", "y", 200_000).collect()
    # even numbers ascend, odd ones descend, and all of these are below: of each two, one rises
    assert abs(row.tau) < 1e-5 and time.perf_counter() - began < 120
