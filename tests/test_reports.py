"""Operators of terrain, land, transit and reports on hand-made tables."""

from __future__ import annotations

import math
import random
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from hillspan.operators import geo as G
from hillspan.operators import land as L
from hillspan.operators import profile as P
from hillspan.operators import reports as R
from hillspan.operators import terrain as T
from hillspan.operators import transit as X
from hillspan.plans.networks import cells
from hillspan.plans.reports import q150_fixed_selection
from hillspan.sources import tables as S

SF = "/root/testdata/sf0.001"


def test_profile_over_a_hill(spark):
    """A round hill of 50 m: a line over its top gains 50 m, one on flat ground nothing."""
    z = lambda c, r: 100 + 50 * math.exp(-(((c + 0.5 - 60) ** 2 + (r + 0.5 - 20) ** 2) / 200))
    raster = spark.createDataFrame([(c, r, z(c, r) if r < 60 else 100.0) for c in range(120) for r in range(80)], "col long, row long, z double")
    knots = spark.createDataFrame([(i, s, 2.0 + s, y) for i, y in ((0, 20.0), (1, 70.0)) for s in (0.0, 116.0)], "id long, s double, x double, y double")
    at = P.resampled(knots, ["id", "y"], "s", "x", 1.0)
    heights = G.sample(raster, at.select((F.col("id") * 1000 + F.col("k")).alias("key"), F.col("x").alias("col"), F.col("y").alias("row")), "key")
    line = P.filled(heights.select(F.floor(F.col("key") / 1000).alias("id"), (F.col("key") % 1000).alias("k"), "z"), ["id"], "k", "z")
    got = {x.id: x for x in P.gains(P.steps(line, ["id"], ["k"], ["z"]), ["id"], "d_z").collect()}
    assert got[0].up == pytest.approx(50, abs=1) and got[0].down == pytest.approx(50, abs=1) and got[1].up == got[1].down == 0


def test_voids_weigh_nothing(spark):
    r = spark.createDataFrame([(0, 0, 10.0), (1, 0, None), (0, 1, 30.0), (1, 1, None)], "col long, row long, z double")
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 1.75, 1.0), (3, 9.0, 9.0)], "id long, col double, row double")
    assert {x.id: x.z for x in T.sampled_known(r, pts, ["id"]).collect()} == {1: 20.0, 2: None, 3: None}
    assert {x.id: x.z for x in T.node_altitudes(r, pts, "id").collect()} == {1: 0.0, 2: 0.0, 3: 0.0}


def test_clipping_a_triangle(spark):
    tri = spark.createDataFrame([([(0.0, 0.0), (4.0, 0.0), (0.0, 4.0)],), ([(10.0, 10.0), (11.0, 10.0), (10.0, 11.0)],)], "ring array<struct<x:double,y:double>>")
    square = [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)]
    assert [x.a for x in tri.select(L.ring_area(L.clipped(F.col("ring"), square)).alias("a")).collect()] == [2.0, 0.0]
    assert [x.a for x in tri.select(L.ring_distance2(F.lit(-3.0), F.lit(-4.0), F.col("ring")).alias("a")).collect()][0] == 25.0


def test_stops_fall_back_to_platforms_and_straight_lines(spark):
    m = [(1, 1, "stop"), (1, 2, "stop_entry_only"), (1, 3, "platform"), (2, 4, "stop"), (2, 5, "platform"), (2, 6, "platform_exit_only"), (3, 7, "stop"), (3, 8, "")]
    got = X.stop_members(spark.createDataFrame(m, "route long, member long, role string"))
    assert sorted((r.route, r.member) for r in got.collect()) == [(1, 1), (1, 2), (2, 5), (2, 6)]
    arcs = spark.createDataFrame([(1, 10, 11, 5), (1, 11, 12, 7), (2, 10, 12, 1)], "route long, u long, v long, w long")
    pairs = spark.createDataFrame([(1, 1, 2, 10, 12, 2, 3, 9), (1, 2, 3, 12, 13, 0, 0, 4), (2, 5, 6, 12, 10, 0, 0, 1)], "route long, u long, v long, tu long, tv long, lu long, lv long, straight long")
    assert sorted((r.route, r.u, r.length, r.fallback) for r in X.tracks_between(pairs, arcs).collect()) == [(1, 1, 17, False), (1, 2, 4, True), (2, 5, 1, False)]


def test_routings_by_plan_and_terrain(spark):
    """Two ways from 0 to 2: the shorter one in plan is longer on the terrain."""
    arcs = spark.createDataFrame([("a", 0, 1, 5, 9, 4), ("a", 1, 2, 5, 9, 4), ("a", 0, 2, 11, 12, 1), ("b", 0, 2, 1, 1, 0)], "variant string, u long, v long, l2 long, l3 long, gain long")
    flows = spark.createDataFrame([(0, 2, 3, 1), (2, 0, 5, 1), (1, 1, 9, 1)], "origin long, dest long, flow long, draw long")
    got = {r.variant: r for r in X.evaluated(arcs, flows, "variant", ["draw"]).collect()}
    assert (got["a"].gain_on_2d, got["a"].l2_on_2d, got["a"].l3_on_2d) == (24, 30, 54)
    assert (got["a"].gain_on_3d, got["a"].l2_on_3d, got["a"].l3_on_3d) == (3, 33, 36) and got["b"].l2_on_2d == 3


def test_fixed_selection_equals_a_scan(spark):
    by_city = defaultdict(list)
    for r in cells(spark, SF).collect():
        by_city[r.city].append(r)
    for got in q150_fixed_selection(spark, SF).collect():
        ref = float(np.median([r.flat for r in by_city[got.city]]))
        near = [r for r in by_city[got.city] if abs(r.flat - ref) <= 0.1 * ref]
        assert got.n_comparable == len(near)

        def scan(rows, taken):
            out = []
            for r in rows:
                if len(out) < 2 and all(math.hypot(r.x - o.x, r.y - o.y) >= 150 for o in out + taken):
                    out.append(r)
            return out

        low = scan(sorted(near, key=lambda r: (r.climb, r.cell)), [])
        high = scan(sorted(near, key=lambda r: (-r.climb, r.cell)), low)
        assert got.feasible == (len(low) == len(high) == 2)
        assert got.favourable == (" ".join(str(r.cell) for r in low) if got.feasible else "") and got.unfavourable == (" ".join(str(r.cell) for r in high) if got.feasible else "")


def test_missing_rows_and_moved_nodes_fail(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.0)], "k long, x double, y double")
    with pytest.raises(Exception, match="no row of 2"):
        R.required(rows, spark.createDataFrame([(2,)], "k long"), "k").collect()
    with pytest.raises(Exception, match="not where"):
        R.near_stored(rows, rows.withColumn("x", F.lit(1e-6)), ["k"]).collect()
    with pytest.raises(Exception, match="no area"):
        L.largest_named(spark.createDataFrame([("a", [(0.0, 0.0)])], "name string, ring array<struct<x:double,y:double>>"), "name", "ring", "b").collect()


def test_a_table_that_is_there_but_broken_fails(spark, tmp_path):
    Path(tmp_path / "bad").mkdir()
    columns = S.schema(a=S._L)
    S.write_results(spark.createDataFrame([(3,)], "a long"), str(tmp_path / "good"))
    assert S.existing_or(spark, str(tmp_path / "none"), str(tmp_path / "good"), columns).collect()[0].a == 3
    assert S.existing_or(spark, str(tmp_path / "bad"), str(tmp_path / "good"), columns).collect() == []


def test_noise_in_rank_of_random_lines(spark):
    r = random.Random(4)
    rows = [(c, v, float(r.randint(90, 110)), v == 0) for c in range(4) for v in range(9)]
    df = spark.createDataFrame(rows, "city long, variant long, e double, observed boolean")
    got = {x.city: x for x in R.profile_shape(df, ["city"], "e", F.col("observed")).collect()}
    for c in range(4):
        e0 = next(e for k, v, e, o in rows if k == c and o)
        pct = 100 * (min(e for k, v, e, o in rows if k == c and not o) / e0 - 1)
        assert got[c].nearest_pct == pytest.approx(pct) and (got[c].shape == "near_flat") == (pct <= 0.2)
