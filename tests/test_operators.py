"""Operators on hand-made tables whose results are known."""

from __future__ import annotations

import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hillspan.functions import names as N
from hillspan.operators import demand as D
from hillspan.operators import geo as G
from hillspan.operators import graph as X
from hillspan.operators import profile as P
from hillspan.operators import relational as A
from hillspan.operators import scenario as C
from hillspan.operators import selection as L
from hillspan.operators import stats as S
from hillspan.sources import tables as T


def test_variant_names(spark):
    rows = ["original", "scale_ns_1p05", "scale_ew_0p920", "scale_ns_0p80", "graph_trans_250m_a+090.pkl", "trans_100m_a+090", "rot_+10p00deg", "rot_-00p50deg", "rot_+350p00deg", "x"]
    df = spark.createDataFrame([(r,) for r in rows], "n string")
    got = df.select(N.family(df.n).alias("f"), N.parameter(df.n).alias("p"), N.in_main_ensemble(df.n).alias("keep")).collect()
    assert [r.keep for r in got] == [True, True, False, False, True, False, True, True, True, True]
    assert [r.f for r in got][:5] == ["original", "scale_ns", "scale_ew", "scale_ns", "translation_090"] and got[-1].f == "unknown"
    assert [r.p for r in got] == [0, 1.05, 0.92, 0.8, 250, 100, 10, -0.5, -10, None]
    one = spark.range(1)
    made = one.select(N.translation_name(F.lit(250), F.lit(90)), N.scale_name(F.lit("ns"), F.lit(1.05)), N.rotation_name(F.lit(-0.5)), N.direction(F.lit(-90)), N.axis(F.lit(270)), N.joined(F.array(*map(F.lit, "abc"))), N.normalised(F.lit(" Área  Ñ-1 ")))
    assert list(made.first()) == ["trans_250m_a+090", "scale_ns_1p05", "rot_-00p50deg", "south", "NS", "a, b and c", "area_n_1"]
    assert one.select(N.normalised_angles(F.array(*map(F.lit, (-190.0, 170.0, 350.0, 0.0, 180.0))))).first()[0] == [-10.0, 0.0, 170.0, 180.0]
    assert one.select(N.escaped_xml(F.lit('a<b & "c"')), N.escaped_tex(F.lit("5% a_b"))).first()[:] == ("a&lt;b &amp; &quot;c&quot;", r"5\% a\_b")


def test_angles_of_whole_turns_are_one(spark):
    df = spark.createDataFrame([([-360.0, 0.0, 720.0],), ([-720.0, 360.0, -0.0, 90.0],)], "a array<double>")
    got = [r.a for r in df.select(N.normalised_angles(df.a).alias("a")).collect()]
    assert got == [[0.0], [0.0, 90.0]]
    assert all(math.copysign(1, a[0]) == 1 for a in got)


def test_void_profiles(spark):
    z = [-9.0, -8.0, -220.0, -6.0, float("nan"), -4.0]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(z)] + [(2, i, v) for i, v in enumerate([float("nan"), -500.0, -1000.0])], "line int, s int, z double")
    out = P.filled(df.withColumn("z", F.when(P.valid(F.col("z")), F.col("z"))), ["line"], "s", "z").orderBy("line", "s").collect()
    assert [r.z for r in out] == [-9, -8, -7, -6, -5, -4, 0, 0, 0]


def test_resampled_and_gains(spark):
    knots = spark.createDataFrame([(1, 0.0, 0.0), (1, 500.0, 40.0), (1, 1000.0, 0.0), (2, 0.0, 5.0)], "line int, s double, z double")
    out = P.resampled(knots, ["line"], "s", "z", 10.0)
    one = out.where("line = 1").orderBy("k").collect()
    assert len(one) == 101 and [one[25].z, one[50].z, one[100].z] == [20, 40, 0]
    assert [r.z for r in out.where("line = 2").collect()] == [5, 5]
    g = P.gains(P.steps(out, ["line"], ["k"], ["z", "s"]), ["line"], "d_z", "d_s").where("line = 1").first()
    assert (g.up, g.down) == pytest.approx((40, 40)) and g.length == pytest.approx(2 * math.hypot(500, 40))


def test_tunnel_keeps_an_even_grade(spark):
    hill = [(i, 10.0 * i, 40.0 * math.exp(-(((i - 50) / 10) ** 2)) + 0.5 * i, not 30 <= i <= 70) for i in range(101)]
    df = spark.createDataFrame([(1, *r) for r in hill], "line int, i int, s double, z double, ground boolean")
    out = P.over_anchors(df, ["line"], "s", "z", F.col("ground")).orderBy("s").collect()
    grade = np.diff([r.anchored for r in out[29:72]])
    assert np.allclose(grade, grade[0]) and out[0].anchored == hill[0][2]


def test_polylines(spark):
    line = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (3, 4), (3, 10))))
    df = spark.range(1).select(P.polyline_length(line), P.polyline_length(F.slice(line, 1, 1)), F.element_at(P.from_u(line, F.lit(3.0), F.lit(9.0)), 1)["y"])
    assert list(df.first()) == [11, 0, 10]


def test_frames_round_trip_and_rotations_keep_distances(spark):
    r = random.Random(1)
    pts = [(i, 2.0 + r.uniform(-0.2, 0.2), 41.0 + r.uniform(-0.2, 0.2)) for i in range(30)]
    df = spark.createDataFrame(pts, "id int, lon double, lat double")
    x, y = G.to_metric(F.col("lon"), F.col("lat"), F.lit(2.0), F.lit(41.0))
    m = df.select("id", "lon", "lat", x.alias("x"), y.alias("y"))
    lon, lat = G.to_lonlat(F.col("x"), F.col("y"), F.lit(2.0), F.lit(41.0))
    for q in m.select("lon", "lat", lon.alias("a"), lat.alias("b")).collect():
        assert (q.a, q.b) == pytest.approx((q.lon, q.lat), abs=1e-9)
    c, s = math.cos(0.3), math.sin(0.3)
    turned = G.moved(m, spark.createDataFrame([(c, -s, s, c, 5.0, 7.0)], "a double, b double, c double, e double, dx double, dy double")).orderBy("id").collect()
    for p, q in zip(turned[:-1], turned[1:], strict=True):
        assert math.hypot(p.x - q.x, p.y - q.y) == pytest.approx(math.hypot(p.mx - q.mx, p.my - q.my))


def test_cells_and_rings(spark):
    pts = spark.createDataFrame([(0, 10, 10), (1, 1500, 10), (2, 999, 1000), (3, -5, 10)], "id int, x int, y int")
    i, j = G.cell_of(F.col("x"), F.col("y"), 0, 0, 1000.0)
    assert [(r[0], r[1]) for r in pts.orderBy("id").select(i, j).collect()] == [(0, 0), (1, 0), (0, 1), (-1, 0)]
    ring = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0))))
    inside = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.5, 3.0), (5.0, 1.0)], "x double, y double").select(G.in_ring(F.col("x"), F.col("y"), ring)).collect()
    assert [r[0] for r in inside] == [True, False, True, False]


def test_nearest_nodes_far_and_near(spark):
    r = random.Random(2)
    nodes = [(i, r.randint(0, 900), r.randint(0, 900)) for i in range(40)] + [(99, 100000, 5)]
    pts = [(i, r.randint(0, 1000), r.randint(0, 1000)) for i in range(200)] + [(900, 90000, 0), (901, -40000, 3)]
    got = {x.id: (x.d2, x.node) for x in G.nearest_node(spark.createDataFrame(pts, "id int, x long, y long"), spark.createDataFrame(nodes, "node int, x long, y long"), "id", 50.0).collect()}
    assert got == {i: min((float((x - a) ** 2 + (y - b) ** 2), k) for k, a, b in nodes) for i, x, y in pts}
    none = G.nearest_node(spark.createDataFrame(pts[:2], "id int, x long, y long"), spark.createDataFrame([], "node int, x long, y long"), "id", 50.0).collect()
    assert [x.node for x in none] == [None, None]


def dijkstra(arcs, s):
    best, heap = {}, [((0, 0), s)]
    while heap:
        d, u = heapq.heappop(heap)
        if u not in best:
            best[u] = d
            for a, b, w, g in arcs:
                if a == u:
                    heapq.heappush(heap, ((d[0] + w, d[1] + g), b))
    return best


def test_three_ways_to_shortest_paths_agree(spark):
    r = random.Random(3)
    arcs = [(r.randrange(20), r.randrange(20), r.randint(1, 9), r.randint(0, 3)) for _ in range(45)]
    df = spark.createDataFrame(arcs, "u long, v long, w long, g long")
    starts = spark.createDataFrame([(i,) for i in range(20)], "i long")
    want = sorted((s, j, *d) for s in range(20) for j, d in dijkstra(arcs, s).items())
    assert sorted(tuple(x) for x in X.shortest_paths(df, starts, ["g"]).collect()) == want
    assert sorted(tuple(x) for x in X.shortest_paths(df, starts, ["g"], most_arcs=1).collect()) == want


def test_largest_component(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 1), (7, 7)]
    df = spark.createDataFrame(edges, "u long, v long")
    assert sorted(tuple(x) for x in X.largest_component(df).collect()) == [(1, 2), (2, 3), (3, 1)]
    assert {x.node: x.component for x in X.strong_components(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}


def test_disaggregation(spark):
    w = spark.createDataFrame([(0, 0, 0.25), (0, 1, 0.75), (1, 2, 1.0)], "district int, cell int, w double")
    trips = spark.createDataFrame([(0, 0, 10.0), (0, 1, 30.0), (1, 1, 5.0)], "o int, d int, n double")
    got = {(r.origin, r.dest): r.flow for r in D.disaggregated(trips, w).collect()}
    assert got[0, 2] == 7.5 and got[1, 1] == 5.625 and (2, 0) not in got and sum(got.values()) == 45
    half = D.disaggregated(spark.createDataFrame([(0, 0, 8.0)], trips.schema), spark.createDataFrame([(0, 0, 0.5)], w.schema))
    assert half.first().flow == 2.0


def test_thinning_is_unbiased(spark):
    f = np.random.default_rng(0).lognormal(0, 2, 20000)
    df = spark.createDataFrame([(i, i * 31 % 997, float(x)) for i, x in enumerate(f)], "i long, j long, flow double")
    tau = D.thinning_threshold(df, 2000)
    t = tau.first().tau
    assert (f >= t).sum() + f[f < t].sum() / t == pytest.approx(2000)
    draw = F.pmod(F.xxhash64("i"), F.lit(1 << 40)) / float(1 << 40)
    kept = D.thinned(df, tau, draw).agg(F.count("*").alias("n"), F.sum("kept").alias("s")).first()
    assert abs(kept.n - 2000) < 150 and kept.s == pytest.approx(f.sum(), rel=0.05)
    assert D.thinning_threshold(df.limit(5), 10).first().tau == 0


def test_decay_is_found_again(spark):
    rng = np.random.default_rng(4)
    x, y, m = rng.uniform(0, 20000, 30), rng.uniform(0, 20000, 30), rng.uniform(100, 1000, 30)
    rows = []
    for i in range(30):
        d = np.hypot(x - x[i], y - y[i])
        p = np.where(np.arange(30) == i, 0, m * np.exp(-d / 4000.0))
        rows += [(i, j, float(m[j]), float(d[j]), float(1000 * p[j] / p.sum())) for j in range(30) if j != i]
    fit = D.fit_decay(spark.createDataFrame(rows, "i int, j int, m_j double, d double, flow double"))
    assert fit["d0"] == pytest.approx(4000, rel=1e-4) and fit["n_origins"] == 30
    flat = spark.createDataFrame([(i, j, a, d, a) for i, j, a, d, _ in rows], "i int, j int, m_j double, d double, flow double")
    with pytest.raises(ValueError):
        D.fit_decay(flat)


def test_draws_repeat_and_stay_apart(spark):
    cells = spark.createDataFrame([("a",), ("b",)], "cell string")
    a, b = (sorted(map(tuple, D.draws(cells, 3, 42).collect())) for _ in range(2))
    assert a == b and len(a) == 12 and all(0 <= r[3] < 1 and 0 <= r[4] < 1 for r in a)
    assert D.draws(cells.where("cell = 'a'"), 3, 42).subtract(D.draws(cells, 3, 42)).isEmpty()


def test_keep_first_and_last_differ(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 1, 5)], "k string, seq int, v int")
    assert sorted(r.v for r in A.keep_last(df, ["k"], [F.col("seq")]).collect()) == [5, 20]
    assert sorted(r.v for r in A.keep_first(df, ["k"], [F.col("seq")]).collect()) == [5, 10]
    with pytest.raises(Exception, match="too large"):
        A.require(df, F.col("v") < 15, "too large").collect()


def test_shares_and_energies(spark):
    split = C.shares(spark.createDataFrame([("car", 60.0), ("bus", 20.0), ("rail", 20.0)], "mode string, trips double"))
    assert {r["mode"]: r.share for r in split.collect()} == {"car": 0.6, "bus": 0.2, "rail": 0.2}
    sums = spark.createDataFrame([("v", "car", 1000.0, 10.0, 0.0)], "variant string, mode string, length double, climb double, climb_off double")
    par = spark.createDataFrame([("car", 1000.0, 500.0, 2.0, 0.5)], "mode string, mass double, lam double, occupancy double, recovery double")
    assert C.energies(sums, par, ["variant"]).first().e == (1000 * 9.81 * 0.5 * 10 + 500 * 1000) / 2
    assert {r["mode"]: r.lam for r in C.scaled(par, ["car"], 1.5).collect()} == {"car": 750.0}
    bounds = spark.createDataFrame([("a", 1.0, 0.0, 2.0)], "k string, v double, low double, high double")
    assert C.overridden(bounds, spark.createDataFrame([("a", 1.5)], "k string, v double"), ["k"], "v").first().v == 1.5
    with pytest.raises(Exception, match="outside"):
        C.overridden(bounds, spark.createDataFrame([("a", 2.5)], "k string, v double"), ["k"], "v").collect()


def test_spaced_selection(spark):
    r = random.Random(6)
    rows = [("c", i, r.uniform(0, 1000), r.uniform(0, 1000), float(r.randint(0, 60)), 1.0) for i in range(60)]
    got = L.spaced(spark.createDataFrame(rows, "city string, cell int, x double, y double, climb double, flat double"), ["city"], 3, 2, 200.0).orderBy("rank").collect()
    assert [x.kind for x in got] == ["favourable"] * 3 + ["unfavourable"] * 2
    at = {i: (x, y) for _, i, x, y, *_ in rows}
    assert all(math.dist(at[a.cell], at[b.cell]) >= got[0].distance_used for a in got for b in got if a.cell != b.cell)
    order, chosen = sorted(rows, key=lambda x: (x[4], x[1])), []
    for x in order:
        if len(chosen) < 3 and all(math.dist(x[2:4], at[c]) >= got[0].distance_used for c in chosen):
            chosen.append(x[1])
    assert [x.cell for x in got[:3]] == chosen


def test_sets_and_samples(spark):
    one = spark.range(1)
    assert one.select(S.jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3)))).first()[0] == pytest.approx(1 / 3)
    df = spark.range(10).withColumn("g", F.lit(0))
    assert sorted(r.id for r in A.evenly_spaced(df, ["g"], [F.col("id")], 4).collect()) == [0, 3, 6, 9]


def test_documents_of_maps_and_parameters(spark, tmp_path):
    (tmp_path / "osm.json").write_text('{"elements": [{"type": "node", "id": 1, "lon": 2.0, "lat": 41.0}, {"type": "way", "id": 5, "nodes": [1, 2], "tags": {"tunnel": "yes"}}, {"type": "way", "id": 6, "nodes": [2, 3], "tags": {"layer": "0"}}, {"type": "relation", "id": 9, "tags": {"route": "train"}, "members": [{"type": "way", "ref": 5, "role": ""}]}]}')
    nodes, ways, members = T.transit_parts(spark, str(tmp_path / "osm.json"))
    assert [tuple(r) for r in nodes.collect()] == [(1, 2.0, 41.0)]
    assert sorted((r.id, r.position, r.node, r.g) for r in ways.withColumn("g", T.on_terrain(F.col("tags"))).collect()) == [(5, 0, 1, False), (5, 1, 2, False), (6, 0, 2, True), (6, 1, 3, True)]
    assert members.first().member == 5
    (tmp_path / "p.json").write_text('{"modes": {"car": {"mass_kg": [1, 2, 3], "note": "x"}}}')
    assert [tuple(r) for r in T.read_parameters(spark, str(tmp_path / "p.json")).collect()] == [("car", "mass_kg", 1.0, 2.0, 3.0)]
    with pytest.raises(ValueError, match="flow"):
        T.checked(spark.createDataFrame([(1,)], "a int"), T.schema(a=T._I, flow=T._D))


def test_flows_of_text(spark):
    df = spark.createDataFrame([("a", "b", "2.5"), ("a", "c", "x"), ("b", "a", None), ("b", "a", "0"), ("a", "b", "1")], "o string, d string, n string")
    assert {(r.origin, r.dest): r.flow for r in T.summed_flows(df, df).collect()} == {("a", "b"): 7.0}


def test_numbers_of_a_whole_table(spark):
    rows = [(i * 7919 % 5003,) for i in range(5003)]
    df = spark.createDataFrame(rows, "id long").repartition(6)
    got = sorted((r.id, r.n) for r in A.numbered(df, [F.col("id")], "n").collect())
    assert got == [(i, i + 1) for i in range(5003)]
    assert sorted(r.id for r in A.evenly_spaced(df, [], [F.col("id")], 3).collect()) == [0, 2501, 5002]
    assert {(r.id, r.part) for r in A.chunked(df, [F.col("id")], 100).collect()} == {(i, i // 100) for i in range(5003)}


def test_deviations_do_not_cancel(spark):
    values = [10**9 + x for x in (1, 2, 3, 4)]
    df = spark.createDataFrame([(v,) for v in values], "v long").agg(F.count("*").alias("n"), F.sum("v").alias("a"), F.sum(F.col("v") * F.col("v")).alias("b"))
    s, p = S.exact_deviations(F.col("n"), F.col("a"), F.col("b"))
    r = df.select(s.alias("s"), p.alias("p")).first()
    assert r.s == pytest.approx(math.sqrt(5 / 3), rel=1e-12) and r.p == pytest.approx(math.sqrt(1.25), rel=1e-12)


def test_pairs_within_are_spread_over_tasks(spark):
    rng = random.Random(5)
    rows = [(k, rng.uniform(-50, 50), rng.uniform(-50, 50)) for k in range(400)] + [(400, 0.0, 0.0), (401, 0.0, 0.0), (402, 5.0, 0.0), (403, -2.5, 2.5)]
    points = spark.createDataFrame(rows, "id long, x double, y double").coalesce(1)
    got = G.pairs_within(points, "id", 5.0)
    want = {(a, b): (ax - bx) * (ax - bx) + (ay - by) * (ay - by) for a, ax, ay in rows for b, bx, by in rows if a < b and (ax - bx) * (ax - bx) + (ay - by) * (ay - by) <= 25}
    found = got.collect()
    assert {(r.a, r.b): r.d2 for r in found} == want and len(found) == len(want)
    # matches of a table of one task are not one task's
    assert got.rdd.getNumPartitions() >= 4


def test_near_groups_and_their_plans_stay_small(spark):
    rng = random.Random(6)
    rows = [(k, rng.uniform(-60, 60), rng.uniform(-60, 60)) for k in range(300)] + [(300, 200.0, 200.0), (301, 203.0, 204.0), (302, 203.0, 204.0)]
    group = {k: k for k, *_ in rows}
    for a, ax, ay in rows:
        for b, bx, by in rows:
            if (ax - bx) * (ax - bx) + (ay - by) * (ay - by) <= 25 and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {k: low if g == high else g for k, g in group.items()}
    got = G.near_groups(spark.createDataFrame(rows, "node long, x double, y double"), "node", 5.0)
    assert {r.node: r.component for r in got.collect()} == group
    line = spark.range(40).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    joined = X.connected(line)
    assert {r.component for r in joined.collect()} == {0}
    # rounds that join a table with itself must not multiply the plan's estimate
    assert int(str(joined._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1 << 60
