"""Queries of lines, stops and routings. Routes: customers by their number modulo 30, in the order of their numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as N
from ..operators import transit as X
from .networks import ARCS, PATHS, POINTS, arcs, points
from .registry import query, table
from .relational import FLOWS, flows


@query("SELECT r AS route, u, v FROM (SELECT c_custkey % 30 AS r, c_custkey AS u, lead(c_custkey) OVER (PARTITION BY c_custkey % 30 ORDER BY c_custkey) AS v FROM customer) WHERE v IS NOT NULL")
def q115_route_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return N.route_arcs(table(spark, sf_dir, "customer").select((k % 30).alias("route"), k.alias("stop")), ["route"], "stop")


#: Members 1, 2, ... of routes: stops on most, on every fourth platforms, of which one is a stop.
_MEMBERS = "members AS (SELECT c_custkey % 30 AS route, c_custkey AS member, CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 30 % 4 = 0 AND c_custkey > 60 THEN 'platform_entry_only' WHEN c_custkey % 30 % 7 = 3 THEN 'platform' ELSE 'stop_exit_only' END AS role FROM customer)"


@query(f"""
WITH {_MEMBERS}, n AS (SELECT *, count(*) FILTER (WHERE role LIKE 'stop%') OVER (PARTITION BY route) AS s, count(*) FILTER (WHERE role LIKE 'platform%') OVER (PARTITION BY route) AS p FROM members)
SELECT route, member, role FROM n WHERE CASE WHEN s >= 2 THEN role LIKE 'stop%' WHEN p >= 2 THEN role LIKE 'platform%' ELSE false END
""")
def q116_stop_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    role = F.when(k % 5 == 0, "").when((k % 30 % 4 == 0) & (k > 60), "platform_entry_only").when(k % 30 % 7 == 3, "platform").otherwise("stop_exit_only")
    return X.stop_members(table(spark, sf_dir, "customer").select((k % 30).alias("route"), k.alias("member"), role.alias("role")))


_TRACKS = f"""
{POINTS}, st AS (SELECT id % 30 AS route, id AS stop, x, y FROM points), tr AS (SELECT route, stop AS node, x, y FROM st WHERE stop % 7 <> 0),
nr AS (SELECT s.route, s.stop, arg_min(t.node, row((s.x - t.x) * (s.x - t.x) + (s.y - t.y) * (s.y - t.y), t.node)) AS near FROM st s JOIN tr t ON s.route = t.route GROUP BY 1, 2),
onp AS (SELECT s.*, CASE WHEN s.stop % 7 <> 0 THEN s.stop ELSE near END AS track FROM st s JOIN nr ON s.route = nr.route AND s.stop = nr.stop)"""


def _stops(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stops, of which every seventh is off the track, and the track's nodes."""
    st = points(spark, sf_dir).select((F.col("id") % 30).alias("route"), F.col("id").alias("stop"), "x", "y")
    return st, st.where("stop % 7 <> 0").withColumnRenamed("stop", "node")


@query(f"WITH {_TRACKS} SELECT route, stop, track FROM onp")
def q117_on_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.on_track(*_stops(spark, sf_dir), 64.0).select("route", "stop", "track")


@query(f"""
WITH {_TRACKS}, seq AS (SELECT *, lag(node) OVER w AS p, lag(x) OVER w AS px, lag(y) OVER w AS py FROM tr WINDOW w AS (PARTITION BY route ORDER BY node)),
cum AS (SELECT route, node, x, y, sum(CASE WHEN p % 11 = 0 THEN 1 ELSE 0 END) OVER w AS piece, sum(coalesce(abs(x - px) + abs(y - py), 0)) OVER w AS at FROM seq WINDOW w AS (PARTITION BY route ORDER BY node)),
pr AS (SELECT route, stop AS u, track AS tu, x, y, lead(stop) OVER w AS v, lead(track) OVER w AS tv, lead(x) OVER w AS vx, lead(y) OVER w AS vy FROM onp WINDOW w AS (PARTITION BY route ORDER BY stop)),
j AS (SELECT pr.*, a.piece = b.piece AS joined, abs(a.at - b.at) AS w, abs(pr.x - a.x) + abs(pr.y - a.y) AS lu, abs(vx - b.x) + abs(vy - b.y) AS lv, abs(pr.x - vx) + abs(pr.y - vy) AS straight FROM pr JOIN cum a ON a.route = pr.route AND a.node = tu JOIN cum b ON b.route = pr.route AND b.node = tv WHERE v IS NOT NULL),
l AS (SELECT route, u, v, CAST(CASE WHEN joined THEN lu + w + lv ELSE straight END AS BIGINT) AS length, NOT joined AS fallback, straight FROM j)
SELECT route, u, v, length, fallback FROM l WHERE length <= 3.0 * greatest(straight, 1)
""")
def q118_stop_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks between stops that follow one another, along the route's track or straight over its gaps, without detours."""
    from pyspark.sql import Window

    stops, track = _stops(spark, sf_dir)
    at = track.select("route", F.col("node").alias("track"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    s = X.on_track(stops, track, 64.0).join(at, ["route", "track"])
    w = Window.partitionBy("route").orderBy("stop")
    apart = lambda a, b, c, d: F.abs(F.col(a) - F.col(c)) + F.abs(F.col(b) - F.col(d))
    p = s.select("route", F.col("stop").alias("u"), F.col("track").alias("tu"), "x", "y", apart("x", "y", "tx", "ty").alias("lu"), *(F.lead(c).over(w).alias(n) for c, n in (("stop", "v"), ("track", "tv"), ("x", "vx"), ("y", "vy"), ("tx", "vtx"), ("ty", "vty")))).where("v is not null")
    pairs = p.withColumn("lv", apart("vx", "vy", "vtx", "vty")).withColumn("straight", apart("x", "y", "vx", "vy")).select("route", "u", "v", "tu", "tv", "lu", "lv", "straight")
    v = Window.partitionBy("route").orderBy("node")
    ways = track.select("route", F.col("node").alias("v"), F.lag("node").over(v).alias("u"), (F.abs(F.col("x") - F.lag("x").over(v)) + F.abs(F.col("y") - F.lag("y").over(v))).alias("w")).where("u % 11 <> 0")
    return X.plausible(X.tracks_between(pairs, ways.select("route", "u", "v", "w"))).select("route", "u", "v", "length", "fallback")


def _square(columns: str, value: str, n: int, rounds: int = 5, group: str = "") -> str:
    """CTEs p0 ... p<rounds>: least structs (columns) of paths, doubled in each round. group: a column that paths stay in."""
    g, on = (f"a.{group}, ", f"a.{group} = b.{group} AND ") if group else ("", "")
    out = []
    for r in range(n, n + rounds):
        both = ", ".join(f"'{c}': a.x.{c} + b.x.{c}" for c in columns)
        out.append(f"{value}{r + 1} AS MATERIALIZED (SELECT {g}a.i, b.j, min({{{both}}}) AS x FROM {value}{r} a JOIN {value}{r} b ON {on}a.j = b.i GROUP BY ALL)")
    return ", ".join(out)


_MODES = f"{ARCS}, ma AS (SELECT u, v, CASE WHEN u % 3 = 2 THEN 3 * w ELSE w END AS w, CASE WHEN u % 3 = 0 THEN w ELSE 0 END AS m, CASE WHEN u % 3 = 1 THEN w ELSE 0 END AS t, CASE WHEN u % 3 = 0 THEN g ELSE 0 END AS c FROM arcs), p0 AS MATERIALIZED (SELECT i, j, min({{'w': w, 'm': m, 't': t, 'c': c}}) AS x FROM (SELECT u AS i, v AS j, w, m, t, c FROM ma UNION ALL SELECT DISTINCT u, u, 0, 0, 0, 0 FROM ma) GROUP BY 1, 2), " + _square("wmtc", "p", 0)


@query(f"WITH {_MODES} SELECT i, j, x.w AS w, x.m AS length_metro, x.t AS length_tram, x.c AS up_metro FROM p5")
def q119_mode_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by mode along the shortest ways; walks take their time in the search, and no energy."""
    a = arcs(spark, sf_dir).withColumn("mode", F.element_at(F.array(F.lit("metro"), F.lit("tram"), F.lit("walk")), (F.col("u") % 3 + 1).cast("int"))).withColumnsRenamed({"w": "length", "g": "up"})
    m = X.mode_arcs(a, ["metro", "tram"], ["length", "up"], F.when(F.col("mode") == "walk", 3 * F.col("length")).otherwise(F.col("length")))
    return N.shortest_paths(m.drop("up_tram"), N.nodes_of(m).withColumnRenamed("node", "i"), ["length_metro", "length_tram", "up_metro"]).select("i", "j", "w", "length_metro", "length_tram", "up_metro")


_BUS = f"{ARCS}, ba AS (SELECT u, v, greatest(CASE WHEN u % 4 = 0 THEN 0 ELSE w * 1000 END, 1) AS w, g FROM arcs), p0 AS MATERIALIZED (SELECT i, j, min({{'w': w, 'g': g}}) AS x FROM (SELECT u AS i, v AS j, w, g FROM ba UNION ALL SELECT DISTINCT u, u, 0, 0 FROM ba) GROUP BY 1, 2), " + _square("wg", "p", 0)


@query(f"WITH {_BUS} SELECT i, j, x.w AS w, x.g AS g FROM p5")
def q120_bus_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights in thousandths, of which none is 0 in the search."""
    a = arcs(spark, sf_dir)
    b = a.withColumn("w", X.least_weight(F.when(F.col("u") % 4 == 0, F.lit(0).cast("long")).otherwise(F.col("w") * 1000), 1))
    return N.shortest_paths(b, N.nodes_of(b).withColumnRenamed("node", "i"), ["g"])


@query(f"WITH {ARCS}, d AS (SELECT u, v, g AS up, (g + u) % 3 AS down FROM arcs) SELECT u, v, up, down FROM d UNION ALL SELECT v, u, down, up FROM d")
def q121_directed_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.directed_terms(arcs(spark, sf_dir).select("u", "v", F.col("g").alias("up"), ((F.col("g") + F.col("u")) % 3).alias("down")))


@query(f"""
WITH {ARCS}, {PATHS}, n AS (SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation UNION ALL SELECT CAST(r_regionkey AS BIGINT) + 25 FROM region)
SELECT x.k AS i, y.k AS j, CASE WHEN x.k = y.k THEN 0.0::DOUBLE ELSE coalesce(CAST(w AS DOUBLE), 'Infinity'::DOUBLE) END AS w FROM n x CROSS JOIN n y LEFT JOIN p5 ON i = x.k AND j = y.k
""")
def q122_distance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations, and regions as places that no way joins."""
    nations, regions = (table(spark, sf_dir, t).select(F.col(c).cast("long").alias("node")) for t, c in (("nation", "n_nationkey"), ("region", "r_regionkey")))
    n = nations.unionByName(regions.select((F.col("node") + 25).alias("node")))
    return X.dense_matrix(N.shortest_paths(arcs(spark, sf_dir).drop("g"), n.withColumnRenamed("node", "i")), n)


_BACK = f"{ARCS}, p0 AS MATERIALIZED (SELECT i, j, min({{'w': w}}) AS x FROM (SELECT u AS i, v AS j, w FROM arcs UNION ALL SELECT DISTINCT u, u, 0 FROM arcs) GROUP BY 1, 2), " + _square("w", "p", 0)


@query(f"WITH {_BACK} SELECT a.i, a.j, a.x.w AS there, b.x.w AS back FROM p5 a JOIN p5 b ON a.i = b.j AND a.j = b.i")
def q123_round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each origin there, and back to it, by searches in the network and in the reversed one."""
    a = arcs(spark, sf_dir).drop("g")
    start = N.nodes_of(a).withColumnRenamed("node", "i")
    there, back = N.shortest_paths(a, start), N.shortest_paths(N.reversed_arcs(a), start)
    return there.withColumnRenamed("w", "there").join(back.withColumnRenamed("w", "back"), ["i", "j"])


def _routing(name: str, weight: str, other: str) -> str:
    first = f"{name}0 AS MATERIALIZED (SELECT variant, i, j, min({{'w': {weight}, 'g': gain, 'o': {other}}}) AS x FROM (SELECT variant, u AS i, v AS j, {weight}, gain, {other} FROM va UNION ALL SELECT DISTINCT variant, u, u, 0, 0, 0 FROM va) GROUP BY 1, 2, 3)"
    return f"{first}, {_square('wgo', name, 0, group='variant')}"


@query(f"""
WITH {FLOWS}, {ARCS}, va AS (SELECT variant, u, v, w AS l2, w + g * variant % 5 AS l3, g * (variant + 1) AS gain FROM arcs, (VALUES (0), (1), (2)) t(variant)), {_routing("a", "l2", "l3")}, {_routing("b", "l3", "l2")},
f AS (SELECT origin, dest, draw, count(*) AS flow FROM flows WHERE origin <> dest GROUP BY 1, 2, 3),
s AS (SELECT variant, draw, sum(flow * x.g) AS gain_on_2d, sum(flow * x.w) AS l2_on_2d, sum(flow * x.o) AS l3_on_2d FROM f JOIN a5 ON origin = i AND dest = j GROUP BY 1, 2),
t AS (SELECT variant, draw, sum(flow * x.g) AS gain_on_3d, sum(flow * x.w) AS l3_on_3d, sum(flow * x.o) AS l2_on_3d FROM f JOIN b5 ON origin = i AND dest = j GROUP BY 1, 2)
SELECT s.variant, s.draw, CAST(gain_on_2d AS BIGINT) AS gain_on_2d, CAST(l2_on_2d AS BIGINT) AS l2_on_2d, CAST(l3_on_2d AS BIGINT) AS l3_on_2d, CAST(gain_on_3d AS BIGINT) AS gain_on_3d, CAST(l3_on_3d AS BIGINT) AS l3_on_3d, CAST(l2_on_3d AS BIGINT) AS l2_on_3d FROM s JOIN t ON s.variant = t.variant AND s.draw = t.draw
""")
def q124_evaluated_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every draw's flows in every variant, by the shortest way in plan and on the terrain."""
    a = arcs(spark, sf_dir).withColumn("variant", F.explode(F.array(*(F.lit(i) for i in range(3)))))
    a = a.select("variant", "u", "v", F.col("w").alias("l2"), (F.col("w") + F.col("g") * F.col("variant") % 5).alias("l3"), (F.col("g") * (F.col("variant") + 1)).alias("gain"))
    return X.evaluated(a, flows(spark, sf_dir).withColumn("flow", F.lit(1).cast("long")), "variant", ["draw"])


@query(f"""
WITH RECURSIVE {POINTS}, e AS (SELECT a.id AS u, b.id AS v FROM points a JOIN points b ON a.id <> b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 100), r(a, b) AS (SELECT id, id FROM points UNION SELECT r.a, e.v FROM r JOIN e ON r.b = e.u), c AS (SELECT a AS id, min(b) AS node FROM r GROUP BY 1),
m AS (SELECT x.node AS u, y.node AS v, min(p.id % 13 + 1) AS length FROM points p JOIN c x ON x.id = p.id JOIN c y ON y.id = p.id + 1 WHERE x.node <> y.node GROUP BY 1, 2)
SELECT m.u, m.v, length, n, px, py FROM m JOIN (SELECT node, count(*) AS n, sum(x) / CAST(count(*) AS DOUBLE) AS px, sum(y) / CAST(count(*) AS DOUBLE) AS py FROM c JOIN points ON points.id = c.id GROUP BY 1) ON node = m.u
""")
def q190_consolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crossings of several nodes as one, and the arcs between them."""
    nodes = points(spark, sf_dir).withColumnRenamed("id", "node")
    ways = nodes.select(F.col("node").alias("u"), (F.col("node") + 1).alias("v"), (F.col("node") % 13 + 1).alias("length"))
    n, a = N.consolidated(nodes, ways, 10.0)
    return a.join(n.select(F.col("node").alias("u"), "n", F.col("x").alias("px"), F.col("y").alias("py")), "u").select("u", "v", "length", "n", "px", "py")


_STREETS = "st AS (SELECT c_custkey AS a, c_custkey + 1 AS b, c_custkey % 13 + 1 AS length FROM customer WHERE c_custkey % 9 <> 0 UNION ALL SELECT c_custkey, c_custkey * 3 % 1499 + 1, 5 FROM customer WHERE c_custkey % 50 = 0), a AS (SELECT u, v, min(length) AS length FROM (SELECT a AS u, b AS v, length FROM st UNION ALL SELECT b, a, length FROM st) WHERE u <> v GROUP BY 1, 2)"


@query(f"""
WITH RECURSIVE {_STREETS}, i AS (SELECT u AS m FROM a GROUP BY 1 HAVING count(*) = 2),
w(u, p, v, length, n) AS (SELECT u, u, v, CAST(length AS BIGINT), CAST(1 AS BIGINT) FROM a WHERE u NOT IN (SELECT m FROM i) UNION ALL SELECT w.u, w.v, a.v, w.length + a.length, w.n + 1 FROM w JOIN i ON i.m = w.v JOIN a ON a.u = w.v AND a.v <> w.p)
SELECT u, v, length, n FROM w WHERE v NOT IN (SELECT m FROM i)
""")
def q191_simplified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streets without the nodes that are no crossings."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    one = c.where("c_custkey % 9 <> 0").select(k.alias("u"), (k + 1).alias("v"), (k % 13 + 1).alias("length")).unionByName(c.where("c_custkey % 50 = 0").select(k.alias("u"), (k * 3 % 1499 + 1).alias("v"), F.lit(5).alias("length")))
    return N.simplified(one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"), "length")))
