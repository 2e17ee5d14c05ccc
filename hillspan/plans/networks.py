"""Queries of graph, geometry, scenario and selection operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.physics import haversine, leg_energy, mode_energy
from ..operators import geo as G
from ..operators import graph as N
from ..operators import routing as R
from ..operators import scenario as C
from ..operators import selection as L
from .demand import PLACES, places
from .registry import query, table
from .relational import FLOWS, flows

#: Arcs k -> k + 1 and k -> k + 7 among the nations, with whole lengths and climbs.
ARCS = """
arcs AS (SELECT CAST(n_nationkey AS BIGINT) AS u, (CAST(n_nationkey AS BIGINT) + 1) % 25 AS v, 3 + CAST(n_nationkey AS BIGINT) % 5 AS w, CAST(n_nationkey AS BIGINT) % 4 AS g FROM nation
         UNION ALL SELECT CAST(n_nationkey AS BIGINT), (CAST(n_nationkey AS BIGINT) + 7) % 25, 11 + (CAST(n_nationkey AS BIGINT) * 3) % 7, (CAST(n_nationkey AS BIGINT) * 2) % 5 FROM nation)"""
_SQUARE = "p{1} AS MATERIALIZED (SELECT i, j, x.w AS w, x.g AS g FROM (SELECT a.i, b.j, min({{'w': a.w + b.w, 'g': a.g + b.g}}) AS x FROM p{0} a JOIN p{0} b ON a.j = b.i GROUP BY 1, 2))"
PATHS = "p0 AS MATERIALIZED (SELECT i, j, x.w AS w, x.g AS g FROM (SELECT u AS i, v AS j, min({'w': w, 'g': g}) AS x FROM (SELECT * FROM arcs UNION ALL SELECT DISTINCT u, u, 0, 0 FROM arcs) GROUP BY 1, 2)), " + ", ".join(_SQUARE.format(n, n + 1).replace("{{", "{").replace("}}", "}") for n in range(5))


def arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    a = n.select(k.alias("u"), ((k + 1) % 25).alias("v"), (3 + k % 5).alias("w"), (k % 4).alias("g"))
    return a.unionByName(n.select(k.alias("u"), ((k + 7) % 25).alias("v"), (11 + k * 3 % 7).alias("w"), (k * 2 % 5).alias("g")))


@query(f"WITH {ARCS}, {PATHS} SELECT i, j, w FROM p5")
def q39_sssp(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = arcs(spark, sf_dir)
    return N.shortest_paths(a.drop("g"), a.select(F.col("u").alias("i")))


@query(f"WITH {ARCS}, {PATHS} SELECT i, j, w, g FROM p5")
def q40_path_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = arcs(spark, sf_dir)
    return N.shortest_paths(a, N.nodes_of(a).withColumnRenamed("node", "i"), ["g"])


@query(f"WITH {ARCS}, {PATHS} SELECT i, j, w, g FROM p5")
def q40b_paths_by_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = arcs(spark, sf_dir)
    return N.all_from(a, N.nodes_of(a).withColumnRenamed("node", "i"), ["g"])


@query(f"""
WITH {FLOWS}, {ARCS}, {PATHS}, f AS (SELECT origin, dest, draw, count(*) AS flow FROM flows WHERE origin <> dest GROUP BY 1, 2, 3)
SELECT draw, CAST(sum(flow) AS BIGINT) AS flow, CAST(sum(flow * w) AS BIGINT) AS f_w, CAST(sum(flow * g) AS BIGINT) AS f_g, CAST(0 AS BIGINT) AS n_unrouted, 1200 * 9.81::DOUBLE * CAST(sum(flow * g) AS DOUBLE) + 585.0::DOUBLE * CAST(sum(flow * w) AS DOUBLE) AS energy
FROM f JOIN p5 ON origin = i AND dest = j GROUP BY draw
""")
def q41_od_routing_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = flows(spark, sf_dir).groupBy("origin", "dest", "draw").agg(F.count("*").alias("flow"))
    paths = R.paths_between(arcs(spark, sf_dir), f.select(F.col("origin").alias("i"), F.col("dest").alias("j")), ["g"])
    t = N.path_totals(f, paths, ["draw"], ["w", "g"])
    return t.withColumn("energy", F.lit(1200 * 9.81) * F.col("f_g").cast("double") + F.lit(585.0) * F.col("f_w").cast("double"))


#: Streets among the orders that have items: from each to the next one and to the one a block of STREET on, both ways, the way back with another climb.
STREET = 387
_STREET_ARCS = f"""
node AS (SELECT l_orderkey AS k, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q, count(*) AS n FROM lineitem GROUP BY 1),
way AS (SELECT k AS u, k + 1 AS v, 20 + q AS w, n % 4 AS g, q % 5 AS h FROM node WHERE k % 11 <> 0 UNION ALL SELECT k, k + {STREET}, 35 + q % 90, q % 7, n % 3 FROM node),
street AS (SELECT u, v, w, g, h FROM way WHERE v IN (SELECT k FROM node)),
arc AS (SELECT u, v, w, g FROM street UNION ALL SELECT v, u, w, h FROM street)"""
_TRIPS = """
home AS (SELECT o_custkey AS c, min(o_orderkey) AS i FROM orders GROUP BY 1),
hub AS (SELECT c_nationkey AS nation, min(i) AS j FROM home JOIN customer ON c = c_custkey GROUP BY 1),
trip AS (SELECT c_nationkey AS nation, c_custkey AS customer, i, j FROM home JOIN customer ON c = c_custkey JOIN hub ON nation = c_nationkey)"""


def street_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("q")
    node = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum(F.col("l_quantity").cast("long")).alias("q"), F.count("*").alias("n"))
    ends = node.select(F.col("k").alias("v"))
    way = F.array(F.struct((F.col("k") + 1).alias("v"), (20 + q).alias("w"), (F.col("n") % 4).alias("g"), (q % 5).alias("h")), F.struct((F.col("k") + STREET).alias("v"), (35 + q % 90).alias("w"), (q % 7).alias("g"), (F.col("n") % 3).alias("h")))
    street = node.select(F.col("k").alias("u"), F.explode(way).alias("x")).select("u", "x.*").where(f"u % 11 <> 0 OR v = u + {STREET}").join(ends, "v", "left_semi")
    both = F.array(F.struct("u", "v", "w", "g"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"), "w", F.col("h").alias("g")))
    return street.select(F.explode(both).alias("x")).select("x.*")


def hub_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation, customer, i and j: every customer's way from the first order's node to the least one of the nation."""
    home = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("customer")).agg(F.min("o_orderkey").alias("i"))
    at = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer"), F.col("c_nationkey").alias("nation")).join(home, "customer")
    return at.join(at.groupBy("nation").agg(F.min("i").alias("j")), "nation").select("nation", "customer", "i", "j")


_HUBS = f"""
WITH RECURSIVE {_STREET_ARCS}, {_TRIPS},
r(j, i, x) USING KEY (j, i) AS (SELECT j, j, {{'w': 0::BIGINT, 'g': 0::BIGINT}} FROM (SELECT DISTINCT j FROM hub)
  UNION (SELECT n.j, n.u, n.x FROM (SELECT r.j, a.u, min({{'w': r.x.w + a.w, 'g': r.x.g + a.g}}) AS x FROM r JOIN arc a ON a.v = r.i GROUP BY r.j, a.u) n LEFT JOIN recurring.r k ON k.j = n.j AND k.i = n.u WHERE k.x IS NULL OR n.x < k.x))
"""


@query(f"{_HUBS} SELECT nation, customer, x.w AS w, x.g AS g FROM trip JOIN r ON r.j = trip.j AND r.i = trip.i")
def q193_street_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's shortest way on a street network of all orders, with its climb, by searches towards the target."""
    trips = hub_trips(spark, sf_dir)
    return trips.join(R.paths_between(street_arcs(spark, sf_dir), trips, ["g"]), ["i", "j"]).select("nation", "customer", "w", "g")


_PARALLEL = "par AS (SELECT l_suppkey % 25 AS u, l_partkey % 25 AS v, l_quantity AS length, l_extendedprice AS weight, l_orderkey * 100000 + l_partkey AS id FROM lineitem)"


@query(f"""
WITH {_PARALLEL}, a AS (SELECT u, v, min({{'k': length, 'i': id, 'o': weight}}) AS x FROM par GROUP BY 1, 2), b AS (SELECT u, v, min({{'k': weight, 'i': id, 'o': length}}) AS x FROM par GROUP BY 1, 2)
SELECT a.u, a.v, a.x.k AS shortest, a.x.o AS weight_of_shortest, b.x.k AS lightest, b.x.o AS length_of_lightest FROM a JOIN b ON a.u = b.u AND a.v = b.v
""")
def q42_arc_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    par = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 25).alias("u"), (F.col("l_partkey") % 25).alias("v"), F.col("l_quantity").alias("length"), F.col("l_extendedprice").alias("weight"), (F.col("l_orderkey") * 100000 + F.col("l_partkey")).alias("id"))
    a = N.representative_arcs(par, ["length", "id", "weight"]).select("u", "v", F.col("length").alias("shortest"), F.col("weight").alias("weight_of_shortest"))
    b = N.representative_arcs(par, ["weight", "id", "length"]).select("u", "v", F.col("weight").alias("lightest"), F.col("length").alias("length_of_lightest"))
    return a.join(b, ["u", "v"])


#: Customers as points: whole coordinates of their number.
POINTS = "points AS (SELECT c_custkey AS id, (c_custkey * 7919) % 1009 AS x, (c_custkey * 104729) % 997 AS y FROM customer)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), (k * 7919 % 1009).alias("x"), (k * 104729 % 997).alias("y"))


@query(f"WITH {POINTS} SELECT a.id AS a, b.id AS b, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM points a JOIN points b ON a.id < b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 400")
def q43_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.pairs_within(points(spark, sf_dir), "id", 20.0)


@query(f"""
WITH {POINTS}, {PLACES}, d AS (SELECT id, k, CAST((p.x - q.x * 10) * (p.x - q.x * 10) + (p.y - q.y * 10) * (p.y - q.y * 10) AS DOUBLE) AS d2 FROM points p, places q)
SELECT id, arg_min(k, row(d2, k)) AS node, min(d2) AS d2 FROM d GROUP BY id
""")
def q44_nearest_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = places(spark, sf_dir).select(F.col("k").alias("node"), (F.col("x") * 10).alias("x"), (F.col("y") * 10).alias("y"))
    return G.nearest_node(points(spark, sf_dir), nodes, "id", 120.0).select("id", "node", "d2")


@query(f"WITH {POINTS}, cells AS (SELECT i, j, i || '_' || j AS cell FROM (SELECT unnest(generate_series(0, 9)) AS i), (SELECT unnest(generate_series(0, 8)) AS j) WHERE (i + j) % 5 <> 0) SELECT id, cell FROM points LEFT JOIN cells ON CAST(floor(x / 100.0) AS BIGINT) = i AND CAST(floor(y / 100.0) AS BIGINT) = j")
def q45_cell_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = spark.range(90).select((F.col("id") % 10).alias("i"), F.floor(F.col("id") / 10).alias("j")).where("(i + j) % 5 <> 0").withColumn("cell", F.concat_ws("_", "i", "j"))
    i, j = G.cell_of(F.col("x"), F.col("y"), 0, 0, 100.0)
    return points(spark, sf_dir).withColumns({"i": i, "j": j}).join(cells, ["i", "j"], "left").select("id", "cell")


@query(f"WITH {POINTS}, {PLACES} SELECT id, k AS box FROM points p JOIN places q ON p.x BETWEEN q.x * 10 - 30 AND q.x * 10 + 50 AND p.y BETWEEN q.y * 10 - 20 AND q.y * 10 + 40")
def q46_box_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("x") * 10, F.col("y") * 10
    boxes = places(spark, sf_dir).select(F.col("k").alias("box"), (x - 30).alias("x_min"), (x + 50).alias("x_max"), (y - 20).alias("y_min"), (y + 40).alias("y_max"))
    return G.in_boxes(points(spark, sf_dir), boxes, 100.0).select("id", "box")


#: Rigid motions with rational sines, a scaling of each axis and translations: name, matrix, offset.
_MOTIONS = [("original", 1.0, 0.0, 0.0, 1.0, 0.0, 0.0), ("rot_a", 0.6, -0.8, 0.8, 0.6, 0.0, 0.0), ("rot_b", 0.8, 0.6, -0.6, 0.8, 0.0, 0.0), ("scale_ew", 1.05, 0.0, 0.0, 1.0, 0.0, 0.0), ("scale_ns", 1.0, 0.0, 0.0, 0.95, 0.0, 0.0), *((f"trans_{d}_{n}", 1.0, 0.0, 0.0, 1.0, d * sx, d * sy) for d in (5.0, 10.0, 20.0) for n, sx, sy in (("e", 1.0, 0.0), ("n", 0.0, 1.0), ("w", -1.0, 0.0), ("s", 0.0, -1.0)))]
_MOTION_SQL = "motions(variant, a, b, c, e, dx, dy) AS (VALUES " + ", ".join(f"('{m[0]}', " + ", ".join(f"{x!r}::DOUBLE" for x in m[1:]) + ")" for m in _MOTIONS) + ")"


def motions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_MOTIONS, "variant string, a double, b double, c double, e double, dx double, dy double")


@query(f"WITH {PLACES}, {_MOTION_SQL} SELECT variant, k, a * (x - 50) + b * (y - 44) + dx AS mx, c * (x - 50) + e * (y - 44) + dy AS my FROM places, motions")
def q47_affine_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    centred = places(spark, sf_dir).select("k", (F.col("x") - 50).alias("x"), (F.col("y") - 44).alias("y"))
    return G.moved(centred, motions(spark)).select("variant", "k", "mx", "my")


#: A ring around the middle of the places, not convex.
_RING = [(-48.0, -40.0), (40.0, -42.0), (46.0, 5.0), (10.0, 12.0), (30.0, 40.0), (-45.0, 38.0), (-20.0, 0.0)]
_RING_SQL = "ring(i, ax, ay, bx, b_y) AS (VALUES " + ", ".join(f"({i}, {p[0]!r}::DOUBLE, {p[1]!r}::DOUBLE, {q[0]!r}::DOUBLE, {q[1]!r}::DOUBLE)" for i, (p, q) in enumerate(zip(_RING, _RING[1:] + _RING[:1], strict=True))) + ")"
_MOVED = "moved AS (SELECT variant, k, a * (x - 50) + b * (y - 44) + dx AS mx, c * (x - 50) + e * (y - 44) + dy AS my FROM places, motions), inside AS (SELECT variant, k, count(*) FILTER (WHERE (ay > my) <> (b_y > my) AND mx < (bx - ax) * (my - ay) / nullif(b_y - ay, 0) + ax) % 2 = 1 AS inside FROM moved, ring GROUP BY 1, 2)"


def ring() -> F.Column:
    return F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in _RING))


@query(f"WITH {PLACES}, {_MOTION_SQL}, {_RING_SQL}, {_MOVED} SELECT k, inside FROM inside WHERE variant = 'original'")
def q48_point_in_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(spark, sf_dir).select("k", G.in_ring((F.col("x") - 50).cast("double"), (F.col("y") - 44).cast("double"), ring()).alias("inside"))


@query(f"""
WITH {PLACES}, r AS (SELECT k, radians(x / 10.0::DOUBLE) AS lon, radians(y / 10.0::DOUBLE) AS lat FROM places)
SELECT a.k AS i, b.k AS j, CAST(floor(12742000.0::DOUBLE * asin(sqrt(pow(sin((b.lat - a.lat) / 2), 2) + cos(a.lat) * cos(b.lat) * pow(sin((b.lon - a.lon) / 2), 2))) * 100) AS BIGINT) AS centimetres FROM r a JOIN r b ON a.k < b.k
""")
def q49_haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    lonlat = lambda s: places(spark, sf_dir).select(F.col("k").alias(s), (F.col("x") / 10.0).alias(f"lon_{s}"), (F.col("y") / 10.0).alias(f"lat_{s}"))
    d = haversine(F.col("lon_i"), F.col("lat_i"), F.col("lon_j"), F.col("lat_j"))
    return lonlat("i").join(lonlat("j"), F.col("i") < F.col("j")).select("i", "j", F.floor(d * 100).alias("centimetres"))


@query(f"""
WITH {PLACES}, {_MOTION_SQL}, {_RING_SQL}, {_MOVED}, c AS (SELECT variant, count(*) FILTER (WHERE NOT m.inside) AS outside FROM inside m JOIN (SELECT k FROM inside WHERE variant = 'original' AND inside) o ON m.k = o.k GROUP BY 1)
SELECT string_split(variant, '_')[1] AS family, count(*) AS n, min(outside) AS least, arg_min(variant, row(outside, variant)) AS best, count(*) FILTER (WHERE outside = 0) AS n_admissible FROM c GROUP BY 1
""")
def q50_audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    centred = places(spark, sf_dir).select("k", (F.col("x") - 50).cast("double").alias("x"), (F.col("y") - 44).cast("double").alias("y"))
    on_land = centred.where(G.in_ring(F.col("x"), F.col("y"), ring()))
    outside = G.moved(on_land, motions(spark)).groupBy("variant").agg(F.count_if(~G.in_ring(F.col("mx"), F.col("my"), ring())).alias("outside"))
    return outside.groupBy(F.split("variant", "_")[0].alias("family")).agg(F.count("*").alias("n"), F.min("outside").alias("least"), F.min_by("variant", F.struct("outside", "variant")).alias("best"), F.count_if(F.col("outside") == 0).alias("n_admissible"))


CELLS = "cells AS (SELECT p_partkey AS cell, (p_partkey * 37) % 1013 AS x, (p_partkey * 53) % 887 AS y, p_size * 100 + p_partkey % 100 AS pop, (p_partkey * 31) % 607 AS climb, 1000 + (p_partkey * 17) % 401 AS flat, p_type AS city FROM part)"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("cell"), (k * 37 % 1013).alias("x"), (k * 53 % 887).alias("y"), (F.col("p_size") * 100 + k % 100).alias("pop"), (k * 31 % 607).alias("climb"), (1000 + k * 17 % 401).alias("flat"), F.col("p_type").alias("city"))


@query(f"""
WITH {CELLS}, s AS (SELECT sum(pop * x) / CAST(sum(pop) AS DOUBLE) AS cx, sum(pop * y) / CAST(sum(pop) AS DOUBLE) AS cy FROM cells), c AS (SELECT cell, pop, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS d FROM cells, s),
q AS (SELECT quantile_cont(pop, 0.65) AS qp, quantile_cont(d, 0.5) AS qh, quantile_cont(d, 0.75) AS qo FROM c),
u AS ((SELECT cell, pop FROM c, q WHERE pop >= qp ORDER BY pop DESC, cell LIMIT 60) UNION (SELECT cell, pop FROM c, q WHERE d <= qh ORDER BY pop DESC, cell LIMIT 30) UNION (SELECT cell, pop FROM c, q WHERE d >= qo ORDER BY pop DESC, cell LIMIT 30))
SELECT cell, pop FROM u ORDER BY pop DESC, cell LIMIT 120
""")
def q51_candidate_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.candidates(cells(spark, sf_dir), 120).select("cell", "pop")


def scans(n_low: int, n_high: int, distance: float) -> str:
    """CTEs la and lb: of the table c (city, cell, x, y, climb) and the table rel (r: relaxations) the cells p that a scan in order picks, cheapest first and then dearest first, each far enough from all before."""
    cell = "STRUCT(cell BIGINT, x BIGINT, y BIGINT, climb BIGINT)[]"
    near = "len(list_filter({held}, lambda q: sqrt(CAST((q.x - o.x) * (q.x - o.x) + (q.y - o.y) * (q.y - o.y) AS DOUBLE)) < {d} * s.r)) = 0"
    step = "CASE WHEN len(s.p) < {n} AND (s.r = 0 OR " + near + ") THEN list_append(s.p, {{'cell': o.cell, 'x': o.x, 'y': o.y, 'climb': o.climb}}) ELSE s.p END"
    return f"""
lo AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY climb, cell) AS i FROM c), hi AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY climb DESC, cell) AS i FROM c), sz AS (SELECT city, count(*) AS n FROM c GROUP BY 1),
sa(city, r, i, p) AS (SELECT city, r, CAST(0 AS BIGINT), CAST([] AS {cell}) FROM sz, rel UNION ALL SELECT s.city, s.r, s.i + 1, {step.format(n=n_low, held="s.p", d=f"{distance!r}::DOUBLE")} FROM sa s JOIN lo o ON o.city = s.city AND o.i = s.i + 1),
la AS (SELECT sa.city, r, p FROM sa JOIN sz ON sz.city = sa.city AND i = n),
sb(city, r, i, h, p) AS (SELECT city, r, CAST(0 AS BIGINT), p, CAST([] AS {cell}) FROM la UNION ALL SELECT s.city, s.r, s.i + 1, s.h, {step.format(n=n_high, held="list_concat(s.h, s.p)", d=f"{distance!r}::DOUBLE")} FROM sb s JOIN hi o ON o.city = s.city AND o.i = s.i + 1),
lb AS (SELECT sb.city, r, p FROM sb JOIN sz ON sz.city = sb.city AND i = n)"""


_TOLERANCES = (0.05, 0.1, 0.15, 0.2, 0.3)


@query(f"""
WITH RECURSIVE {CELLS}, m AS (SELECT *, median(flat) OVER (PARTITION BY city) AS m FROM cells), k AS (SELECT *, {", ".join(f"count(*) FILTER (WHERE flat BETWEEN m * (1 - {t}::DOUBLE) AND m * (1 + {t}::DOUBLE)) OVER (PARTITION BY city) AS n{i}" for i, t in enumerate(_TOLERANCES))} FROM m),
t AS (SELECT *, CASE {" ".join(f"WHEN n{i} >= 20 THEN {t}::DOUBLE" for i, t in enumerate(_TOLERANCES))} END AS tolerance FROM k), c AS (SELECT city, CAST(cell AS BIGINT) AS cell, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(climb AS BIGINT) AS climb FROM t WHERE tolerance IS NULL OR flat BETWEEN m * (1 - tolerance) AND m * (1 + tolerance)),
rel(r) AS (VALUES (1.0::DOUBLE), (0.75), (0.5), (0.25), (0.0)), {scans(3, 2, 300.0)},
ok AS (SELECT la.city, max(la.r) AS r FROM la JOIN lb ON la.city = lb.city AND la.r = lb.r WHERE len(la.p) = 3 AND len(lb.p) = 2 GROUP BY 1),
u AS (SELECT la.city, la.r, 'favourable' AS kind, unnest(la.p) AS q FROM la JOIN ok ON ok.city = la.city AND ok.r = la.r UNION ALL SELECT lb.city, lb.r, 'unfavourable', unnest(lb.p) FROM lb JOIN ok ON ok.city = lb.city AND ok.r = lb.r)
SELECT city, q.cell AS cell, kind, row_number() OVER (PARTITION BY city ORDER BY q.climb, q.cell) AS rank, 300.0::DOUBLE * r AS distance_used FROM u
""")
def q52_spaced_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan in order; tests hold it against plain Python as well."""
    close = L.comparable(cells(spark, sf_dir), ["city"], [0.05, 0.1, 0.15, 0.2, 0.3], 20)
    return L.spaced(close, ["city"], 3, 2, 300.0)


@query(f"""
WITH {CELLS}, r AS (SELECT *, median(flat) OVER (PARTITION BY city) AS m FROM cells),
n AS (SELECT *, count(*) FILTER (WHERE flat BETWEEN m * (1 - 0.05::DOUBLE) AND m * (1 + 0.05::DOUBLE)) OVER (PARTITION BY city) AS n5, count(*) FILTER (WHERE flat BETWEEN m * (1 - 0.1::DOUBLE) AND m * (1 + 0.1::DOUBLE)) OVER (PARTITION BY city) AS n10 FROM r),
t AS (SELECT *, CASE WHEN n5 >= 90 THEN 0.05::DOUBLE WHEN n10 >= 90 THEN 0.1::DOUBLE END AS tolerance FROM n)
SELECT city, cell, tolerance FROM t WHERE tolerance IS NULL OR flat BETWEEN m * (1 - tolerance) AND m * (1 + tolerance)
""")
def q52b_comparable_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.comparable(cells(spark, sf_dir), ["city"], [0.05, 0.1], 90).select("city", "cell", "tolerance")


_LEGS = """
od AS (SELECT DISTINCT origin, dest FROM flows),
rail AS (SELECT origin, dest, CAST(origin * 3 + dest AS DOUBLE) AS length, (origin * 7 + dest * 3) % 40 AS access FROM od WHERE (origin + dest) % 3 <> 0), bus AS (SELECT origin, dest, CAST(origin + dest * 2 AS DOUBLE) AS length, (origin * 5 + dest) % 30 AS access FROM od WHERE (origin + dest) % 4 <> 1),
road AS (SELECT origin, dest, CAST(abs(origin - dest) * 5 AS DOUBLE) AS length, 0 AS access FROM od)"""


@query(f"""
WITH {FLOWS}, {_LEGS} SELECT origin, dest, t AS threshold, CASE WHEN r.access <= t THEN 'rail' WHEN b.access <= t THEN 'bus' ELSE 'road' END AS mode, CASE WHEN r.access <= t THEN r.length WHEN b.access <= t THEN b.length ELSE d.length END AS length
FROM od LEFT JOIN rail r USING (origin, dest) LEFT JOIN bus b USING (origin, dest) JOIN road d USING (origin, dest), (VALUES (10), (15), (25)) x(t)
""")
def q53_leg_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, d = F.col("origin"), F.col("dest")
    od = flows(spark, sf_dir).select("origin", "dest").distinct()
    legs = [("rail", od.where((o + d) % 3 != 0).select(o, d, (o * 3 + d).alias("length"), ((o * 7 + d * 3) % 40).alias("access")), "access"), ("bus", od.where((o + d) % 4 != 1).select(o, d, (o + d * 2).alias("length"), ((o * 5 + d) % 30).alias("access")), "access"), ("road", od.select(o, d, (F.abs(o - d) * 5).alias("length"), F.lit(0).alias("access")), "access")]
    asked = od.withColumn("threshold", F.explode(F.array(F.lit(10), F.lit(15), F.lit(25))))
    return C.with_fallback(asked, legs, F.col("threshold"))


#: mode, mass, lam, occupancy, recovery as low, central, high.
_BOXES = {"car": ((1000, 1200, 1500), (500, 585, 700), (1.1, 1.3, 1.6), (0.0, 0.0, 0.1)), "bus": ((9000, 12000, 15000), (3000, 4000, 6000), (8.0, 15.0, 30.0), (0.0, 0.1, 0.3)), "rail": ((90000, 120000, 160000), (9000, 12000, 20000), (60.0, 120.0, 200.0), (0.1, 0.3, 0.5))}
_CENTRAL_SQL = "central(mode, mass, lam, occupancy, recovery) AS (VALUES " + ", ".join(f"('{m}', " + ", ".join(f"{float(b[1])!r}::DOUBLE" for b in box) + ")" for m, box in _BOXES.items()) + ")"
_SUMS = "sums AS (SELECT p_brand AS variant, ['car', 'bus', 'rail'][p_partkey % 3 + 1] AS mode, CAST(sum(p_size * 10) AS DOUBLE) AS length, CAST(sum(p_size % 9) AS DOUBLE) AS climb, CAST(sum(p_size % 3) AS DOUBLE) AS climb_off FROM part GROUP BY 1, 2)"


def sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.element_at(F.array(F.lit("car"), F.lit("bus"), F.lit("rail")), (F.col("p_partkey") % 3 + 1).cast("int"))
    total = lambda x: F.sum(x).cast("double")
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("variant"), mode.alias("mode")).agg(total(F.col("p_size") * 10).alias("length"), total(F.col("p_size") % 9).alias("climb"), total(F.col("p_size") % 3).alias("climb_off"))


def central(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, *(float(b[1]) for b in box)) for m, box in _BOXES.items()], "mode string, mass double, lam double, occupancy double, recovery double")


@query(f"""
WITH {_SUMS}, {_CENTRAL_SQL} SELECT variant, s.mode, (mass * 9.81::DOUBLE * (1.0::DOUBLE - recovery) * climb + lam * length) / occupancy AS round_trip, (mass * 9.81::DOUBLE * (climb - recovery * climb_off) + lam * length) / occupancy AS one_way FROM sums s JOIN central c ON s.mode = c.mode
""")
def q23_mode_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = sums(spark, sf_dir).join(central(spark), "mode")
    c = F.col
    return j.select("variant", "mode", mode_energy(c("mass"), c("recovery"), c("lam"), c("occupancy"), c("length"), c("climb")).alias("round_trip"), leg_energy(c("mass"), c("recovery"), c("lam"), c("occupancy"), c("length"), c("climb"), c("climb_off")).alias("one_way"))


@query(f"""
WITH {_SUMS}, {_CENTRAL_SQL}, t(mode, trips) AS (VALUES ('car', 600), ('bus', 200), ('rail', 200), ('walk', 0)), sh AS (SELECT mode, trips / CAST(sum(trips) OVER () AS DOUBLE) AS share FROM t), f(f) AS (VALUES (0.5::DOUBLE), (1.0::DOUBLE), (2.0::DOUBLE)),
e AS (SELECT variant, f, s.mode, (mass * 9.81::DOUBLE * (1.0::DOUBLE - recovery) * (climb + (f - 1.0::DOUBLE) * climb_off) + lam * length) / occupancy AS e FROM sums s JOIN central c ON s.mode = c.mode, f)
SELECT variant, f AS tunnel_factor, CAST(floor(sum(e * share) * 1000) AS BIGINT) AS e_thousandths FROM e JOIN sh ON e.mode = sh.mode GROUP BY 1, 2
""")
def q24_mixed_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = C.shares(spark.createDataFrame([("car", 600), ("bus", 200), ("rail", 200), ("walk", 0)], "mode string, trips long"))
    cases = sums(spark, sf_dir).withColumn("tunnel_factor", F.explode(F.array(F.lit(0.5), F.lit(1.0), F.lit(2.0))))
    e = C.energies(cases, central(spark), ["variant", "tunnel_factor"], F.col("tunnel_factor"))
    return C.mixed(e, split, ["variant", "tunnel_factor"]).select("variant", "tunnel_factor", F.floor(F.col("e") * 1000).alias("e_thousandths"))


_NUMBERED = [(3 * i + j, m, p, float(box[k][0]), float(box[k][2])) for i, (m, box) in enumerate(_BOXES.items()) for j, (p, k) in enumerate((("mass", 0), ("lam", 1), ("occupancy", 2)))] + [(9 + i, m, "recovery", float(box[3][0]), float(box[3][2])) for i, (m, box) in enumerate(_BOXES.items())]


@query(f"""
WITH {_SUMS}, b(number, mode, parameter, low, high) AS (VALUES {", ".join(f"({n}, '{m}', '{p}', {lo!r}::DOUBLE, {hi!r}::DOUBLE)" for n, m, p, lo, hi in _NUMBERED)}),
v AS (SELECT draw, mode, parameter, low + (high - low) * (((draw * 104729 + number * 7919 + 7) * 1103515245 + 12345) % 2147483648 / 2147483648.0::DOUBLE) AS value FROM b, (SELECT unnest(generate_series(0, 199)) AS draw)),
p AS (SELECT draw, mode, max(value) FILTER (WHERE parameter = 'mass') AS mass, max(value) FILTER (WHERE parameter = 'lam') AS lam, max(value) FILTER (WHERE parameter = 'occupancy') AS occupancy, max(value) FILTER (WHERE parameter = 'recovery') AS recovery FROM v GROUP BY 1, 2),
e AS (SELECT draw, variant, s.mode, (mass * 9.81::DOUBLE * (1.0::DOUBLE - recovery) * (climb + (1.0::DOUBLE - 1.0::DOUBLE) * climb_off) + lam * length) / occupancy AS e FROM sums s JOIN p ON s.mode = p.mode),
m AS (SELECT draw, mode, min(e) AS least FROM e GROUP BY 1, 2)
SELECT variant, e.mode, count(*) AS n, count(*) FILTER (WHERE e = least) AS n_least, CAST(floor(min(e) * 1000) AS BIGINT) AS lowest, CAST(floor(max(e) * 1000) AS BIGINT) AS highest FROM e JOIN m ON e.draw = m.draw AND e.mode = m.mode GROUP BY 1, 2
""")
def q54_monte_carlo(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    drawn = C.wide(C.drawn(spark.createDataFrame(_NUMBERED, "number long, mode string, parameter string, low double, high double"), 200, 7))
    e = C.energies(sums(spark, sf_dir), drawn, ["draw", "variant"])
    least = e.withColumn("least", F.min("e").over(Window.partitionBy("draw", "mode")))
    return least.groupBy("variant", "mode").agg(F.count("*").alias("n"), F.count_if(F.col("e") == F.col("least")).alias("n_least"), F.floor(F.min("e") * 1000).alias("lowest"), F.floor(F.max("e") * 1000).alias("highest"))


@query("""
WITH p AS (SELECT p_type AS g, CAST(p_size AS BIGINT) AS x, p_partkey % 41 AS y, 3 * CAST(p_size AS BIGINT) - 2 * (p_partkey % 41) + p_partkey % 5 AS t FROM part),
s AS (SELECT g, CAST(count(*) AS DOUBLE) AS n, CAST(sum(x) AS DOUBLE) AS sx, CAST(sum(y) AS DOUBLE) AS sy, CAST(sum(t) AS DOUBLE) AS st, CAST(sum(x * x) AS DOUBLE) AS sxx, CAST(sum(y * y) AS DOUBLE) AS syy, CAST(sum(x * y) AS DOUBLE) AS sxy, CAST(sum(x * t) AS DOUBLE) AS sxt, CAST(sum(y * t) AS DOUBLE) AS syt FROM p GROUP BY g),
c AS (SELECT *, sxx - sx * sx / n AS xx, syy - sy * sy / n AS yy, sxy - sx * sy / n AS xy, sxt - sx * st / n AS xt, syt - sy * st / n AS yt FROM s),
f AS (SELECT *, (xt * yy - yt * xy) / nullif(xx * yy - xy * xy, 0) AS a, (yt * xx - xt * xy) / nullif(xx * yy - xy * xy, 0) AS b FROM c)
SELECT g, a, b, (st - a * sx - b * sy) / n AS c FROM f
""")
def q64_affine_lsq(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("p_size").cast("long"), F.col("p_partkey") % 41
    return G.affine_fit(table(spark, sf_dir, "part").select(F.col("p_type").alias("g"), x.alias("x"), y.alias("y"), (3 * x - 2 * y + F.col("p_partkey") % 5).alias("t")), ["g"])


_SCC = "e AS (SELECT DISTINCT u, v FROM (SELECT l_suppkey % 97 AS u, l_partkey % 97 AS v FROM lineitem UNION ALL SELECT CAST(n_nationkey AS BIGINT), CAST(n_nationkey AS BIGINT) * 2 FROM nation) WHERE u <> v)"


@query(f"""
WITH RECURSIVE {_SCC}, n AS (SELECT u AS k FROM e UNION SELECT v FROM e), r(a, b) AS (SELECT k, k FROM n UNION SELECT r.a, e.v FROM r JOIN e ON r.b = e.u)
SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1
""")
def q65_scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 97).alias("u"), (F.col("l_partkey") % 97).alias("v"))
    k = F.col("n_nationkey").cast("long")
    return N.strong_components(a.unionByName(table(spark, sf_dir, "nation").select(k.alias("u"), (k * 2).alias("v"))))


#: A raster of a pixel for each part, 30 in a row.
_RASTER = "raster AS (SELECT col, row, CASE WHEN (col * 7 + row * 3) % 11 <> 0 THEN CAST((col * 31 + row * 17) % 64 + p_size AS DOUBLE) END AS z FROM (SELECT p_partkey % 30 AS col, p_partkey // 30 AS row, p_size FROM part))"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """col, row and size of each part's pixel."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select((k % 30).alias("col"), F.floor(k / 30).alias("row"), F.col("p_size").alias("size"))


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, j = F.col("col"), F.col("row")
    return pixels(spark, sf_dir).select("col", "row", F.when((i * 7 + j * 3) % 11 != 0, ((i * 31 + j * 17) % 64 + F.col("size")).cast("double")).alias("z"))


@query(f"""
WITH {_RASTER}, p AS (SELECT c_custkey AS id, (c_custkey % 120) / 4.0::DOUBLE - 0.5 AS c, (c_custkey % 77) / 4.0::DOUBLE - 0.5 AS r FROM customer),
q AS (SELECT id, CAST(floor(c) AS BIGINT) + i AS col, CAST(floor(r) AS BIGINT) + j AS row, (CASE WHEN i = 1 THEN c - floor(c) ELSE 1 - (c - floor(c)) END) * (CASE WHEN j = 1 THEN r - floor(r) ELSE 1 - (r - floor(r)) END) AS w FROM p, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j))
SELECT id, CASE WHEN count(*) FILTER (WHERE z IS NULL AND w > 0) = 0 THEN sum(z * w) END AS z FROM q LEFT JOIN raster USING (col, row) GROUP BY id
""")
def q70_raster_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarters of pixels: every product and sum is exact."""
    k = F.col("c_custkey")
    pts = table(spark, sf_dir, "customer").select(k.alias("id"), ((k % 120) / 4.0).alias("col"), ((k % 77) / 4.0).alias("row"))
    return G.sample(raster(spark, sf_dir), pts, "id")


@query(f"""
WITH {_RASTER}, k(o, w) AS (VALUES (-1, 0.25::DOUBLE), (0, 0.5::DOUBLE), (1, 0.25::DOUBLE)), a AS (SELECT col, row, CASE WHEN z IS NULL THEN 0 ELSE z END AS a, CASE WHEN z IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS b FROM raster),
s AS (SELECT x.col, x.row, sum(y.a * k.w * l.w) AS a, sum(y.b * k.w * l.w) AS b FROM raster x, k, k l, a y WHERE y.col = x.col + k.o AND y.row = x.row + l.o GROUP BY 1, 2)
SELECT col, row, a / nullif(b, 0) AS z FROM s
""")
def q71_raster_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.smoothed(raster(spark, sf_dir), [0.25, 0.5, 0.25])


@query("""
WITH l AS (SELECT p_brand AS g, CAST(p_size % 13 AS DOUBLE) AS m, CAST(p_partkey % 9 AS DOUBLE) - 3.0::DOUBLE AS k FROM part)
SELECT g, min(CASE WHEN m < 0 THEN 1.0::DOUBLE WHEN k < 0 THEN 1.0::DOUBLE - m / k ELSE 'Infinity'::DOUBLE END) AS factor FROM l GROUP BY g
""")
def q72_breaking_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select(F.col("p_brand").alias("g"), (F.col("p_size") % 13).cast("double").alias("m"), ((F.col("p_partkey") % 9).cast("double") - 3.0).alias("k"))
    return C.breaking_factor(df, ["g"], "m", "k")


@query(f"""
WITH {_SUMS}, e AS (SELECT variant, mode, length * 2 + climb AS e FROM sums), o AS (SELECT *, variant = min(variant) OVER (PARTITION BY mode) AS observed FROM e), x AS (SELECT *, max(CASE WHEN observed THEN e END) OVER (PARTITION BY mode) AS e_0 FROM o)
SELECT mode, max(e_0) AS e_0, 1 + count(*) FILTER (WHERE NOT observed AND e < e_0) AS rank, count(*) FILTER (WHERE NOT observed AND e < e_0) = 0 AS is_minimum, arg_min(variant, row(e, variant)) FILTER (WHERE NOT observed) AS best, 100 * (min(e) FILTER (WHERE NOT observed) / max(e_0) - 1) AS margin_pct FROM x GROUP BY mode
""")
def q73_observed_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = sums(spark, sf_dir).withColumn("e", F.col("length") * 2 + F.col("climb")).withColumn("observed", F.col("variant") == F.min("variant").over(Window.partitionBy("mode")))
    return C.observed_status(e, ["mode"], "variant", F.col("observed"))
