"""Queries of rasters, heights and land. Rasters: tiles of the nations, and the small one of networks; points: customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.physics import descent
from ..operators import demand as D
from ..operators import geo as G
from ..operators import land as L
from ..operators import polygons as Y
from ..operators import profile as P
from ..operators import reports as R
from ..operators import rings as S
from ..operators import terrain as T
from ..operators.studies import reading_margin
from ..sources import rasters as B
from ..sources.folders import new_folder
from .demand import PLACES, places
from .networks import _MOTION_SQL, _RASTER, POINTS, motions, pixels, points, raster
from .registry import query, table
from .relational import FLOWS, flows

_PIXELS = "px AS (SELECT k % 5 * 10 + c AS col, -(k // 5 + 1) * 10 + r AS row, CASE WHEN v >= -30 THEN CAST(v AS DOUBLE) END AS z FROM (SELECT CAST(n_nationkey AS BIGINT) AS k, r, c, (CAST(n_nationkey AS BIGINT) * 31 + r * 7 + c * 3) % 97 - 40 AS v FROM nation, (SELECT unnest(generate_series(0, 9)) AS r), (SELECT unnest(generate_series(0, 9)) AS c)))"


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey").cast("long")
    ten = F.sequence(F.lit(0), F.lit(9))
    z = F.transform(ten, lambda r: F.transform(ten, lambda c: ((k * 31 + r * 7 + c * 3) % 97 - 40).cast("double")))
    row = F.floor(k / 5)
    return table(spark, sf_dir, "nation").select((k % 5 * 1.25).alias("west"), (row * 1.25).alias("south"), ((k % 5 + 1) * 1.25).alias("east"), ((row + 1) * 1.25).alias("north"), F.lit(0.125).alias("step"), z.alias("z"))


@query(f"WITH {_PIXELS} SELECT col, row, z FROM px WHERE (col + 0.5) * 0.125 BETWEEN 1 - 0.25 AND 4 + 0.25 AND -(row + 0.5) * 0.125 BETWEEN 2 - 0.25 AND 5 + 0.25")
def q96_dem_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.dem_window(tiles(spark, sf_dir), 1.0, 2.0, 4.0, 5.0, 0.25)


@query(f"""
WITH {_RASTER}, p AS (SELECT i AS col_t, j AS row_t, (i + 0.5) * 0.5 + 0.25 - 0.5 AS c, (j + 0.5) * 0.5 + 0.25 - 0.5 AS r FROM (SELECT 2 * col + a AS i, 2 * row + b AS j FROM raster, (VALUES (0), (1)) t(a), (VALUES (0), (1)) u(b))),
q AS (SELECT col_t, row_t, CAST(floor(c) AS BIGINT) + i AS col, CAST(floor(r) AS BIGINT) + j AS row, (CASE WHEN i = 1 THEN c - floor(c) ELSE 1 - (c - floor(c)) END) * (CASE WHEN j = 1 THEN r - floor(r) ELSE 1 - (r - floor(r)) END) AS w FROM p, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j))
SELECT col_t AS col, row_t AS row, CAST(sum(z * w) FILTER (WHERE z IS NOT NULL) AS DOUBLE) / CAST(nullif(sum(w) FILTER (WHERE z IS NOT NULL), 0) AS DOUBLE) AS z FROM q LEFT JOIN raster USING (col, row) GROUP BY col_t, row_t
""")
def q97_resampled_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raster of half the pixel size: voids weigh nothing."""
    half = F.explode(F.array(*(F.struct((2 * F.col("col") + a).alias("col"), (2 * F.col("row") + b).alias("row")) for a in (0, 1) for b in (0, 1))))
    target = pixels(spark, sf_dir).select(half.alias("t")).select("t.*")
    return T.resampled_raster(raster(spark, sf_dir), target, (F.col("col") + 0.5) * 0.5 + 0.25, (F.col("row") + 0.5) * 0.5 + 0.25)


_ALTITUDES = "spots AS (SELECT c_custkey AS id, CAST(floor((c_custkey % 124) / 4.0::DOUBLE - 0.5) AS BIGINT) AS col, CAST(floor((c_custkey % 83) / 4.0::DOUBLE - 0.5) AS BIGINT) AS row FROM customer), alt AS (SELECT id, coalesce(z, 0.0::DOUBLE) AS z FROM spots LEFT JOIN raster USING (col, row))"


def altitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    nodes = table(spark, sf_dir, "customer").select(k.alias("id"), ((k % 124) / 4.0 - 0.5).alias("col"), ((k % 83) / 4.0 - 0.5).alias("row"))
    return T.node_altitudes(raster(spark, sf_dir), nodes, "id")


@query(f"WITH {_RASTER}, {_ALTITUDES} SELECT id, z FROM alt")
def q98_node_altitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return altitudes(spark, sf_dir)


@query(f"""
WITH {_RASTER}, {_ALTITUDES} SELECT n.*, e.* FROM (SELECT count(*) AS num_nodes, sum(z) / count(*) AS z_mean, min(z) AS z_min, max(z) AS z_max, count(*) FILTER (WHERE z = 0) AS n_missing FROM alt) n,
(SELECT count(*) AS num_edges, CAST(sum(l_quantity) AS DOUBLE) / count(*) AS edge_len_mean FROM lineitem) e
""")
def q99_graph_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.graph_statistics(altitudes(spark, sf_dir), table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("length")))


@query("""
WITH px AS (SELECT i AS col, j AS row, CASE WHEN (i + j) % 13 <> 0 THEN ((i // 3) * 7 + j * 5 + p_size // 25) % 4 * 10 + 0.25::DOUBLE * (i % 2) END AS z FROM (SELECT p_partkey % 30 AS i, p_partkey // 30 AS j, p_size FROM part)),
v AS (SELECT *, CAST(round(z) AS BIGINT) AS value FROM px WHERE z IS NOT NULL), g AS (SELECT *, col - row_number() OVER (PARTITION BY row, value ORDER BY col) AS g FROM v WHERE value <> 0)
SELECT row, value, min(col) AS first, max(col) AS last FROM g GROUP BY row, value, g
""")
def q100_population_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, j = F.col("col"), F.col("row")
    z = F.when((i + j) % 13 != 0, (F.floor(i / 3) * 7 + j * 5 + F.floor(F.col("size") / 25)) % 4 * 10 + F.lit(0.25) * (i % 2))
    return T.raster_runs(pixels(spark, sf_dir).select("col", "row", z.alias("z")))


_HEIGHTS = "h AS (SELECT CAST(n_nationkey AS BIGINT) AS node, CASE WHEN n_nationkey % 6 <> 0 THEN CAST(n_nationkey AS BIGINT) * 13 % 29 END AS z FROM nation)"


def heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey").cast("long")
    return table(spark, sf_dir, "nation").select(k.alias("node"), F.when(k % 6 != 0, k * 13 % 29).alias("z"))


@query(f"""
WITH {FLOWS}, {_HEIGHTS}, f AS (SELECT origin, dest, draw, count(*) AS flow FROM flows GROUP BY 1, 2, 3), j AS (SELECT f.*, b.z - a.z AS rise FROM f LEFT JOIN h a ON origin = a.node LEFT JOIN h b ON dest = b.node)
SELECT draw, CAST(sum(flow * rise) AS BIGINT) AS net_rise, CAST(sum(flow) FILTER (WHERE rise IS NOT NULL) AS BIGINT) AS flow_used, count(*) FILTER (WHERE rise IS NULL) AS pairs_missing FROM j GROUP BY draw
""")
def q101_net_rise(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = flows(spark, sf_dir).groupBy("origin", "dest", "draw").agg(F.count("*").alias("flow"))
    return D.net_rise(f, heights(spark, sf_dir), ["draw"]).withColumnsRenamed({"rise": "net_rise", "n_missing": "pairs_missing"})


@query(f"""
WITH {_HEIGHTS}, a AS (SELECT DISTINCT l_suppkey % 25 AS u, l_partkey % 25 AS v FROM lineitem)
SELECT u, v, greatest(y.z - x.z, 0) AS up, greatest(x.z - y.z, 0) AS down, greatest(y.z - x.z, 0) - (y.z - x.z) AS down_again FROM a JOIN h x ON u = x.node JOIN h y ON v = y.node
""")
def q102_node_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights at nodes alone; the descent is what the climb does not leave."""
    arcs = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 25).alias("u"), (F.col("l_partkey") % 25).alias("v")).distinct()
    g = T.straight_gains(arcs, heights(spark, sf_dir))
    return g.select("u", "v", "up", "down", descent(F.col("up"), F.col("z_u"), F.col("z_v")).alias("down_again"))


_LINES = f"""
{_RASTER}, ln AS (SELECT c_custkey AS id, CAST(c_custkey % 20 AS DOUBLE) + 0.75 AS x0, CAST(c_custkey % 18 AS DOUBLE) + 1.25 AS y0 FROM customer),
p AS (SELECT id, k, x0 + k - 0.5 AS c, y0 - 0.5 AS r FROM ln, (SELECT unnest(generate_series(0, 8)) AS k)),
q AS (SELECT id, k, CAST(floor(c) AS BIGINT) + i AS col, CAST(floor(r) AS BIGINT) + j AS row, (CASE WHEN i = 1 THEN c - floor(c) ELSE 1 - (c - floor(c)) END) * (CASE WHEN j = 1 THEN r - floor(r) ELSE 1 - (r - floor(r)) END) AS w FROM p, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)),
s AS (SELECT id, k, CASE WHEN count(*) FILTER (WHERE z IS NULL AND w > 0) = 0 THEN sum(z * w) END AS z FROM q LEFT JOIN raster USING (col, row) GROUP BY id, k),
n AS (SELECT *, max(CASE WHEN z IS NOT NULL THEN k END) OVER (PARTITION BY id ORDER BY k ROWS UNBOUNDED PRECEDING) AS ka, min(CASE WHEN z IS NOT NULL THEN k END) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS kb FROM s),
f AS (SELECT n.id, n.k, floor(64 * coalesce(n.z, a.z + (b.z - a.z) * CAST(n.k - ka AS DOUBLE) / nullif(CAST(kb - ka AS DOUBLE), 0), a.z, b.z, 0)) / 64 AS z FROM n LEFT JOIN s a ON a.id = n.id AND a.k = n.ka LEFT JOIN s b ON b.id = n.id AND b.k = n.kb),
d AS (SELECT id, k, z - lag(z) OVER (PARTITION BY id ORDER BY k) AS dz FROM f)"""


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, k, z of lines over the raster: positions at even steps, heights between pixels, gaps filled, whole 64ths."""
    k = F.col("c_custkey")
    ends = table(spark, sf_dir, "customer").select(k.alias("id"), ((k % 20).cast("double") + 0.75).alias("x0"), ((k % 18).cast("double") + 1.25).alias("y"))
    knots = ends.select("id", "y", F.explode(F.array(F.struct(F.lit(0.0).alias("s"), F.col("x0").alias("x")), F.struct(F.lit(8.0).alias("s"), (F.col("x0") + 8).alias("x")))).alias("e")).select("id", "y", "e.s", "e.x")
    at = P.resampled(knots, ["id", "y"], "s", "x", 1.0)
    z = G.sample(raster(spark, sf_dir), at.select("id", "k", F.col("x").alias("col"), F.col("y").alias("row")).withColumn("key", F.col("id") * 100 + F.col("k")), "key")
    filled = P.filled(z.select(F.floor(F.col("key") / 100).alias("id"), (F.col("key") % 100).cast("double").alias("k"), "z"), ["id"], "k", "z")
    return filled.select("id", F.col("k").cast("long").alias("k"), (F.floor(64 * F.col("z")) / 64.0).alias("z"))


@query(f"WITH {_LINES} SELECT id, sum(greatest(dz, 0)) AS up, sum(greatest(-dz, 0)) AS down FROM d GROUP BY id")
def q103_edge_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = P.steps(profiles(spark, sf_dir), ["id"], ["k"], ["z"])
    return P.gains(steps, ["id"], "d_z")


@query(f"WITH {_LINES} SELECT id, k, dz, sum(dz) OVER (PARTITION BY id ORDER BY k) AS since_start FROM d WHERE dz <> 0")
def q104_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of lines, level ones left out, written and read again."""
    steps = P.steps(P.without_repeats(profiles(spark, sf_dir), ["id"], ["k"], ["z"]), ["id"], ["k"], ["z"]).where("d_z is not null")
    path = new_folder(spark, "segments")
    P.cumulative(steps.select("id", "k", F.col("d_z").alias("dz")), ["id"], ["k"], F.col("dz"), "since_start").write.parquet(path)
    return spark.read.parquet(path)


_RINGS = {"land_a": [(50.0, 40.0), (700.0, 30.0), (760.0, 500.0), (400.0, 380.0), (90.0, 620.0)], "land_b": [(600.0, 600.0), (980.0, 620.0), (900.0, 950.0), (640.0, 900.0)], "lake": [(200.0, 150.0), (420.0, 160.0), (400.0, 300.0), (230.0, 320.0)]}
_RING_EDGES = "edges(ring, ax, ay, bx, b_y) AS (VALUES " + ", ".join(f"('{n}', {p[0]!r}::DOUBLE, {p[1]!r}::DOUBLE, {q[0]!r}::DOUBLE, {q[1]!r}::DOUBLE)" for n, ring in _RINGS.items() for p, q in zip(ring, ring[1:] + ring[:1], strict=True)) + ")"


def _ring(name: str) -> F.Column:
    return F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in _RINGS[name]))


@query(f"""
WITH {POINTS}, {_RING_EDGES}, t AS (SELECT id, ring, x, y, ax, ay, bx, b_y, bx - ax AS dx, b_y - ay AS dy, greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((x - ax) * (bx - ax) + (y - ay) * (b_y - ay)) / ((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)))) AS t FROM points, edges),
r AS (SELECT id, ring, count(*) FILTER (WHERE (ay > y) <> (b_y > y) AND x < (bx - ax) * (y - ay) / nullif(b_y - ay, 0) + ax) % 2 = 1 AS inside, min((x - (ax + t * dx)) * (x - (ax + t * dx)) + (y - (ay + t * dy)) * (y - (ay + t * dy))) AS d2 FROM t GROUP BY 1, 2)
SELECT id, bool_or(ring LIKE 'land%' AND (inside OR d2 <= 25)) AND NOT bool_or(ring = 'lake' AND inside AND d2 > 100) AS on_land FROM r GROUP BY id
""")
def q105_land_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return p.select("id", L.on_land(F.col("x"), F.col("y"), [_ring("land_a"), _ring("land_b")], [_ring("lake")], 5.0, 10.0).alias("on_land"))


_BOXES = "b AS (SELECT k, CAST(x * 8 AS DOUBLE) AS x1, CAST(x * 8 + 64 AS DOUBLE) AS x2, CAST(y * 8 AS DOUBLE) AS y1, CAST(y * 8 + 32 AS DOUBLE) AS y2 FROM places)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("x") * 8.0, F.col("y") * 8.0
    b = places(spark, sf_dir).select("k", x.alias("x_min"), (x + 64).alias("x_max"), y.alias("y_min"), (y + 32).alias("y_max"))
    corners = (("x_min", "y_min"), ("x_max", "y_min"), ("x_max", "y_max"), ("x_min", "y_max"))
    return b.withColumn("ring", F.array(*(F.struct(F.col(a).alias("x"), F.col(c).alias("y")) for a, c in corners)))


@query(f"WITH {PLACES}, {_BOXES} SELECT k, greatest(0, least(x2, 600) - greatest(x1, 100)) * greatest(0, least(y2, 500) - greatest(y1, 52)) AS area FROM b")
def q106_clipped_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    clip = [(100.0, 52.0), (600.0, 52.0), (600.0, 500.0), (100.0, 500.0)]
    return boxes(spark, sf_dir).select("k", L.ring_area(L.clipped(F.col("ring"), clip)).alias("area"))


@query(f"WITH {PLACES}, {_BOXES} SELECT k, x1 AS x_min, y2 AS y_max FROM b WHERE x1 <= 500 AND x2 >= 200 AND y1 <= 400 AND y2 >= 100")
def q107_areas_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "areas")
    boxes(spark, sf_dir).write.parquet(path)
    return L.read_areas(spark, path, 200.0, 100.0, 500.0, 400.0).select("k", "x_min", "y_max")


@query(f"""
WITH {PLACES}, {_BOXES}, {POINTS}, e AS (SELECT min(x) + 8 * (max(x) // 32) AS w, min(y) + 4 * (max(y) // 64) AS s, max(x) // 2 AS e, max(y) // 2 AS n FROM points),
o AS (SELECT k, greatest(0, least(x2, e) - greatest(x1, w)) * greatest(0, least(y2, n) - greatest(y1, s)) AS overlap FROM b, e) SELECT k, overlap FROM o WHERE overlap > 0
""")
def q108_overlapping_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas that share ground with part of the network's bounding box."""
    b = R.bounding_box(points(spark, sf_dir)).first()
    west, south, east, north = b.x_min + 8 * (b.x_max // 32), b.y_min + 4 * (b.y_max // 64), b.x_max // 2, b.y_max // 2
    return L.overlapping(boxes(spark, sf_dir), "ring", float(west), float(south), float(east), float(north)).select("k", "overlap")


@query(f"WITH {PLACES}, a AS (SELECT n_name, CAST(x % 7 + 1 AS DOUBLE) * CAST(y % 5 + 2 AS DOUBLE) AS area FROM places JOIN nation ON k = n_nationkey WHERE contains(lower(n_name), 'nation_1')) SELECT n_name AS name, area FROM a ORDER BY area DESC, n_name LIMIT 1")
def q109_largest_named_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = (F.col("x") % 7 + 1).cast("double"), (F.col("y") % 5 + 2).cast("double")
    ring = F.array(*(F.struct(a.alias("x"), b.alias("y")) for a, b in ((F.lit(0.0), F.lit(0.0)), (x, F.lit(0.0)), (x, y), (F.lit(0.0), y))))
    areas = places(spark, sf_dir).join(table(spark, sf_dir, "nation"), F.col("k") == F.col("n_nationkey")).select(F.col("n_name").alias("name"), ring.alias("ring"))
    return L.largest_named(areas, "name", "ring", "Nation 1").select("name", "area")


@query(f"""
WITH {PLACES}, {_MOTION_SQL}, r(ax, ay, bx, b_y) AS (VALUES (-40.0::DOUBLE, -30.0::DOUBLE, 40.0::DOUBLE, -30.0::DOUBLE), (40.0, -30.0, 40.0, 30.0), (40.0, 30.0, -40.0, 30.0), (-40.0, 30.0, -40.0, -30.0)),
m AS (SELECT variant, k, a * (x - 50) + b * (y - 44) + dx AS mx, c * (x - 50) + e * (y - 44) + dy AS my FROM places, motions),
i AS (SELECT variant, k, count(*) FILTER (WHERE (ay > my) <> (b_y > my) AND mx < (bx - ax) * (my - ay) / nullif(b_y - ay, 0) + ax) % 2 = 1 AS inside FROM m, r GROUP BY 1, 2)
SELECT i.variant, count(*) AS n, count(*) FILTER (WHERE NOT i.inside) AS n_outside FROM i JOIN i o ON o.variant = 'original' AND o.k = i.k AND o.inside GROUP BY 1
""")
def q110_outside_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = places(spark, sf_dir).select(F.col("k").alias("node"), (F.col("x") - 50).cast("double").alias("x"), (F.col("y") - 44).cast("double").alias("y"))
    ring = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((-40.0, -30.0), (40.0, -30.0), (40.0, 30.0), (-40.0, 30.0))))
    return L.outside_after(nodes, motions(spark), ring)


@query(f"""
WITH {PLACES}, {_MOTION_SQL} SELECT variant, p.k AS u, a * (p.x - 50) + b * (p.y - 44) + dx AS first_x, c * (q.x - 50) + e * (q.y - 44) + dy AS last_y FROM places p JOIN places q ON q.k = p.k + 1, motions
""")
def q111_moved_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda n: places(spark, sf_dir).select(F.col("k").alias(n), F.struct((F.col("x") - 50).alias("x"), (F.col("y") - 44).alias("y")).alias(f"p{n}"))
    lines = at("u").join(at("v"), F.col("v") == F.col("u") + 1).select("u", F.array("pu", "pv").alias("g")).crossJoin(F.broadcast(motions(spark)))
    g = G.moved_line(F.col("g"), *(F.col(n) for n in ("a", "b", "c", "e", "dx", "dy")))
    return lines.select("variant", "u", g.alias("m")).select("variant", "u", F.element_at("m", 1)["x"].alias("first_x"), F.element_at("m", -1)["y"].alias("last_y"))


@query(f"WITH {PLACES}, w AS (SELECT k, unnest(generate_series(CAST(floor((x - 5) / 10.0) AS BIGINT), CAST(floor((x + 7) / 10.0) AS BIGINT))) AS lon, (y - 3) / 10.0 AS s, (y + 9) / 10.0 AS n FROM places) SELECT k, lon, unnest(generate_series(CAST(floor(s) AS BIGINT), CAST(floor(n) AS BIGINT))) AS lat FROM w")
def q112_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole degrees around places, as a network's reachable bounds need them."""
    x, y = F.col("x"), F.col("y")
    t = G.tiles_of((x - 5) / 10.0, (y - 3) / 10.0, (x + 7) / 10.0, (y + 9) / 10.0)
    return places(spark, sf_dir).select("k", F.explode(t).alias("t")).select("k", "t.lon", "t.lat")


@query(f"WITH {PLACES} SELECT k, CAST(floor(greatest(x * 10.0::DOUBLE, (y * 20.0::DOUBLE) * sin(radians(k * 3.0::DOUBLE)), (y * 20.0::DOUBLE) * ((1.0::DOUBLE + k / 100.0::DOUBLE) - 1.0::DOUBLE)) * 1000) AS BIGINT) AS millimetres FROM places")
def q113_reading_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, x, y = F.col("k"), F.col("x"), F.col("y")
    return places(spark, sf_dir).select("k", F.floor(reading_margin(x * 10.0, y * 20.0, k * 3.0, F.lit(1.0) + k / 100.0) * 1000).alias("millimetres"))


@query(f"""
WITH {PLACES}, b AS (SELECT k, CAST(x AS DOUBLE) AS w, CAST(y AS DOUBLE) AS s, x + (k + 1) / 8.0::DOUBLE AS e, y + (k % 4 + 1) / 4.0::DOUBLE AS n FROM places)
SELECT k, w - (e - w) * 0.25::DOUBLE AS west, s - (n - s) * 0.25::DOUBLE AS south, e + (e - w) * 0.25::DOUBLE AS east, n + (n - s) * 0.25::DOUBLE AS north, len(list_filter(generate_series(0, 18), lambda z: 360.0::DOUBLE / pow(2.0::DOUBLE, z) >= greatest(e - w, n - s))) - 1 AS zoom FROM b
""")
def q114_map_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, x, y = F.col("k"), F.col("x").cast("double"), F.col("y").cast("double")
    bounds, zoom = R.map_extent(x, y, x + (k + 1) / 8.0, y + (k % 4 + 1) / 4.0, 0.25)
    return places(spark, sf_dir).select("k", *(b.alias(n) for b, n in zip(bounds, ("west", "south", "east", "north"), strict=True)), zoom.alias("zoom"))


@query(f"""
WITH {_PIXELS}, w AS (SELECT col, row, z FROM px WHERE (col + 0.5) * 0.125 BETWEEN 0.5 AND 4.5 AND -(row + 0.5) * 0.125 BETWEEN 1.5 AND 5.5),
v AS (SELECT col, row, CAST((col // 4 * 3 - row // 2) % 5 AS BIGINT) AS value FROM w), g AS (SELECT *, col - row_number() OVER (PARTITION BY row, value ORDER BY col) AS g FROM v WHERE value <> 0)
SELECT row, value, min(col) AS first, max(col) AS last FROM g GROUP BY row, value, g
""")
def q192_prepared_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box from a JSON configuration, the heights in it, and its people as runs of pixels."""
    path = new_folder(spark, "config")
    spark.createDataFrame([('{"west": 1.0, "south": 2.0, "east": 4.0, "north": 5.0, "margin": 0.5}',)], "value string").coalesce(1).write.text(path)
    config = spark.read.json(path)
    t = tiles(spark, sf_dir)
    whole = T.dem_window(t, -10.0, -10.0, 20.0, 20.0)
    people = whole.select("col", "row", ((F.floor(F.col("col") / 4) * 3 + F.floor(-F.col("row") / 2)) % 5).cast("double").alias("z"))
    return T.prepared(t, people, config)[1]


#: Land of each nation: a band along a row of its customers' orders, whose shores are ragged and which has a lake in the middle half, as rings of many edges; and lakes of its own.
_BAND = """
seq AS (SELECT CAST(c_nationkey AS BIGINT) AS poly, o_custkey AS c, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderkey) AS k, count(*) OVER (PARTITION BY c_nationkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey),
shore AS (SELECT poly, r, k, n, k * 1000.0::DOUBLE / n AS x, poly * 40.0::DOUBLE + y AS y FROM seq, LATERAL (VALUES (0, CAST(c % 9 AS DOUBLE)), (1, 30.0::DOUBLE + c % 7), (2, 12.0::DOUBLE + c % 4), (3, 20.0::DOUBLE + c % 5)) t(r, y) WHERE r < 2 OR (4 * k >= n AND 4 * k <= 3 * n)),
line AS (SELECT poly, r // 2 AS ring, CASE WHEN r % 2 = 0 THEN k ELSE 2 * n + 1 - k END AS s, x, y FROM shore),
band AS (SELECT poly, ring, x AS ax, y AS ay, coalesce(lead(x) OVER w, first_value(x) OVER w) AS bx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS b_y FROM line WINDOW w AS (PARTITION BY poly, ring ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """poly, number and ring of each nation's land (number 0) and of the lake in it (number 1)."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"), F.col("c_nationkey").cast("long").alias("poly"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c"), "o_orderkey").join(c, "c")
    w = Window.partitionBy("poly")
    k, n = F.col("k"), F.col("n")
    o = o.select("poly", "c", F.row_number().over(w.orderBy("o_orderkey")).cast("long").alias("k"), F.count("*").over(w).alias("n"))
    heights = (F.col("c") % 9, 30 + F.col("c") % 7, 12 + F.col("c") % 4, 20 + F.col("c") % 5)
    at = o.select("poly", "k", "n", F.posexplode(F.array(*heights)).alias("r", "y")).where((F.col("r") < 2) | ((4 * k >= n) & (4 * k <= 3 * n)))
    step = F.when(F.col("r") % 2 == 0, k).otherwise(2 * n + 1 - k)
    point = F.struct(step.alias("s"), (k * 1000.0 / n).alias("x"), (F.col("poly") * 40.0 + F.col("y")).alias("y"))
    line = at.groupBy("poly", F.floor(F.col("r") / 2).alias("number")).agg(F.sort_array(F.collect_list(point)).alias("p"))
    return line.select("poly", "number", F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("ring"))


_XY = "p AS (SELECT id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM points)"


@query(f"""
WITH {_BAND}, {POINTS}, {_XY}
SELECT id, poly FROM p JOIN band ON y >= poly * 40 AND y < poly * 40 + 40 GROUP BY 1, 2 HAVING count(*) FILTER (WHERE (ay > y) <> (b_y > y) AND x < (bx - ax) * (y - ay) / nullif(b_y - ay, 0) + ax) % 2 = 1
""")
def q194_points_in_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in the lands of nations, whose shores have an edge for each order, by the index of cells."""
    p = points(spark, sf_dir).select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return Y.containing(p, "id", Y.polygon_index(Y.ring_edges(bands(spark, sf_dir)), 8.0), 8.0).select("id", "poly")


@query(f"""
WITH {_BAND}, {POINTS}, {_XY},
t AS (SELECT id, poly, ring, x, y, ax, ay, bx, b_y, greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((x - ax) * (bx - ax) + (y - ay) * (b_y - ay)) / ((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)))) AS t FROM p JOIN band ON y >= poly * 40 - 3 AND y < poly * 40 + 43),
r AS (SELECT id, poly, ring, count(*) FILTER (WHERE (ay > y) <> (b_y > y) AND x < (bx - ax) * (y - ay) / nullif(b_y - ay, 0) + ax) % 2 = 1 AS inside, min((x - (ax + t * (bx - ax))) * (x - (ax + t * (bx - ax))) + (y - (ay + t * (b_y - ay))) * (y - (ay + t * (b_y - ay)))) AS d2 FROM t GROUP BY 1, 2, 3),
f AS (SELECT id, bool_or(ring = 0 AND (inside OR d2 <= 4)) AS firm, bool_or(ring = 1 AND inside AND NOT d2 <= 2.25) AS wet FROM r GROUP BY 1)
SELECT id, coalesce(firm AND NOT wet, false) AS on_land FROM p LEFT JOIN f USING (id)
""")
def q195_land_mask_of_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers on land grown by 2, and not in a lake shrunk by 1.5: the lands' outer rings, and their inner ones as lakes."""
    p = points(spark, sf_dir).select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    b = bands(spark, sf_dir)
    return Y.land_mask(p, "id", b.where("number = 0"), b.where("number = 1"), 2.0, 1.5, 8.0)


#: A yard about each customer's point, with a hole and a notch, and a nation's estate of three wings; all corners are whole numbers.
_YARD = [[(0, 0), (12, 0), (12, 4), (9, 4), (9, 7), (12, 7), (12, 10), (0, 10)], [(3, 3), (3, 6), (6, 6), (6, 3)]]
_ESTATE = [[(0, 0), (90, 0), (90, 30), (60, 30), (60, 60), (90, 60), (90, 90), (0, 90), (0, 60), (30, 60), (30, 30), (0, 30)], [(10, 10), (80, 10), (80, 20), (10, 20)], [(35, 70), (55, 70), (55, 80), (35, 80)]]
#: Unit cells of a shape: those whose middle an odd number of its upright edges have to their right.
_CELLS = lambda rings, n: ", ".join(f"({i}, {j})" for i in range(n) for j in range(n) if sum(((a[1] > j + 0.5) != (b[1] > j + 0.5)) and i + 0.5 < a[0] for r in rings for a, b in zip(r, r[1:] + r[:1], strict=True)) % 2)
_SHAPES = f"{POINTS}, yard(i, j) AS (VALUES {_CELLS(_YARD, 12)}), estate(i, j) AS (VALUES {_CELLS(_ESTATE, 90)}), y AS (SELECT id AS a, x + i AS i, y + j AS j FROM points, yard), e AS (SELECT CAST(n_nationkey AS BIGINT) AS b, n_nationkey % 5 * 200 + i AS i, n_nationkey // 5 * 200 + j AS j FROM nation, estate)"


def _shape(rings: list[list[tuple[int, int]]], x: F.Column, y: F.Column) -> F.Column:
    return F.explode(F.array(*(F.array(*(F.struct((x + a).cast("double").alias("x"), (y + b).cast("double").alias("y")) for a, b in r)) for r in rings)))


def yards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select(F.col("id").alias("poly"), _shape(_YARD, F.col("x"), F.col("y")).alias("ring"))


def estates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey").cast("long")
    return table(spark, sf_dir, "nation").select(k.alias("poly"), _shape(_ESTATE, k % 5 * 200, F.floor(k / 5) * 200).alias("ring"))


@query(f"WITH {_SHAPES} SELECT a, b, CAST(count(*) AS DOUBLE) AS area FROM y JOIN e USING (i, j) GROUP BY 1, 2")
def q196_shared_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each customer's yard and each nation's estate have in common, both with holes and notches."""
    cut = Y.intersection(yards(spark, sf_dir), estates(spark, sf_dir), 16.0)
    return cut.groupBy("a", "b").agg(F.sum(Y.trapezoid_area()).alias("area"))


@query(f"WITH {_SHAPES} SELECT a, CAST(count(*) AS DOUBLE) AS area FROM y ANTI JOIN e USING (i, j) GROUP BY 1")
def q197_area_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each customer's yard without the nations' estates."""
    cut = Y.difference(yards(spark, sf_dir), estates(spark, sf_dir), 16.0)
    return cut.groupBy("a").agg(F.sum(Y.trapezoid_area()).alias("area"))


@query("""
WITH o AS (SELECT o_custkey AS c, o_orderkey AS way, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k, count(*) OVER (PARTITION BY o_custkey) AS m, count(*) FILTER (WHERE o_orderkey % 37 = 0) OVER (PARTITION BY o_custkey) AS gone FROM orders)
SELECT min(way) AS ring, count(*) AS n_ways, 2 * count(*) AS n_points, CAST(sum(CASE WHEN k < m - 1 THEN 4 * k * (k + 1) * (k + 1) - 4 * (k + 1) * k * k ELSE 0 END) + 0 AS DOUBLE) / 2 AS area FROM o WHERE gone = 0 AND m > 2 GROUP BY c
""")
def q198_rings_of_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings of customers' orders, each a way with a bend, drawn in either direction; a customer with an order missing has none."""
    from pyspark.sql import Window

    k, m, c = F.col("k"), F.col("m"), F.col("o_custkey")
    w = Window.partitionBy("o_custkey")
    o = table(spark, sf_dir, "orders").select(c, F.col("o_orderkey").alias("way"), (F.row_number().over(w.orderBy("o_orderkey")) - 1).cast("long").alias("k"), F.count("*").over(w).alias("m"))
    o = o.where("way % 37 <> 0").withColumn("l", (k + 1) % m)
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    corner = lambda i: at(2 * i, 2 * i * i)
    line = F.array(corner(k), at(k + F.col("l"), k * k + F.col("l") * F.col("l")), corner(F.col("l")))
    a, b = c * 10_000 + k, c * 10_000 + F.col("l")
    turned = F.col("way") % 2 == 1
    ways = o.where("m > 2").select("way", F.when(turned, b).otherwise(a).alias("a"), F.when(turned, a).otherwise(b).alias("b"), F.when(turned, F.reverse(line)).otherwise(line).alias("points"))
    r = S.stitched(ways)
    return r.select("ring", "n_ways", F.size("points").cast("long").alias("n_points"), L.ring_area(F.col("points")).alias("area"))


@query(f"WITH {_PIXELS} SELECT col, row, z FROM px WHERE (col + 0.5) * 0.125 BETWEEN 0.5 AND 3.5 AND -(row + 0.5) * 0.125 BETWEEN 1 AND 4.75")
def q200_raster_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations' tiles as files, and the heights in a box read from those."""
    files = B.raster_files(tiles(spark, sf_dir).withColumn("path", F.format_string("x%05.2fy%05.2f", "west", "north")))
    return T.dem_window(B.raster_blocks(files, 0.5, 1.0, 3.5, 4.75), 0.5, 1.0, 3.5, 4.75, 0.0)
