"""Queries of whole studies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.physics import TIE
from ..operators import demand as D
from ..operators import geo as G
from ..operators import graph as N
from ..operators import studies as T
from .demand import PAIRS, PLACES, pairs
from .networks import ARCS, PATHS, arcs, points
from .ranking import LINES, R_AT, R_HIGH, R_LOW, observed_lines
from .registry import query, table
from .relational import _NAMED, _named


@query("""
WITH d AS (SELECT CAST(unnest(generate_series(1, 4)) AS DOUBLE) * 250 AS size), a(angle) AS (VALUES (0), (90), (180), (270)),
m AS (SELECT 'original' AS variant, 'original' AS family, 0.0::DOUBLE AS parameter UNION ALL SELECT printf('trans_%dm_a+%03d', CAST(size AS INT), angle), 'translation', size FROM d, a
UNION ALL SELECT * FROM (VALUES ('rot_-05p00deg', 'rotation', -5.0), ('rot_+00p50deg', 'rotation', 0.5)) UNION ALL SELECT * FROM (VALUES ('scale_ns_0p95', 'scale_ns', 0.95), ('scale_ew_0p95', 'scale_ew', 0.95), ('scale_ns_1p10', 'scale_ns', 1.1), ('scale_ew_1p10', 'scale_ew', 1.1))),
c AS (SELECT n_name AS city, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
SELECT city, variant, family, parameter, n FROM c, m WHERE family <> 'translation' OR parameter < 10 * n
""")
def q81_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every city's candidates: translations up to ten metres for each of its customers, and all others."""
    cities = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("city")).agg(F.count("*").alias("n"))
    m = T.motions(spark, 250.0, 4, rotations=[0.0, 0.5, -5.0], scales=[1.1, 0.95]).select("variant", "family", "parameter")
    return cities.join(F.broadcast(m), (F.col("family") != "translation") | (F.col("parameter") < 10 * F.col("n")))


@query("""
WITH p AS (SELECT c_custkey AS node, (c_custkey * 7919) % 1009 AS x, (c_custkey * 104729) % 997 AS y FROM customer), b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p),
s AS (SELECT x0 AS a, y0 AS b FROM b UNION ALL SELECT x1, y0 FROM b UNION ALL SELECT x0, y1 FROM b UNION ALL SELECT x1, y1 FROM b UNION ALL SELECT (x0 + x1) / 2, (y0 + y1) / 2 FROM b)
SELECT DISTINCT node FROM (SELECT a, b, arg_min(node, row((x - a) * (x - a) + (y - b) * (y - b), node)) AS node FROM p, s GROUP BY a, b)
""")
def q82_extremal_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.sampled_nodes(points(spark, sf_dir).withColumnRenamed("id", "node"), 0).select("node")


@query(f"""
WITH {_NAMED}, r AS (SELECT p_partkey, p_partkey % 7 AS city, CASE WHEN p_partkey % 97 = 0 THEN 'bad' ELSE CAST(1000 + p_partkey % 89 AS VARCHAR) END AS txt, name FROM named WHERE p_partkey % 7 <> 5 AND NOT (p_partkey % 7 = 2 AND name = 'original')),
n AS (SELECT *, TRY_CAST(txt AS DOUBLE) AS e FROM r), l AS (SELECT * FROM n WHERE e IS NOT NULL QUALIFY row_number() OVER (PARTITION BY city, name ORDER BY p_partkey DESC) = 1),
k AS (SELECT * FROM l WHERE NOT coalesce(TRY_CAST(nullif(regexp_extract(name, '^(graph_)?trans_(\\d+)m_a', 2), '') AS DOUBLE) < 200, false) AND NOT coalesce(TRY_CAST(replace(nullif(regexp_extract(name, '^scale_ns_(\\d+p\\d+)$', 1), ''), 'p', '.') AS DOUBLE) < 1, false)),
o AS (SELECT *, max(CASE WHEN name = 'original' THEN e END) OVER (PARTITION BY city) AS e_0 FROM k), c AS (SELECT unnest(generate_series(0, 6)) AS city)
SELECT c.city, name AS filename, e, e - e_0 AS delta, 100 * (e - e_0) / e_0 AS delta_pct, name <> 'original' AND e < {1 - TIE!r}::DOUBLE * e_0 AS lower, CASE WHEN name IS NULL THEN 'read_error' WHEN e_0 IS NULL THEN 'missing_original' ELSE 'ok' END AS status FROM c LEFT JOIN o ON c.city = o.city
""")
def q83_prepared_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    text = F.when(k % 97 == 0, "bad").otherwise((1000 + k % 89).cast("string"))
    results = _named(spark, sf_dir).where(~(k % 7).isin(5) & ~((k % 7 == 2) & (F.col("name") == "original"))).select((k % 7).alias("city"), F.col("name").alias("filename"), text.alias("txt"), k.alias("seq"))
    return T.prepared(results, spark.range(7).withColumnRenamed("id", "city"), "txt").select("city", "filename", "e", "delta", "delta_pct", "lower", "status")


@query(f"""
WITH {LINES}, e AS (SELECT city, variant, d + {R_AT}::DOUBLE * h AS e, observed FROM pairs), x AS (SELECT *, max(CASE WHEN observed THEN e END) OVER (PARTITION BY city) AS e_0 FROM e),
s AS (SELECT city, min({{'e': e, 'variant': variant, 'observed': observed}}) AS b, max(e_0) AS e_0, count(*) AS n_variants, count(*) FILTER (WHERE NOT observed) AS n, count(*) FILTER (WHERE e < e_0) + 1 AS rank FROM x GROUP BY city)
SELECT city, CASE WHEN n = 0 OR city = 7 THEN 'CONSTRAINED' WHEN b.observed OR abs(100.0::DOUBLE * (b.e / e_0 - 1.0::DOUBLE)) < 0.05 THEN 'OK' ELSE 'DISPLACED_LOWER' END AS status, b.variant AS best, b.e - e_0 AS delta, 100.0::DOUBLE * (b.e / e_0 - 1.0::DOUBLE) AS delta_pct, rank, n_variants FROM s
""")
def q84_city_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observed_lines(spark, sf_dir).select("city", "variant", (F.col("d") + F.lit(R_AT) * F.col("h")).alias("e"), "observed")
    return T.summary(rows, [7])


@query(f"""
WITH {LINES}, e AS (SELECT city % 5 AS family, variant AS parameter, d + {R_AT}::DOUBLE * h AS e FROM lines)
SELECT family, count(*) AS n, min(e) AS least, arg_min(parameter, row(e, parameter)) AS best_parameter, max(e) AS largest, 100 * (max(e) - min(e)) / min(e) AS spread_pct FROM e GROUP BY 1
""")
def q85_family_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observed_lines(spark, sf_dir).select((F.col("city") % 5).alias("family"), F.col("variant").alias("parameter"), (F.col("d") + F.lit(R_AT) * F.col("h")).alias("e"))
    return T.family_summary(rows, ["family"])


@query(f"""
WITH {LINES}, e AS (SELECT city, variant, d + {R_AT}::DOUBLE * h AS e FROM pairs WHERE NOT observed AND variant % 3 <> 0)
SELECT city, arg_min(variant, row(e, variant)) AS best, arg_max(variant, row(e, variant)) AS worst FROM e GROUP BY city
""")
def q86_best_and_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observed_lines(spark, sf_dir).select("city", "variant", (F.col("d") + F.lit(R_AT) * F.col("h")).alias("e"), "observed")
    return T.best_and_worst(rows, rows.where("variant % 3 <> 0"))


@query("""
WITH w(wanted) AS (VALUES ('nation_3'), ('NATION_2'), ('ation_11x NATION_11'), ('nothing')),
j AS (SELECT n_name, wanted, CASE WHEN lower(n_name) = lower(wanted) THEN 1 WHEN contains(lower(n_name), lower(wanted)) THEN 2 WHEN contains(lower(wanted), lower(n_name)) THEN 3 END AS level FROM nation, w)
SELECT n_name, wanted, level FROM j WHERE level IS NOT NULL QUALIFY level = min(level) OVER (PARTITION BY wanted)
""")
def q87_matched_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([("nation_3",), ("NATION_2",), ("ation_11x NATION_11",), ("nothing",)], "wanted string")
    return T.matched(table(spark, sf_dir, "nation").select("n_name"), "n_name", wanted)


@query(f"""
WITH {LINES}, g AS (SELECT city, i, {R_LOW}::DOUBLE + {R_HIGH - R_LOW}::DOUBLE * i / 200 AS r, d, h, d_0, h_0 FROM pairs, (SELECT unnest(generate_series(0, 200)) AS i)),
b AS (SELECT city, i, min(d + r * h) AS best, max(d_0 + r * h_0) AS e_0 FROM g GROUP BY 1, 2)
SELECT city, max((e_0 - least(best, e_0)) / least(best, e_0)) AS worst_regret, max((e_0 - least(best, e_0)) / least(best, e_0)) <= 0.01 AS near_lowest FROM b GROUP BY 1
""")
def q88_regret_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.regret_over(observed_lines(spark, sf_dir), ["city"], R_LOW, R_HIGH)


@query(f"""
WITH {PLACES}, {PAIRS}, {ARCS}, {PATHS}, w AS (SELECT i, j, m_j / (100.0::DOUBLE + d2) AS w FROM od), c AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS p FROM w)
SELECT c.i, count(*) AS n_routed, CAST(floor(sum(p * (a.w + b.w)) / sum(p) * 1e6) AS BIGINT) AS length_millionths, CAST(floor(sum(p * (a.g + b.g)) / sum(p) * 1e6) AS BIGINT) AS climb_millionths FROM c JOIN p5 a ON c.i = a.i AND c.j = a.j JOIN p5 b ON c.i = b.j AND c.j = b.i GROUP BY 1
""")
def q89_densification(spark: SparkSession, sf_dir: str) -> DataFrame:
    choice = D.destination_choice(pairs(spark, sf_dir), F.col("m_j") / (100.0 + F.col("d2")), -1.0).select("i", "j", "p")
    a = arcs(spark, sf_dir)
    s = T.densification(choice, N.shortest_paths(a, N.nodes_of(a).withColumnRenamed("node", "i"), ["g"]))
    return s.select("i", "n_routed", F.floor(F.col("length") * 1e6).alias("length_millionths"), F.floor(F.col("climb") * 1e6).alias("climb_millionths"))


_ROADS = "roads AS (SELECT l_suppkey % 50 AS u, l_partkey % 50 AS v, l_orderkey % 3 AS way, l_quantity AS length, ['primary', 'residential', 'path', 'motorway', 'motorway_link', 'trunk', 'trunk_link', 'primary_link', 'secondary', 'secondary_link', 'tertiary', 'tertiary_link', 'unclassified', 'service'][(l_orderkey + l_linenumber) % 14 + 1] AS class FROM lineitem)"


def _roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("primary", "residential", "path", "motorway", "motorway_link", "trunk", "trunk_link", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link", "unclassified", "service")
    kind = F.element_at(F.array(*map(F.lit, names)), ((F.col("l_orderkey") + F.col("l_linenumber")) % len(names) + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 50).alias("u"), (F.col("l_partkey") % 50).alias("v"), (F.col("l_orderkey") % 3).alias("way"), F.col("l_quantity").alias("length"), kind.alias("class"))


@query(f"WITH {_ROADS} SELECT u, v, way, length FROM roads QUALIFY row_number() OVER (PARTITION BY least(u, v), greatest(u, v), way ORDER BY u, v, length) = 1")
def q90_streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.streets(_roads(spark, sf_dir).drop("class")).select("u", "v", "way", "length")


@query(f"""
WITH {_ROADS}, r AS (SELECT u, v, length, CASE class WHEN 'motorway' THEN 1 WHEN 'trunk' THEN 2 WHEN 'primary' THEN 3 WHEN 'secondary' THEN 4 WHEN 'tertiary' THEN 5 WHEN 'motorway_link' THEN 6 WHEN 'trunk_link' THEN 7 WHEN 'primary_link' THEN 8 WHEN 'secondary_link' THEN 9 WHEN 'tertiary_link' THEN 10 WHEN 'residential' THEN 20 WHEN 'unclassified' THEN 21 WHEN 'service' THEN 30 ELSE 50 END AS rank FROM (SELECT u, v, class, max(length) AS length FROM roads GROUP BY 1, 2, 3))
SELECT * FROM r ORDER BY rank, length DESC, u, v LIMIT 300
""")
def q91_main_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    longest = _roads(spark, sf_dir).groupBy("u", "v", "class").agg(F.max("length").alias("length"))
    return T.main_roads(longest.select("u", "v", "length", F.array("class").alias("classes")), 300).select("u", "v", "length", "rank")


_TRACKS = "tracks AS (SELECT l_suppkey % 30 AS u, l_partkey % 30 AS v, l_quantity AS length, l_linenumber AS n_points, l_orderkey * 100000 + l_partkey AS id FROM lineitem)"


@query(f"""
WITH {_TRACKS}, a AS (SELECT u, v, min({{'k': length, 'i': id}}) AS x FROM tracks GROUP BY 1, 2), b AS (SELECT u, v, min({{'k': n_points, 'i': id}}) AS x FROM tracks GROUP BY 1, 2)
SELECT a.u, a.v, a.x.i AS rail, b.x.i AS bus FROM a JOIN b ON a.u = b.u AND a.v = b.v
""")
def q92_stop_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 30).alias("u"), (F.col("l_partkey") % 30).alias("v"), F.col("l_quantity").alias("length"), F.col("l_linenumber").alias("n_points"), (F.col("l_orderkey") * 100000 + F.col("l_partkey")).alias("id"))
    pick = lambda rule, name: T.stop_arcs(tracks, rule).select("u", "v", F.col("id").alias(name))
    return pick("shortest", "rail").join(pick("fewest_points", "bus"), ["u", "v"])


@query("""
WITH p AS (SELECT c_custkey AS id, (c_custkey * 7919) % 1009 AS x, (c_custkey * 104729) % 997 AS y FROM customer), w AS (SELECT a.id AS u, b.id AS v, sqrt(CAST((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS DOUBLE)) AS length FROM p a JOIN p b ON a.id <> b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 900)
SELECT id AS u, id + 1 AS v, 50.0::DOUBLE AS length, 50.0::DOUBLE AS weight, true AS ride FROM p UNION ALL SELECT u, v, length, 3.0::DOUBLE * length, false FROM w
""")
def q93_stops_with_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    stops = points(spark, sf_dir)
    rides = stops.select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"), F.lit(50.0).alias("length"))
    return T.with_transfers(rides, G.pairs_within(stops, "id", 30.0))


@query(f"""
WITH {LINES}, e AS (SELECT city % 5 AS g, variant, d + {R_AT}::DOUBLE * h AS e, variant % 3 = 0 AS low FROM lines)
SELECT a.g, count(*) FILTER (WHERE a.e < b.e) / count(*) AS share_below, max(a.e) < min(b.e) AS all_below FROM e a JOIN e b ON a.g = b.g AND a.low AND NOT b.low GROUP BY 1
""")
def q94_pairs_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.stats import pairs_below

    rows = observed_lines(spark, sf_dir).select((F.col("city") % 5).alias("g"), (F.col("d") + F.lit(R_AT) * F.col("h")).alias("e"), (F.col("variant") % 3 == 0).alias("low"))
    return pairs_below(rows, ["g"], "e", F.col("low"))


@query("""
WITH p AS (SELECT c_custkey AS node, CAST((c_custkey * 7919) % 1009 AS DOUBLE) AS x, CAST((c_custkey * 104729) % 997 AS DOUBLE) AS y FROM customer),
a AS (SELECT u.node AS u, v.node AS v, CASE WHEN u.node % 2 = 0 THEN u.x ELSE v.x END + u.node % 3 AS ax, CASE WHEN u.node % 2 = 0 THEN u.y ELSE v.y END AS ay, CASE WHEN u.node % 2 = 0 THEN v.x ELSE u.x END AS bx, CASE WHEN u.node % 2 = 0 THEN v.y ELSE u.y END AS b_y, u.x AS ux, u.y AS uy, v.x AS vx, v.y AS vy FROM p u JOIN p v ON v.node = u.node + 1),
d AS (SELECT u, v, least(greatest(sqrt((ax - ux) * (ax - ux) + (ay - uy) * (ay - uy)), sqrt((bx - vx) * (bx - vx) + (b_y - vy) * (b_y - vy))), greatest(sqrt((ax - vx) * (ax - vx) + (ay - vy) * (ay - vy)), sqrt((bx - ux) * (bx - ux) + (b_y - uy) * (b_y - uy)))) AS away FROM a)
SELECT u, v, away, away <= 1 AS consistent FROM d
""")
def q95_line_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = points(spark, sf_dir).select(F.col("id").alias("node"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    a, b = (nodes.select(F.col("node").alias(k), F.col("x").alias(f"{k}x"), F.col("y").alias(f"{k}y")) for k in "uv")
    j = a.join(b, F.col("v") == F.col("u") + 1)
    even = F.col("u") % 2 == 0
    pick = lambda p, q: F.when(even, F.col(p)).otherwise(F.col(q))
    line = F.array(F.struct((pick("ux", "vx") + F.col("u") % 3).alias("x"), pick("uy", "vy").alias("y")), F.struct(pick("vx", "ux").alias("x"), pick("vy", "uy").alias("y")))
    return G.end_distances(j.select("u", "v", line.alias("geometry")), nodes).select("u", "v", "away", (F.col("away") <= 1).alias("consistent"))
