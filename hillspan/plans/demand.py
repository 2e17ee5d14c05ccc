"""Queries of demand models and profiles. Places: nations with the coordinates (37 k mod 101, 53 k mod 89) and their customers as mass; profiles: a user's event values in order of time."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import demand as D
from ..operators import profile as P
from .registry import query, table
from .relational import FLOWS, flows

PLACES = "places AS (SELECT CAST(n_nationkey AS BIGINT) AS k, (CAST(n_nationkey AS BIGINT) * 37) % 101 AS x, (CAST(n_nationkey AS BIGINT) * 53) % 89 AS y, count(c_custkey) AS m FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey)"
PAIRS = "od AS (SELECT a.k AS i, b.k AS j, a.m AS m_i, b.m AS m_j, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM places a JOIN places b ON a.k <> b.k)"


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    m = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("k")).agg(F.count("*").alias("m"))
    return n.join(m, "k", "left").select("k", (F.col("k") * 37 % 101).alias("x"), (F.col("k") * 53 % 89).alias("y"), F.coalesce("m", F.lit(0)).alias("m"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.distances(places(spark, sf_dir))


def millionths(x) -> F.Column:
    """What engines agree on of a number that logarithms or exponentials made."""
    return F.floor(x * 1e6).cast("long")


@query(f"WITH {PLACES}, {PAIRS} SELECT i, j, m_i * m_j / (d2 + 1e-6::DOUBLE) AS flow FROM od")
def q30_gravity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.gravity(pairs(spark, sf_dir), 1e-6).select("i", "j", "flow")


@query(f"""
WITH {PLACES}, {PAIRS}, s AS (SELECT a.i, a.j, a.m_i, a.m_j, CAST(coalesce(sum(k.m_j), 0) AS BIGINT) AS s FROM od a LEFT JOIN od k ON k.i = a.i AND k.j <> a.j AND k.d2 < a.d2 GROUP BY 1, 2, 3, 4)
SELECT i, j, m_i * m_j / CAST((m_i + s) * (m_i + m_j + s) AS DOUBLE) AS flow FROM s
""")
def q31_radiation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.radiation(pairs(spark, sf_dir)).select("i", "j", "flow")


@query(f"""
WITH {PLACES}, {PAIRS}, w AS (SELECT *, exp(-0.01::DOUBLE * sqrt(d2) - max(-0.01::DOUBLE * sqrt(d2)) OVER (PARTITION BY i)) AS w FROM od)
SELECT i, j, CAST(floor(m_i * w / sum(w) OVER (PARTITION BY i) * 1e6) AS BIGINT) AS flow_millionths FROM w
""")
def q32_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.logit(pairs(spark, sf_dir)).select("i", "j", millionths(F.col("flow")).alias("flow_millionths"))


@query(f"""
WITH {PLACES}, {PAIRS}, f AS (SELECT i, j, m_i * m_j / (d2 + 1e-6::DOUBLE) AS flow FROM od)
SELECT i, j, CAST(floor(-ln(greatest(flow / sum(flow) OVER (PARTITION BY i), 1e-12::DOUBLE)) * 1e6) AS BIGINT) AS cost_millionths FROM f
""")
def q33_od_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.cost(D.gravity(pairs(spark, sf_dir))).select("i", "j", millionths(F.col("cost")).alias("cost_millionths"))


@query(f"""
WITH {PLACES}, {PAIRS}, w AS (SELECT i, j, m_j / (100.0::DOUBLE + d2) AS w FROM od), p AS (SELECT *, w / sum(w) OVER (PARTITION BY i) AS p FROM w)
SELECT i, j, CAST(floor(p / sum(p) OVER (PARTITION BY i) * 1e6) AS BIGINT) AS p_millionths FROM p WHERE p > 0.02
""")
def q34_destination_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.destination_choice(pairs(spark, sf_dir), F.col("m_j") / (100.0 + F.col("d2")), 0.02).select("i", "j", millionths(F.col("p")).alias("p_millionths"))


@query(f"""
WITH RECURSIVE {FLOWS}, {PLACES}, {PAIRS}, f AS (SELECT origin AS i, dest AS j, count(*) AS flow FROM flows GROUP BY 1, 2),
o AS (SELECT od.i, od.j, m_j, sqrt(CAST(d2 AS DOUBLE)) * 100.0::DOUBLE AS d, coalesce(flow, 0) AS n FROM od LEFT JOIN f ON od.i = f.i AND od.j = f.j WHERE m_j > 0),
p AS (SELECT i, m_j, d, floor(n * 100 / (1 + d / 500)) AS flow FROM o),
b(k, a, c) AS (SELECT 0, ln(200.0::DOUBLE), ln(200000.0::DOUBLE) UNION ALL SELECT k + 1, CASE WHEN s > 0 THEN a ELSE (a + c) / 2 END, CASE WHEN s > 0 THEN (a + c) / 2 ELSE c END FROM (SELECT k, a, c, sum(score) AS s FROM
  (SELECT k, a, c, i, sum(flow) * sum(w * d) / sum(w) - sum(flow * d) AS score FROM (SELECT k, a, c, i, d, flow, exp(ln(m_j) - exp(-(a + c) / 2) * d) AS w FROM b, p WHERE k < 60) GROUP BY k, a, c, i) GROUP BY k, a, c)),
r AS (SELECT exp(-(a + c) / 2) AS beta FROM b WHERE k = 60), e AS (SELECT i, sum(flow) AS f, sum(flow) * sum(w * d) / sum(w) - sum(flow * d) AS score, sum(flow) * (sum(w * d * d) / sum(w) - (sum(w * d) / sum(w)) * (sum(w * d) / sum(w))) AS curve FROM (SELECT p.*, exp(ln(m_j) - beta * d) AS w FROM p, r) GROUP BY i),
t AS (SELECT sqrt(sum(score * score)) / abs(sum(curve)) AS error, count(*) FILTER (WHERE f > 0) AS n, sum(f) AS trips FROM e)
SELECT CAST(floor(100 / beta) AS BIGINT) AS d0_hundredths, CAST(floor(error / (beta * beta) * 100) AS BIGINT) AS error_hundredths, n AS n_origins, CAST(trips AS DOUBLE) AS n_trips, CAST(floor(beta / error * 1000) AS BIGINT) AS z_thousandths FROM t, r
""")
def q35_gravity_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fit is a loop over aggregates; the SQL halves the bounds 60 times. Distances in tens of metres, so that the optimum is inside the bounds."""
    f = flows(spark, sf_dir).groupBy(F.col("origin").cast("long").alias("i"), F.col("dest").cast("long").alias("j")).agg(F.count("*").alias("flow"))
    od = pairs(spark, sf_dir).where("m_j > 0").withColumn("d", F.col("d") * 100.0).join(f, ["i", "j"], "left").select("i", "j", "m_j", "d", F.coalesce("flow", F.lit(0)).alias("flow"))
    # trips of the test tables do not thin out with distance: those of far pairs are thinned here
    od = od.withColumn("flow", F.floor(F.col("flow") * 100 / (1 + F.col("d") / 500)))
    s = D.fit_decay(od)
    row = (math.floor(s["d0"] * 100), math.floor(s["d0_error"] * 100), s["n_origins"], s["n_trips"], math.floor(s["z"] * 1000))
    return spark.createDataFrame([row], "d0_hundredths long, error_hundredths long, n_origins long, n_trips double, z_thousandths long")


@query("""
WITH px AS (SELECT r_regionkey AS district, c_nationkey AS cell, count(*) AS pop FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2),
w AS (SELECT district, cell, pop / CAST(sum(pop) OVER (PARTITION BY district) AS DOUBLE) AS w FROM px QUALIFY cell % 6 <> 0),
t AS (SELECT a.n_regionkey AS o, b.n_regionkey AS d, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation a ON a.n_nationkey = c_nationkey JOIN nation b ON b.n_nationkey = s_nationkey GROUP BY 1, 2)
SELECT x.cell AS origin, y.cell AS dest, CAST(floor(sum(n * x.w * y.w) * 1e6) AS BIGINT) AS flow_millionths FROM t JOIN w x ON t.o = x.district JOIN w y ON t.d = y.district GROUP BY 1, 2
""")
def q36_disaggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    px = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("district"), F.col("c_nationkey").alias("cell")).agg(F.count("*").alias("pop"))
    w = D.weights(px, nation.select(F.col("n_nationkey").alias("cell")).where("cell % 6 <> 0"))
    of = lambda k, name: nation.select(F.col("n_nationkey").alias(k), F.col("n_regionkey").alias(name))
    trips = flows(spark, sf_dir).groupBy("origin", "dest").agg(F.count("*").alias("n")).join(of("origin", "o"), "origin").join(of("dest", "d"), "dest").groupBy("o", "d").agg(F.sum("n").alias("n"))
    return D.disaggregated(trips, w).select("origin", "dest", millionths(F.col("flow")).alias("flow_millionths"))


@query(f"""
WITH {FLOWS}, f AS (SELECT CAST(origin AS BIGINT) AS i, CAST(dest AS BIGINT) AS j, count(*) AS flow FROM flows GROUP BY 1, 2),
o AS (SELECT flow, count(*) AS c FROM f GROUP BY 1), s AS (SELECT flow, sum(c) OVER () AS n, coalesce(sum(flow * c) OVER b, 0) AS below, sum(c) OVER () - coalesce(sum(c) OVER b, 0) AS more, coalesce(lag(flow) OVER (ORDER BY flow), 0) AS before FROM o WINDOW b AS (ORDER BY flow ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, CAST(below AS DOUBLE) / nullif(CAST(200 - more AS DOUBLE), 0) AS tau FROM s),
t AS (SELECT CASE WHEN max(n) <= 200 THEN 0.0 ELSE coalesce(min(tau) FILTER (WHERE more < 200 AND tau > before AND tau <= flow), max(flow)) END AS tau FROM c)
SELECT i, j, flow, greatest(CAST(flow AS DOUBLE), tau) AS kept FROM f, t WHERE flow >= tau OR ((i * 7919 + j * 104729 + 42) * 1103515245 + 12345) % 2147483648 / 2147483648.0::DOUBLE * tau < flow
""")
def q37_thinning(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = flows(spark, sf_dir).groupBy(F.col("origin").cast("long").alias("i"), F.col("dest").cast("long").alias("j")).agg(F.count("*").alias("flow"))
    return D.thinned(f, D.thinning_threshold(f, 200), D.pair_draw(F.col("i"), F.col("j"), 42)).select("i", "j", "flow", "kept")


@query(f"""
WITH {FLOWS}, f AS (SELECT origin, dest, draw, count(*) AS flow FROM flows GROUP BY 1, 2, 3), z AS (SELECT n_nationkey AS node, (n_nationkey * 29) % 83 AS z FROM nation WHERE n_nationkey <> 13)
SELECT draw, CAST(sum(flow * (b.z - a.z)) AS BIGINT) AS rise, CAST(sum(flow) FILTER (WHERE b.z - a.z IS NOT NULL) AS BIGINT) AS flow_used, count(*) FILTER (WHERE b.z - a.z IS NULL) AS n_missing FROM f LEFT JOIN z a ON f.origin = a.node LEFT JOIN z b ON f.dest = b.node GROUP BY draw
""")
def q38_net_rise(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = flows(spark, sf_dir).groupBy("origin", "dest", "draw").agg(F.count("*").alias("flow"))
    z = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), (F.col("n_nationkey") * 29 % 83).alias("z")).where("node <> 13")
    return D.net_rise(f, z, ["draw"])


#: A user's profile: an event's value as height, cents as integers, and its number as position.
PROFILE = "prof AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS s, CAST(round(value * 100) AS BIGINT) AS z FROM events)"


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    s = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, sf_dir, "events").select("user_id", "event_type", s.cast("long").alias("s"), F.round(F.col("value") * 100).cast("long").alias("z"))


@query(f"""
WITH {PROFILE}, d AS (SELECT user_id, z - lag(z) OVER (PARTITION BY user_id ORDER BY s) AS dz FROM prof)
SELECT user_id, CAST(coalesce(sum(greatest(dz, 0)), 0) AS BIGINT) AS up, CAST(coalesce(sum(greatest(-dz, 0)), 0) AS BIGINT) AS down, CAST(sum(CAST(floor(sqrt(CAST(10000 + dz * dz AS DOUBLE)) * 1000) AS BIGINT)) AS BIGINT) AS length_thousandths FROM d GROUP BY user_id
""")
def q26_uphill_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = P.steps(profile(spark, sf_dir), ["user_id"], ["s"], ["z"])
    slope = F.floor(F.sqrt((10000 + F.col("d_z") * F.col("d_z")).cast("double")) * 1000)
    return P.gains(d, ["user_id"], "d_z").join(d.groupBy("user_id").agg(F.sum(slope).alias("length_thousandths")), "user_id")


@query(f"""
WITH {PROFILE}, k AS (SELECT user_id, CAST(s * 10 AS DOUBLE) AS s, CAST(z AS DOUBLE) AS z FROM prof), l AS (SELECT user_id, max(s) AS l, greatest(ceil(max(s) / 7.0::DOUBLE) + 1, 2) AS n FROM k GROUP BY 1),
q AS (SELECT user_id, k, l * k / (n - 1) AS s FROM l, unnest(generate_series(0, CAST(n AS BIGINT) - 1)) u(k)),
a AS (SELECT q.user_id, q.k, q.s, arg_max(k.z, k.s) AS za, max(k.s) AS sa FROM q JOIN k ON q.user_id = k.user_id AND k.s <= q.s GROUP BY 1, 2, 3),
b AS (SELECT q.user_id, q.k, arg_min(k.z, k.s) AS zb, min(k.s) AS sb FROM q JOIN k ON q.user_id = k.user_id AND k.s >= q.s GROUP BY 1, 2)
SELECT a.user_id, a.k, a.s, CASE WHEN sb > sa THEN za + (zb - za) * (s - sa) / (sb - sa) ELSE za END AS z FROM a JOIN b ON a.user_id = b.user_id AND a.k = b.k
""")
def q27_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    knots = profile(spark, sf_dir).select("user_id", (F.col("s") * 10).cast("double").alias("s"), F.col("z").cast("double").alias("z"))
    return P.resampled(knots, ["user_id"], "s", "z", 7.0)


_HOLES = "holes AS (SELECT user_id, s, CASE WHEN s % 7 <> 3 AND z >= 500 THEN CAST(z AS DOUBLE) END AS z FROM prof)"


@query(f"""
WITH {PROFILE}, {_HOLES}, w AS (SELECT user_id, s, z, last_value(CASE WHEN z IS NOT NULL THEN s END IGNORE NULLS) OVER a AS sa, last_value(z IGNORE NULLS) OVER a AS za, first_value(CASE WHEN z IS NOT NULL THEN s END IGNORE NULLS) OVER b AS sb, first_value(z IGNORE NULLS) OVER b AS zb
  FROM holes WINDOW a AS (PARTITION BY user_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY user_id ORDER BY s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, s, coalesce(z, za + (zb - za) * (s - sa) / nullif(sb - sa, 0), za, zb, 0.0) AS z FROM w
""")
def q28_gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    holes = profile(spark, sf_dir).select("user_id", "s", F.when((F.col("s") % 7 != 3) & (F.col("z") >= 500), F.col("z").cast("double")).alias("z"))
    return P.filled(holes, ["user_id"], "s", "z")


@query(f"""
WITH {PROFILE}, e AS (SELECT user_id, s, CAST(z AS DOUBLE) AS z, event_type <> 'error' AS ground, event_type <> 'error' OR s = 0 OR s = max(s) OVER (PARTITION BY user_id) AS anchor FROM prof),
w AS (SELECT *, last_value(CASE WHEN anchor THEN s END IGNORE NULLS) OVER a AS sa, last_value(CASE WHEN anchor THEN z END IGNORE NULLS) OVER a AS za, first_value(CASE WHEN anchor THEN s END IGNORE NULLS) OVER b AS sb, first_value(CASE WHEN anchor THEN z END IGNORE NULLS) OVER b AS zb
  FROM e WINDOW a AS (PARTITION BY user_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY user_id ORDER BY s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT user_id, s, ground, CASE WHEN anchor THEN z ELSE za + (zb - za) * (s - sa) / (sb - sa) END AS z FROM w), d AS (SELECT user_id, ground, z - lag(z) OVER (PARTITION BY user_id ORDER BY s) AS dz FROM f)
SELECT user_id, CAST(floor(sum(greatest(dz, 0)) + 0.001) AS BIGINT) AS up, CAST(floor(sum(greatest(-dz, 0)) + 0.001) AS BIGINT) AS down, CAST(floor(sum(CASE WHEN NOT ground THEN greatest(dz, 0) ELSE 0 END) + 0.001) AS BIGINT) AS up_off, CAST(floor(sum(CASE WHEN NOT ground THEN greatest(-dz, 0) ELSE 0 END) + 0.001) AS BIGINT) AS down_off FROM d WHERE dz IS NOT NULL GROUP BY user_id
""")
def q29_tunnel_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = profile(spark, sf_dir).withColumn("z", F.col("z").cast("double")).withColumn("ground", F.col("event_type") != "error")
    anchored = P.over_anchors(p, ["user_id"], "s", "z", F.col("ground")).select("user_id", "s", "ground", F.col("anchored").alias("z"))
    g = P.gains_off_terrain(anchored, ["user_id"], "s", "z", "ground").where("up is not null or down is not null")
    return g.select("user_id", *(F.floor(F.col(c) + 0.001).alias(c) for c in ("up", "down", "up_off", "down_off")))
