"""Queries of the ranking algebra. City: nation; variant: supplier, with D the prices and H the quantities of its items; observed: the nation's first supplier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.physics import TIE_FACTOR
from ..operators import ranking as R
from ..operators.relational import with_observed
from .registry import cents, query, table

#: D and H by supplier as SQL, with the observed line's beside them.
LINES = """
lines AS (
  SELECT s_nationkey AS city, s_suppkey AS variant, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS d, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS h
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
seen AS (SELECT *, variant = min(variant) OVER (PARTITION BY city) AS observed FROM lines),
pairs AS (
  SELECT city, variant, d, h, observed, max(CASE WHEN observed THEN d END) OVER (PARTITION BY city) AS d_0, max(CASE WHEN observed THEN h END) OVER (PARTITION BY city) AS h_0
  FROM seen)
"""
T = f"CAST({TIE_FACTOR!r} AS DOUBLE)"
#: A price per unit at which energies are compared, and the bounds of a vehicle's ratio: the scale of D over H in the tables.
R_AT, R_LOW, R_HIGH = 20000.0, 1000.0, 60000.0


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(cents("l_extendedprice").alias("d"), cents("l_quantity").alias("h"))
    return sums.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").alias("city"), F.col("s_suppkey").alias("variant"), "d", "h")


def observed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    seen = lines(spark, sf_dir).withColumn("observed", F.col("variant") == F.min("variant").over(Window.partitionBy("city")))
    return with_observed(seen, ["city"], F.col("observed"), ["d", "h"])


_INTERVAL = f"""
iv AS (
  SELECT city, count(*) FILTER (WHERE NOT observed) AS n,
         greatest(0.0::DOUBLE, coalesce(max(((1.0 + {T}) * d - d_0) / nullif(h_0 - (1.0 + {T}) * h, 0)) FILTER (WHERE NOT observed AND h_0 - (1.0 + {T}) * h < 0), 0)) AS lo,
         coalesce(min(((1.0 + {T}) * d - d_0) / nullif(h_0 - (1.0 + {T}) * h, 0)) FILTER (WHERE NOT observed AND h_0 - (1.0 + {T}) * h > 0), 'Infinity'::DOUBLE) AS hi,
         coalesce(bool_or(NOT observed AND h_0 - (1.0 + {T}) * h = 0 AND (1.0 + {T}) * d - d_0 < 0), false) AS none
  FROM pairs GROUP BY city),
ranked AS (
  SELECT city, 1 + count(*) FILTER (WHERE NOT observed AND (d + {R_AT}::DOUBLE * h) * (1 + {T}) < d_0 + {R_AT}::DOUBLE * h_0) AS rank,
         (max(d_0 + {R_AT}::DOUBLE * h_0) - least(max(d_0 + {R_AT}::DOUBLE * h_0), min(d + {R_AT}::DOUBLE * h))) / least(max(d_0 + {R_AT}::DOUBLE * h_0), min(d + {R_AT}::DOUBLE * h)) AS regret
  FROM pairs GROUP BY city)
"""


@query(f"""
WITH {LINES}, {_INTERVAL},
x AS (SELECT city, n, none OR hi < lo AS nowhere, lo, hi FROM iv)
SELECT x.city, x.n AS n_alternatives, CASE WHEN NOT nowhere THEN lo END AS lo, CASE WHEN NOT nowhere THEN hi END AS hi, rank, regret,
       CASE WHEN n = 0 THEN 'constrained' WHEN NOT nowhere AND lo <= {R_LOW} AND hi >= {R_HIGH} THEN 'robust_minimum'
            WHEN nowhere OR hi < {R_LOW} OR lo > {R_HIGH} THEN 'never_minimum' ELSE 'switches' END AS status,
       coalesce(CASE WHEN NOT nowhere THEN greatest(0.0::DOUBLE, least(hi, {R_HIGH}::DOUBLE) - greatest(lo, {R_LOW}::DOUBLE)) / {R_HIGH - R_LOW}::DOUBLE END, 0.0::DOUBLE) AS share
FROM x JOIN ranked ON x.city = ranked.city
""")
def q01_classify_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = observed_lines(spark, sf_dir)
    interval = R.minimiser_intervals(df, ["city"], F.col("observed"), TIE_FACTOR)
    ranked = R.rank_and_regret(df, ["city"], F.col("observed"), R.energy(R_AT), R.energy(R_AT, "d_0", "h_0"), TIE_FACTOR)
    status = F.when(F.col("n_alternatives") == 0, "constrained").otherwise(R.status_on(F.col("lo"), F.col("hi"), R_LOW, R_HIGH))
    return interval.join(ranked, "city").select("city", "n_alternatives", "lo", "hi", "rank", "regret", status.alias("status"), R.share_of(F.col("lo"), F.col("hi"), R_LOW, R_HIGH).alias("share"))


_POINTS = "points AS (SELECT DISTINCT a.city, (b.d - a.d) / nullif(a.h - b.h, 0) AS r FROM lines a JOIN lines b ON a.city = b.city AND a.variant < b.variant WHERE (b.d - a.d) / nullif(a.h - b.h, 0) > 0)"


@query(f"WITH {LINES}, {_POINTS} SELECT city, r FROM points")
def q16_breakpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.breakpoints(lines(spark, sf_dir), ["city"], "variant")


@query(f"""
WITH {LINES}, {_POINTS}, starts AS (SELECT DISTINCT city, 0.0::DOUBLE AS lo FROM lines UNION ALL SELECT city, r FROM points),
b AS (SELECT city, lo, coalesce(lead(lo) OVER (PARTITION BY city ORDER BY lo), 'Infinity'::DOUBLE) AS hi FROM starts),
e AS (SELECT b.city, lo, hi, variant, d + (CASE WHEN isinf(hi) THEN lo + 1.0 ELSE 0.5 * (lo + hi) END) * h AS e FROM b JOIN lines ON b.city = lines.city)
SELECT city, lo, hi, string_agg(CAST(variant AS VARCHAR), ',' ORDER BY e, variant) AS variants FROM e GROUP BY city, lo, hi
""")
def q17_ranking_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ranking_intervals(lines(spark, sf_dir), ["city"], "variant", joined_by=",").withColumnRenamed("order", "variants")


@query(f"WITH {LINES} SELECT a.city, a.variant AS better, b.variant AS worse FROM lines a JOIN lines b ON a.city = b.city AND a.variant <> b.variant WHERE a.d <= b.d AND a.h <= b.h")
def q18_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = lines(spark, sf_dir).select("city", F.col("variant").alias("better"), F.col("d").alias("da"), F.col("h").alias("ha"))
    b = lines(spark, sf_dir).select("city", F.col("variant").alias("worse"), F.col("d").alias("db"), F.col("h").alias("hb"))
    return a.join(b, "city").where((F.col("better") != F.col("worse")) & R.dominates(F.col("da"), F.col("ha"), F.col("db"), F.col("hb"))).select("city", "better", "worse")


_VERTICES = "vertices AS (SELECT k * (1.0::DOUBLE - eps) AS a, k * eps AS b FROM (SELECT m * 9.81::DOUBLE / lam AS k, eps FROM (VALUES (1000.0::DOUBLE), (1600.0)) m(m), (VALUES (400.0::DOUBLE), (700.0)) l(lam), (VALUES (0.0::DOUBLE), (0.6)) e(eps)))"


@query(f"""
WITH {LINES}, {_VERTICES}, z AS (SELECT *, CAST(variant % 7 AS DOUBLE) AS z FROM pairs),
w AS (SELECT *, max(CASE WHEN observed THEN z END) OVER (PARTITION BY city) AS z_0 FROM z)
SELECT city, coalesce(bool_and(observed OR d_0 + a * h_0 + b * z_0 <= (1 + {T}) * (d + a * h + b * z)), true) AS certified FROM w, vertices GROUP BY city
""")
def q19_regen_certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = with_observed(observed_lines(spark, sf_dir).withColumn("z", (F.col("variant") % 7).cast("double")), ["city"], F.col("observed"), ["z"])
    box = spark.createDataFrame([(m, lam, e) for m in (1000.0, 1600.0) for lam in (400.0, 700.0) for e in (0.0, 0.6)], "m double, lam double, eps double")
    a, b = R.recovery_coefficients(F.col("m"), F.col("lam"), F.col("eps"), 9.81)
    return R.certified_at_vertices(df, box.select(a.alias("a"), b.alias("b")), ["city"], F.col("observed"), TIE_FACTOR)


@query("""
WITH c AS (
  SELECT c_nationkey AS city, o_orderkey % 9 + 1 AS flow, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_custkey % 11 AS BIGINT) - 5 END AS car,
         CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 13 AS BIGINT) - 6 END AS bus, CAST(o_custkey % 7 AS BIGINT) - 2 AS rail
  FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT city, CAST(sum(flow * least(car, bus, rail)) AS DOUBLE) AS worst FROM c GROUP BY city
""")
def q20_worst_case_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    costs = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), cust == F.col("c_custkey")).select(
        F.col("c_nationkey").alias("city"), (key % 9 + 1).alias("flow"), F.when(key % 4 != 0, cust % 11 - 5).alias("car"), F.when(key % 3 == 0, key % 13 - 6).alias("bus"), (cust % 7 - 2).alias("rail"))
    return R.worst_case_over_shares(costs, ["city"], "flow", ["car", "bus", "rail"])


_BOX = """
box(vehicle, m0, m1, m2, l0, l1, l2) AS (VALUES (0, 1000, 1200, 1500, 400, 585, 700), (1, 9000, 12000, 15000, 3000, 4000, 6000), (2, 150, 200, 260, 100, 150, 220)),
corners AS (SELECT vehicle, NULL::INT AS vertex, m1 AS m, l1 AS l FROM box UNION ALL SELECT vehicle, 0, m0, l0 FROM box UNION ALL SELECT vehicle, 1, m0, l2 FROM box UNION ALL SELECT vehicle, 2, m2, l0 FROM box UNION ALL SELECT vehicle, 3, m2, l2 FROM box),
diff AS (SELECT p_brand AS alternative, p_partkey % 3 AS vehicle, CAST(sum(p_size % 7 - 3) AS BIGINT) AS dh, CAST(sum(p_size % 5 - 2) AS BIGINT) AS dl FROM part GROUP BY 1, 2),
terms AS (SELECT alternative, d.vehicle, vertex, m * dh + l * dl AS term FROM diff d JOIN corners c ON d.vehicle = c.vehicle),
each AS (SELECT alternative, vehicle, max(CASE WHEN vertex IS NULL THEN term END) AS central, min(CASE WHEN vertex IS NOT NULL THEN term END) AS least FROM terms GROUP BY 1, 2)
"""


@query(f"WITH {_BOX} SELECT alternative, CAST(sum(least) AS BIGINT) AS worst, CAST(sum(central) AS BIGINT) AS central FROM each GROUP BY 1")
def q21_box_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = {0: ((1000, 1200, 1500), (400, 585, 700)), 1: ((9000, 12000, 15000), (3000, 4000, 6000)), 2: ((150, 200, 260), (100, 150, 220))}
    rows = [(v, None, m[1], lam[1]) for v, (m, lam) in boxes.items()] + [(v, 2 * i + j, m[2 * i], lam[2 * j]) for v, (m, lam) in boxes.items() for i in (0, 1) for j in (0, 1)]
    corners = F.broadcast(spark.createDataFrame(rows, "vehicle long, vertex int, m long, l long"))
    diff = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("alternative"), (F.col("p_partkey") % 3).alias("vehicle")).agg(F.sum(F.col("p_size") % 7 - 3).alias("dh"), F.sum(F.col("p_size") % 5 - 2).alias("dl"))
    terms = diff.join(corners, "vehicle").withColumn("term", F.col("m") * F.col("dh") + F.col("l") * F.col("dl"))
    return R.separable_minimum(terms, ["alternative"])


@query("""
SELECT c_mktsegment AS segment, 9.81::DOUBLE * CAST(sum(share * mass * 6) AS DOUBLE) / CAST(sum(share * lam * 10) AS DOUBLE) AS r_eff
FROM (SELECT c_mktsegment, c_custkey % 5 AS share, 1000 + c_custkey % 400 AS mass, 500 + c_custkey % 100 AS lam FROM customer) GROUP BY 1
""")
def q22_mixture_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recovery of four tenths, as whole tenths, so that all sums are exact."""
    k = F.col("c_custkey")
    ratio = R.mixture_ratio(k % 5, 1000 + k % 400, 500 + k % 100, F.lit(4), 9.81, F.lit(10))
    return table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(ratio.alias("r_eff"))


@query(f"""
WITH {LINES}, grid AS (SELECT CAST(unnest(generate_series(0, 800)) AS DOUBLE) * 100.0::DOUBLE AS r), e AS (SELECT city, r, variant, d + r * h AS e FROM lines, grid)
SELECT city, r, arg_min(variant, row(e, variant)) AS best, min(e) AS energy FROM e GROUP BY 1, 2
""")
def q25_ratio_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    swept = lines(spark, sf_dir).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(800)))).withColumn("r", F.col("i").cast("double") * 100.0)
    e = F.col("d") + F.col("r") * F.col("h")
    return swept.withColumn("e", e).groupBy("city", "r").agg(F.min_by("variant", F.struct("e", "variant")).alias("best"), F.min("e").alias("energy"))


@query(f"""
WITH {LINES}, a AS (SELECT * FROM pairs WHERE NOT observed)
SELECT city, variant, d + {R_AT}::DOUBLE * h - (d_0 + {R_AT}::DOUBLE * h_0) AS delta,
       CASE WHEN abs(d - d_0) + abs({R_AT}::DOUBLE * (h - h_0)) > 0 THEN abs(d - d_0) / (abs(d - d_0) + abs({R_AT}::DOUBLE * (h - h_0))) END AS distance_share
FROM a
""")
def q61_distance_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat, climb = F.abs(F.col("d") - F.col("d_0")), F.abs(F.lit(R_AT) * (F.col("h") - F.col("h_0")))
    df = observed_lines(spark, sf_dir).where(~F.col("observed"))
    return df.select("city", "variant", (R.energy(R_AT) - R.energy(R_AT, "d_0", "h_0")).alias("delta"), F.when(flat + climb > 0, flat / (flat + climb)).alias("distance_share"))
