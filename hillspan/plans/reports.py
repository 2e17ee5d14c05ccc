"""Queries of summaries, labels and tables that studies exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import physics as E
from ..operators import geo as G
from ..operators import ranking as K
from ..operators import relational as A
from ..operators import reports as R
from ..operators import scenario as C
from ..operators import stats as S
from ..operators import studies as T
from ..sources import tables as X
from ..sources.folders import new_folder
from .demand import PLACES, places
from .networks import _CENTRAL_SQL, _SUMS, CELLS, cells, central, scans, sums
from .ranking import LINES, R_AT, observed_lines
from .registry import query, table
from .relational import _NAMED, FLOWS, _named, flows
from .studies import q83_prepared_cities


@query("SELECT p_brand, quantile_cont(p_size, 0.0) AS least, quantile_cont(p_size, 0.25) AS q25, quantile_cont(p_size, 0.5) AS q50, quantile_cont(p_size, 0.75) AS q75, quantile_cont(p_size, 1.0) AS largest FROM part GROUP BY p_brand")
def q125_five_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(*R.five_numbers(F.col("p_size")))


@query("SELECT p_partkey, p_brand, cut FROM (SELECT *, quantile_cont(p_size, 0.9) OVER (PARTITION BY p_brand) AS cut FROM part) WHERE p_size >= cut")
def q126_highlighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.highlighted(table(spark, sf_dir, "part"), ["p_brand"], "p_size", 0.9).select("p_partkey", "p_brand", "cut")


@query("SELECT o_orderpriority AS band, floor(count(*) / CAST((SELECT count(*) FROM orders) AS DOUBLE) * 10000 + 0.5) / 10000.0::DOUBLE AS share FROM orders GROUP BY 1")
def q127_band_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.share_by_band(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("band"), F.lit(1).alias("n")), "band", "n")


@query(f"WITH {FLOWS} SELECT draw, count(*) FILTER (WHERE origin = dest) / CAST(count(*) AS DOUBLE) AS share FROM flows GROUP BY draw")
def q128_diagonal_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.diagonal_share(flows(spark, sf_dir).withColumn("n", F.lit(1)), "origin", "dest", "n", ["draw"])


@query("SELECT median(s) AS median, min(s) AS least FROM (SELECT CAST(sum(l_quantity) AS DOUBLE) AS s FROM lineitem GROUP BY l_suppkey)")
def q129_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.coverage(table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").cast("double").alias("w")), "l_suppkey", "w")


@query("SELECT c_nationkey, min((c_custkey * 7919) % 1009) AS x_min, max((c_custkey * 7919) % 1009) AS x_max, min((c_custkey * 104729) % 997) AS y_min, max((c_custkey * 104729) % 997) AS y_max FROM customer GROUP BY 1")
def q130_bounding_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return R.bounding_box(table(spark, sf_dir, "customer").select("c_nationkey", (k * 7919 % 1009).alias("x"), (k * 104729 % 997).alias("y")), ["c_nationkey"])


@query(f"WITH {LINES}, s AS (SELECT city, count(*) AS n, min(d) AS least FROM lines GROUP BY 1) SELECT city, n, least, row_number() OVER (ORDER BY n DESC, least, city) AS position FROM s")
def q131_ordered_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = observed_lines(spark, sf_dir).groupBy("city").agg(F.count("*").alias("n"), F.min("d").alias("least"))
    return R.positioned(s, [F.desc("n"), F.col("least"), F.col("city")])


@query("SELECT l_suppkey % 10 AS line, CAST(sum(CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity ELSE 0 END) AS DOUBLE) / CAST(sum(l_quantity) AS DOUBLE) AS share FROM lineitem GROUP BY 1")
def q132_terrain_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the length that lies on the terrain, by line."""
    way = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("line"), F.col("l_quantity").cast("double").alias("length"), (F.col("l_linenumber") % 3 != 0).cast("double").alias("grounded"))
    return way.groupBy("line").agg(S.weighted_mean(F.col("grounded"), F.col("length")).alias("share"))


@query(f"WITH {LINES}, t AS (SELECT city, variant, r, d + r * h < d_0 + r * h_0 AS lower FROM pairs, (VALUES (1000.0::DOUBLE), (20000.0), (60000.0)) x(r) WHERE NOT observed) SELECT city, r, count(*) AS n, count(*) FILTER (WHERE lower) AS n_met FROM t GROUP BY 1, 2")
def q133_thresholds_met(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observed_lines(spark, sf_dir).where(~F.col("observed")).withColumn("r", F.explode(F.array(F.lit(1000.0), F.lit(20000.0), F.lit(60000.0))))
    lower = F.col("d") + F.col("r") * F.col("h") < F.col("d_0") + F.col("r") * F.col("h_0")
    return R.thresholds_met(rows, ["city", "r"], lower)


@query(f"""
WITH {LINES}, z AS (SELECT variant, CASE WHEN variant % 13 <> 5 THEN variant % 7 END AS z FROM lines WHERE variant % 29 <> 3), j AS (SELECT p.*, z FROM pairs p LEFT JOIN z ON p.variant = z.variant),
s AS (SELECT city, count(*) AS n, count(*) FILTER (WHERE z IS NULL) AS n_missing, count(*) FILTER (WHERE observed) AS o FROM j GROUP BY 1)
SELECT city, n, n_missing, CASE WHEN o = 0 THEN 'incomplete' WHEN n = o THEN 'constrained' WHEN n_missing > 0 THEN 'incomplete' ELSE 'ok' END AS status FROM s
""")
def q134_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, v = observed_lines(spark, sf_dir), F.col("variant")
    z = rows.where(v % 29 != 3).select("variant", F.when(v % 13 != 5, v % 7).alias("z"))
    return R.completeness(rows, z, ["variant"], "z", ["city"], F.col("observed"))


@query(f"""
WITH {LINES}, n AS (SELECT p.city, variant, sigma, h * (1.0::DOUBLE - sigma / 16.0::DOUBLE) / h AS ratio, observed FROM pairs p, (VALUES (1), (2), (4)) s(sigma) WHERE variant % 11 <> sigma)
SELECT city, sigma, count(*) AS n_common, max(CASE WHEN observed THEN ratio END) AS observed_ratio, median(ratio) AS median_ratio FROM n GROUP BY 1, 2
""")
def q135_noise_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = observed_lines(spark, sf_dir).select("city", "variant", "h", "observed")
    smooth = raw.withColumn("sigma", F.explode(F.array(F.lit(1), F.lit(2), F.lit(4)))).where("variant % 11 <> sigma").withColumn("h", F.col("h") * (1.0 - F.col("sigma") / 16.0))
    return R.noise_summary(raw.drop("observed"), smooth, ["city"], "variant", "h", F.col("observed"))


@query(f"""
WITH {LINES}, a AS (SELECT city, variant, d AS e, observed FROM pairs), b AS (SELECT city, variant, d * (1.0::DOUBLE + (variant % 5 - 2) / 64.0::DOUBLE) AS e, observed FROM pairs WHERE variant % 9 <> 4 OR observed),
x AS (SELECT city, variant, observed, 100 * (e / max(CASE WHEN observed THEN e END) OVER (PARTITION BY city) - 1) AS pct FROM a), y AS (SELECT city, variant, observed, 100 * (e / max(CASE WHEN observed THEN e END) OVER (PARTITION BY city) - 1) AS pct FROM b),
j AS (SELECT x.city, x.variant, x.pct AS p, y.pct AS q FROM x JOIN y ON x.city = y.city AND x.variant = y.variant WHERE NOT x.observed)
SELECT city, count(*) AS n, min(p) AS least_first, arg_min(variant, row(p, variant)) AS best_first, count(*) FILTER (WHERE p < -0.05) AS n_cheaper_first, min(q) AS least_second, arg_min(variant, row(q, variant)) AS best_second, count(*) FILTER (WHERE q < -0.05) AS n_cheaper_second FROM j GROUP BY 1
""")
def q136_source_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = observed_lines(spark, sf_dir).select("city", "variant", F.col("d").alias("e"), "observed")
    second = first.where("variant % 9 <> 4 or observed").withColumn("e", F.col("e") * (1.0 + (F.col("variant") % 5 - 2) / 64.0))
    return R.source_comparison([("first", first), ("second", second)], ["city"], "variant", "e", F.col("observed"))


_DISTRICTS = [(0.0, 0.0, 400.0, 500.0), (400.0, 0.0, 1010.0, 500.0), (0.0, 500.0, 700.0, 1000.0)]


@query(f"""
WITH {CELLS}, d(district, w, s, e, n) AS (VALUES {", ".join(f"({i}, {', '.join(f'{v!r}::DOUBLE' for v in b)})" for i, b in enumerate(_DISTRICTS))}),
px AS (SELECT district, CAST(floor(x / 100.0) AS BIGINT) AS i, CAST(floor(y / 100.0) AS BIGINT) AS j, pop FROM cells JOIN d ON x + 0.5 > w AND x + 0.5 < e AND y + 0.5 > s AND y + 0.5 < n), t AS (SELECT district, sum(pop) AS total FROM px GROUP BY 1)
SELECT px.district, i, j, CAST(sum(pop) AS BIGINT) AS pop, sum(pop) / CAST(max(total) AS DOUBLE) AS weight FROM px JOIN t ON px.district = t.district GROUP BY 1, 2, 3
""")
def q137_district_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of people to districts (rings) to cells of a grid, and each cell's part of its district's people."""
    from pyspark.sql import Window

    x, y = F.col("x") + 0.5, F.col("y") + 0.5
    district = F.lit(None).cast("int")
    for i, (w, s, e, n) in reversed(list(enumerate(_DISTRICTS))):
        ring = F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in ((w, s), (e, s), (e, n), (w, n))))
        district = F.when(G.in_ring(x, y, ring), i).otherwise(district)
    i, j = G.cell_of(F.col("x"), F.col("y"), 0, 0, 100.0)
    px = cells(spark, sf_dir).select(district.alias("district"), i.alias("i"), j.alias("j"), "pop").where("district is not null")
    s = px.groupBy("district", "i", "j").agg(F.sum("pop").alias("pop"))
    return s.withColumn("weight", F.col("pop") / F.sum("pop").over(Window.partitionBy("district")))


_ASKED = "asked AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'rot_' || CASE WHEN c_custkey % 2 = 0 THEN '+' ELSE '-' END || (c_custkey % 12) || 'deg' WHEN 1 THEN 'scale_ns_' || (c_custkey % 2) || '.' || (c_custkey % 10) ELSE 'trans_' || (c_custkey % 40 * 50) || 'm_a+090' END AS name FROM customer)"


@query(f"""
WITH {_NAMED}, {_ASKED}, c AS (SELECT id, name, CASE id % 3 WHEN 0 THEN 'rot_' || CASE WHEN id % 2 = 0 THEN '+' ELSE '-' END || lpad(CAST(id % 12 AS VARCHAR), 2, '0') || 'p00deg' WHEN 1 THEN 'scale_ns_' || (id % 2) || 'p' || rpad(CASE WHEN id % 10 = 0 THEN '' ELSE CAST(id % 10 AS VARCHAR) END, 2, '0') ELSE name END AS k FROM asked)
SELECT id, name, k AS canonical FROM c WHERE k NOT IN (SELECT regexp_replace(regexp_replace(name, '^graph_', ''), '\\.pkl$', '') FROM named)
""")
def q138_new_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates without a network, whatever the form of the numbers in their names."""
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("rot_"), F.when(k % 2 == 0, "+").otherwise("-"), (k % 12).cast("string"), F.lit("deg"))).when(k % 3 == 1, F.concat(F.lit("scale_ns_"), (k % 2).cast("string"), F.lit("."), (k % 10).cast("string"))).otherwise(F.concat(F.lit("trans_"), (k % 40 * 50).cast("string"), F.lit("m_a+090")))
    asked = table(spark, sf_dir, "customer").select(k.alias("id"), name.alias("name")).withColumn("canonical", N.canonical(F.col("name")))
    have = _named(spark, sf_dir).select(N.bare(F.col("name")).alias("canonical"))
    return A.not_done(asked, have, "canonical")


@query("SELECT p_partkey AS id, p_type FROM part WHERE p_partkey NOT IN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity >= 50 AND l_discount > 0.05)")
def q139_stale_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = table(spark, sf_dir, "lineitem").where("l_quantity >= 50 and l_discount > 0.05").select(F.col("l_partkey").alias("id"))
    return R.stale(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_type"), allowed, "id")


@query(f"WITH {_NAMED}, s AS (SELECT DISTINCT regexp_replace(regexp_replace(name, '^graph_', ''), '\\.pkl$', '') AS v FROM named WHERE p_partkey % 5 <> 0), g AS (SELECT DISTINCT name FROM named) SELECT name, row_number() OVER (ORDER BY name) AS position FROM g WHERE regexp_replace(regexp_replace(name, '^graph_', ''), '\\.pkl$', '') IN (SELECT v FROM s)")
def q140_listed_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in the order of their names, of variants that the statistics have on land."""
    named = _named(spark, sf_dir)
    stats = named.select(N.bare(F.col("name")).alias("variant"), (F.col("p_partkey") % 5 != 0).alias("on_land"))
    return R.listed(named.select("name").distinct(), stats, "name")


@query("SELECT DISTINCT id FROM (SELECT o_custkey AS id FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def q141_union_of_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("id"))
    return a.union(table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("id"))).distinct()


_BARE = "b AS (SELECT p_partkey, name, regexp_replace(regexp_replace(name, '^graph_', ''), '\\.pkl$', '') AS n FROM named), f AS (SELECT *, TRY_CAST(nullif(regexp_extract(n, '^scale_(ns|ew)_(\\d+)p(\\d+)$', 2), '') || '.' || nullif(regexp_extract(n, '^scale_(ns|ew)_(\\d+)p(\\d+)$', 3), '') AS DOUBLE) AS factor FROM b)"


@query(f"""
WITH {_NAMED}, {_BARE} SELECT p_partkey,
CASE WHEN contains(lower(name), 'original') THEN 'original' WHEN contains(lower(name), 'rot') THEN 'rotation' WHEN contains(lower(name), 'trans') THEN 'translation' WHEN contains(lower(name), 'scale') THEN 'scale' ELSE 'other' END AS by_word,
CASE WHEN contains(name, 'original') THEN 'original' WHEN contains(name, 'rot_') THEN 'rotation' WHEN contains(name, 'scale_') THEN 'scale' WHEN p_partkey % 8 = 3 OR contains(name, 'trans_') THEN 'translation' ELSE 'other' END AS by_kind,
CASE WHEN n LIKE 'trans%' THEN 'translation' WHEN n LIKE 'rot%' THEN 'rotation' WHEN factor > 1 THEN 'expansion' WHEN factor IS NOT NULL THEN 'contraction' ELSE 'original' END AS by_growth,
CASE WHEN n = 'original' THEN 'original' WHEN n LIKE 'trans\\_%' ESCAPE '\\' THEN 'translation' WHEN n LIKE 'rot\\_%' ESCAPE '\\' THEN 'rotation' WHEN n LIKE 'scale\\_%' ESCAPE '\\' THEN 'scale' ELSE 'other' END AS by_row,
CASE WHEN n = 'original' THEN 'original' WHEN factor > 1 THEN 'scale_up' WHEN factor IS NOT NULL THEN 'scale_down' ELSE string_split(n, '_')[1] END AS by_prefix FROM f
""")
def q142_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five ways to name a variant's family."""
    name = F.col("name")
    kind = F.when(F.col("p_partkey") % 8 == 3, "translate_x")
    prefix = F.when(N.bare(name) == "original", "original").when(N.scale_factor(name) > 1, "scale_up").when(N.scale_factor(name).isNotNull(), "scale_down").otherwise(F.split(N.bare(name), "_")[0])
    return _named(spark, sf_dir).select("p_partkey", N.kind_in(name).alias("by_word"), N.kind_of(name, kind).alias("by_kind"), N.growth(name).alias("by_growth"), N.kind_of_row(N.bare(name), F.lit(None).cast("string")).alias("by_row"), prefix.alias("by_prefix"))


@query("""
WITH a AS (SELECT p_partkey, (p_partkey % 9) * 45 AS angle, p_size * 10 AS metres, CASE p_partkey % 4 WHEN 0 THEN 'NS' WHEN 1 THEN ' East-West ' WHEN 2 THEN 'north_south' ELSE 'up' END AS text, p_size * 7 - 150 AS hundredths FROM part)
SELECT p_partkey, CASE angle % 360 WHEN 0 THEN 'east' WHEN 90 THEN 'north' WHEN 180 THEN 'west' WHEN 270 THEN 'south' ELSE angle || '°' END AS direction, CASE angle % 180 WHEN 0 THEN 'EW' WHEN 90 THEN 'NS' ELSE 'oblique' END AS axis,
CASE WHEN angle % 360 IN (0, 90) THEN metres WHEN angle % 360 IN (180, 270) THEN -metres END AS signed, CASE p_partkey % 4 WHEN 0 THEN 'ns' WHEN 1 THEN 'ew' WHEN 2 THEN 'ns' END AS scale_axis,
CASE WHEN hundredths < 0 THEN '-' ELSE '' END || abs(hundredths) // 100 || CASE WHEN abs(hundredths) % 100 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(abs(hundredths) % 100 AS VARCHAR), 2, '0'), '0') END AS shown,
CASE WHEN abs(hundredths) >= 100 THEN '%' WHEN abs(hundredths) >= 10 THEN '‰' WHEN abs(hundredths) > 0 THEN 'ppm' ELSE 'ppb' END AS unit, CASE WHEN abs(hundredths) >= 100 THEN 1 WHEN abs(hundredths) >= 10 THEN 2 ELSE 3 END AS decimals FROM a
""")
def q143_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    angle, metres, hundredths = k % 9 * 45, F.col("p_size") * 10, F.col("p_size") * 7 - 150
    text = F.when(k % 4 == 0, "NS").when(k % 4 == 1, " East-West ").when(k % 4 == 2, "north_south").otherwise("up")
    return table(spark, sf_dir, "part").select("p_partkey", N.direction(angle).alias("direction"), N.axis(angle).alias("axis"), N.signed_distance(metres, angle).alias("signed"), N.scale_axis(text).alias("scale_axis"), N.plain_number(hundredths).alias("shown"), N.unit_of(hundredths / 100.0).alias("unit"), N.decimals_of(hundredths).alias("decimals"))


@query("""
WITH v AS (SELECT c_mktsegment AS s, list(DISTINCT CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE (c_custkey % 7 - CASE WHEN c_nationkey % 3 = 0 THEN 0 ELSE 3 END) * 10.0::DOUBLE END) AS l, c_nationkey % 2 AS a, c_nationkey AS n FROM customer GROUP BY 1, 3, 4),
g AS (SELECT *, list_distinct(list_transform(list_filter(l, lambda x: abs(x) > 1e-9), lambda x: sign(x))) AS z FROM v)
SELECT s AS segment, n AS nation, CASE WHEN len(z) = 1 AND a = 0 THEN CASE WHEN z[1] > 0 THEN 'northward' ELSE 'southward' END WHEN len(z) = 1 THEN CASE WHEN z[1] > 0 THEN 'eastward' ELSE 'westward' END END AS label FROM g
""")
def q144_one_sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    v = F.when(k % 5 != 0, (k % 7 - F.when(n % 3 == 0, 0).otherwise(3)) * 10.0)
    g = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment"), n.alias("nation")).agg(F.collect_set(v).alias("l"))
    return g.select("segment", "nation", N.one_sided(F.when(F.col("nation") % 2 == 0, "ns").otherwise("ew"), F.col("l")).alias("label"))


@query("""
SELECT c_custkey, (1000 + k) * 9.81::DOUBLE * (1.0::DOUBLE - 0.5) / 700 AS low, (1200 + k) * 9.81::DOUBLE * (1.0::DOUBLE - 0.25) / 585 AS central, (1500 + k) * 9.81::DOUBLE * (1.0::DOUBLE - 0.0) / 500 AS high,
0.25::DOUBLE * (32 + k) * 6.5 * 10 AS lam, 0.02::DOUBLE * (1200 + k) * 9.81 * 100 AS friction, CAST(k AS DOUBLE) / greatest(k % 3, 1) AS guarded, abs(k - 200) <= 20 AS nearly, c_mktsegment NOT IN ('BUILDING', 'MACHINERY') AS kept FROM (SELECT *, c_custkey % 400 AS k FROM customer)
""")
def q145_vehicle_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios over a box, energy from fuel and friction, guarded divisors, tolerances and bands."""
    k = F.col("c_custkey") % 400
    low, mid, high = E.ratio_box([1000 + k, 1200 + k, 1500 + k], [F.lit(500), F.lit(585), F.lit(700)], [F.lit(0.0), F.lit(0.25), F.lit(0.5)])
    return table(spark, sf_dir, "customer").select("c_custkey", low.alias("low"), mid.alias("central"), high.alias("high"), E.fuel_to_lambda(F.lit(0.25), 32 + k, F.lit(6.5)).alias("lam"), E.friction_work(F.lit(0.02), 1200 + k, F.lit(100)).alias("friction"), (k.cast("double") / E.guarded(k % 3)).alias("guarded"), A.nearly(k, F.lit(200), 20).alias("nearly"), A.in_band(F.col("c_mktsegment"), ["BUILDING", "MACHINERY"]).alias("kept"))


@query(f"""
WITH {LINES}, p AS (SELECT city, variant, observed, d + {R_AT}::DOUBLE * h AS e, CASE WHEN variant % 6 <> 1 OR observed THEN {R_AT}::DOUBLE * h END AS vertical, d AS horizontal FROM pairs),
o AS (SELECT *, max(CASE WHEN observed THEN e END) OVER w AS e0, max(CASE WHEN observed THEN vertical END) OVER w AS v0, max(CASE WHEN observed THEN horizontal END) OVER w AS h0 FROM p WINDOW w AS (PARTITION BY city)),
x AS (SELECT city, variant, (e0 - e) / e0 * 100.0::DOUBLE AS pct, (v0 - vertical) / e0 * 100.0::DOUBLE AS pct_vertical, (h0 - horizontal) / e0 * 100.0::DOUBLE AS pct_horizontal FROM o)
SELECT city, variant, pct, pct_vertical, pct_horizontal, pct - (coalesce(pct_vertical, 0.0) + coalesce(pct_horizontal, 0.0)) AS residual FROM x
""")
def q146_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observed_lines(spark, sf_dir).select("city", "variant", "observed", (F.col("d") + F.lit(R_AT) * F.col("h")).alias("e"), F.when((F.col("variant") % 6 != 1) | F.col("observed"), F.lit(R_AT) * F.col("h")).alias("vertical"), F.col("d").alias("horizontal"))
    return R.components(rows, ["city"], F.col("observed")).select("city", "variant", "pct", "pct_vertical", "pct_horizontal", "residual")


@query("""
WITH t AS (SELECT p_partkey, [['deltaic', 'basin'], ['volcanic', 'flat_plain'], ['flat_plain'], ['inland'], ['ravines', 'island']][p_partkey % 5 + 1] AS tags FROM part)
SELECT p_partkey, CASE WHEN list_has_any(tags, ['coastal', 'island', 'deltaic', 'estuary', 'lakefront', 'water_network', 'reclaimed_land', 'coastal_constraint']) THEN 'coastal' WHEN list_has_any(tags, ['mountain_front', 'basin', 'volcanic', 'protected_area', 'relief_gradient', 'forest_edge', 'ravines']) THEN 'relief' WHEN list_has_any(tags, ['flat_plain']) THEN 'plain' END AS context FROM t
""")
def q147_context_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = [["deltaic", "basin"], ["volcanic", "flat_plain"], ["flat_plain"], ["inland"], ["ravines", "island"]]
    tags = F.element_at(F.array(*(F.array(*map(F.lit, s)) for s in sets)), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", R.context_group(tags).alias("context"))


@query(f"""
WITH {LINES}, s AS (SELECT city, 100.0::DOUBLE * (min(CASE WHEN NOT observed THEN d END) / max(CASE WHEN observed THEN d END) - 1.0) AS p FROM pairs GROUP BY 1)
SELECT city, p AS nearest_pct, CASE WHEN p IS NULL THEN 'undetermined' WHEN p <= 0.2 THEN 'near_flat' WHEN p >= 1 THEN 'clear_increase' ELSE 'moderate_increase' END AS shape FROM s
""")
def q148_profile_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.profile_shape(observed_lines(spark, sf_dir), ["city"], "d", F.col("observed"))


@query(f"WITH {_NAMED} SELECT p_partkey, name FROM named WHERE NOT coalesce(TRY_CAST(nullif(regexp_extract(name, '^(graph_)?trans_(\\d+)m_a', 2), '') AS DOUBLE) < 200, false)")
def q149_long_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = F.coalesce(N.translation_m(F.col("name")) < N.SHORTEST_TRANSLATION_M, F.lit(False))
    return _named(spark, sf_dir).where(~short).select("p_partkey", "name")


@query(f"""
WITH RECURSIVE {CELLS}, m AS (SELECT *, median(flat) OVER (PARTITION BY city) AS m FROM cells), c AS (SELECT city, CAST(cell AS BIGINT) AS cell, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(climb AS BIGINT) AS climb FROM m WHERE abs(flat - m) <= 0.1::DOUBLE * m),
rel(r) AS (VALUES (1.0::DOUBLE)), {scans(2, 2, 150.0)}, j AS (SELECT la.city, n, la.p AS a, lb.p AS b, len(la.p) = 2 AND len(lb.p) = 2 AS f FROM la JOIN lb ON la.city = lb.city JOIN sz ON sz.city = la.city)
SELECT city, n AS n_comparable, f AS feasible, CASE WHEN f THEN array_to_string(list_transform(a, lambda q: q.cell), ' ') ELSE '' END AS favourable, CASE WHEN f THEN array_to_string(list_transform(b, lambda q: q.cell), ' ') ELSE '' END AS unfavourable FROM j
""")
def q150_fixed_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan in order; tests hold it against plain Python as well."""
    s = R.fixed_selection(cells(spark, sf_dir), ["city"], 0.1, 150.0, 2, 2)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c)
    return s.select("city", "n_comparable", "feasible", text("favourable"), text("unfavourable"))


_TIE = E.TIE_FACTOR


@query(f"""
WITH {LINES}, z AS (SELECT *, CAST(variant % 7 AS DOUBLE) AS z FROM pairs), w AS (SELECT *, max(CASE WHEN observed THEN z END) OVER (PARTITION BY city) AS z_0 FROM z),
k(a, b) AS (VALUES (1000.0::DOUBLE, 0.0::DOUBLE), (20000.0, 5000.0), (60000.0, 0.0))
SELECT city, coalesce(bool_and(observed OR d_0 + a * h_0 + b * z_0 <= (1 + {_TIE!r}::DOUBLE) * (d + a * h + b * z)), true) AS with_z, coalesce(bool_and(observed OR d_0 + a * h_0 + b * 0.0::DOUBLE <= (1 + {_TIE!r}::DOUBLE) * (d + a * h + b * 0.0::DOUBLE)), true) AS without_z FROM w, k GROUP BY city
""")
def q151_certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Certified with the net rise and without it."""
    df = A.with_observed(observed_lines(spark, sf_dir).withColumn("z", (F.col("variant") % 7).cast("double")), ["city"], F.col("observed"), ["z"])
    v = spark.createDataFrame([(1000.0, 0.0), (20000.0, 5000.0), (60000.0, 0.0)], "a double, b double")
    with_z = K.certified_at_vertices(df, v, ["city"], F.col("observed"), _TIE).withColumnRenamed("certified", "with_z")
    flat = df.withColumns({"z": F.lit(0.0), "z_0": F.lit(0.0)})
    return with_z.join(K.certified_at_vertices(flat, v, ["city"], F.col("observed"), _TIE).withColumnRenamed("certified", "without_z"), "city")


@query(f"""
WITH {_SUMS}, {_CENTRAL_SQL}, t(factor) AS (VALUES (1.0::DOUBLE), (2.0::DOUBLE)), e AS (SELECT variant, factor, s.mode, (mass * 9.81::DOUBLE * (1.0::DOUBLE - recovery) * (climb + (factor - 1.0::DOUBLE) * climb_off) + lam * length) / occupancy AS e, variant = (SELECT min(variant) FROM sums) AS o FROM sums s JOIN central c ON s.mode = c.mode, t),
f AS (SELECT *, unnest(['all', CASE WHEN right(variant, 1) IN ('1', '3', '5') THEN 'odd' ELSE 'even' END]) AS family FROM e WHERE NOT o), g AS (SELECT * FROM f UNION ALL SELECT e.*, family FROM e, (SELECT DISTINCT family FROM f) WHERE o),
x AS (SELECT *, max(CASE WHEN o THEN e END) OVER (PARTITION BY factor, mode, family) AS e0 FROM g),
s AS (SELECT factor, mode, family, max(e0) AS e0, min(e) FILTER (WHERE NOT o) AS b, arg_min(variant, row(e, variant)) FILTER (WHERE NOT o) AS best, count(*) FILTER (WHERE NOT o) AS n, 1 + count(*) FILTER (WHERE NOT o AND e < e0) AS rank FROM x GROUP BY 1, 2, 3)
SELECT factor, mode, family, n AS n_alternatives, rank = 1 AS is_minimum, rank, 100 * (e0 - least(e0, b)) / least(e0, b) AS regret_pct, 100 * (b - e0) / e0 AS margin_pct, best FROM s WHERE e0 IS NOT NULL
""")
def q152_scenario_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modes by tunnel factors by families, each against the observed variant."""
    cases = sums(spark, sf_dir).withColumn("factor", F.explode(F.array(F.lit(1.0), F.lit(2.0))))
    e = C.energies(cases, central(spark), ["variant", "factor"], F.col("factor"))
    first = sums(spark, sf_dir).agg(F.min("variant")).first()[0]
    families = F.array(F.lit("all"), F.when(F.right("variant", F.lit(1)).isin("1", "3", "5"), "odd").otherwise("even"))
    return R.scenario_grid(e, ["factor", "mode"], "variant", families, F.col("variant") == first).where("margin_pct is not null")


_TERMS = "terms AS (SELECT p_size % 2 AS mode, p_partkey AS cell, p_partkey % 3 AS vehicle, v AS vertex, CASE WHEN v IS NULL THEN 10 ELSE 8 + 2 * v END * (p_partkey * 31 % 607) AS term FROM part, (VALUES (NULL), (0), (1), (2)) x(v) UNION ALL SELECT p_size % 2, p_partkey, 3 + p_partkey % 2, v, CASE WHEN v IS NULL THEN 5 ELSE 4 + v END * (p_partkey * 17 % 401) FROM part, (VALUES (NULL), (0), (2)) x(v))"


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mode, cell, vehicle, vertex, term: two vehicles a cell, with the vertices of their boxes."""
    k, vertex = F.col("p_partkey"), F.col("vertex")
    cases = lambda *v: F.explode(F.array(F.lit(None).cast("int"), *(F.lit(x) for x in v)))
    part = table(spark, sf_dir, "part")
    a = part.withColumn("vertex", cases(0, 1, 2)).select((F.col("p_size") % 2).alias("mode"), k.alias("cell"), (k % 3).alias("vehicle"), "vertex", (F.when(vertex.isNull(), 10).otherwise(8 + 2 * vertex) * (k * 31 % 607)).alias("term"))
    b = part.withColumn("vertex", cases(0, 2)).select((F.col("p_size") % 2).alias("mode"), k.alias("cell"), (3 + k % 2).alias("vehicle"), "vertex", (F.when(vertex.isNull(), 5).otherwise(4 + vertex) * (k * 17 % 401)).alias("term"))
    return a.unionByName(b)


_ORDER = """
c AS (SELECT cell, sum(term) AS t FROM terms WHERE vertex IS NULL GROUP BY 1), lo AS (SELECT cell FROM c ORDER BY t, cell LIMIT 40), hi AS (SELECT cell FROM c ORDER BY t DESC, cell LIMIT 40),
d AS (SELECT a.mode, a.vehicle, a.cell AS cheap, b.cell AS dear, min(b.term - a.term) AS d FROM terms a JOIN terms b ON a.mode = b.mode AND a.vehicle = b.vehicle AND a.vertex = b.vertex WHERE a.cell IN (SELECT cell FROM lo) AND b.cell IN (SELECT cell FROM hi) GROUP BY 1, 2, 3, 4),
p AS (SELECT mode, cheap, dear, sum(d) AS worst FROM d GROUP BY 1, 2, 3)"""


def _chosen(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    c = t.where("vertex is null").groupBy("cell").agg(F.sum("term").alias("t"))
    return c.orderBy("t", "cell").limit(40), c.orderBy(F.desc("t"), "cell").limit(40)


@query(f"WITH {_TERMS}, {_ORDER} SELECT mode, count(*) AS n_pairs, count(*) FILTER (WHERE worst < 0) AS n_failing, CAST(min(worst) AS BIGINT) AS worst, min(worst) >= 0 AS holds FROM p GROUP BY 1")
def q153_pair_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 40 cheapest places against the 40 dearest, over all parameters of a box: a report's choice."""
    t = terms(spark, sf_dir)
    return R.pair_order(t, *_chosen(t), ["mode"])


@query(f"WITH {_TERMS}, {_ORDER} SELECT mode, count(*) AS n_pairs, count(*) FILTER (WHERE worst < 0) AS n_failing, CAST(min(worst) AS BIGINT) AS worst, min(worst) >= 0 AS holds FROM p GROUP BY 1")
def q154_order_from_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the table that a run has saved, without routing again."""
    path = new_folder(spark, "terms")
    terms(spark, sf_dir).write.parquet(path)
    t = spark.read.parquet(path)
    return R.pair_order(t, *_chosen(t), ["mode"])


@query(f"""
WITH {_SUMS}, {_CENTRAL_SQL}, sh(mode, share) AS (VALUES ('car', 0.5::DOUBLE), ('bus', 0.25::DOUBLE), ('rail', 0.25::DOUBLE)), e AS (SELECT variant, s.mode, (mass * 9.81::DOUBLE * (1.0::DOUBLE - recovery) * climb + lam * length) / occupancy * share AS e, length * share AS l FROM sums s JOIN central c ON s.mode = c.mode JOIN sh ON s.mode = sh.mode)
SELECT variant, mode, e, e / l AS e_per_metre, e / sum(e) OVER (PARTITION BY variant ORDER BY mode ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS e_share FROM e
""")
def q155_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = spark.createDataFrame([("car", 0.5), ("bus", 0.25), ("rail", 0.25)], "mode string, share double")
    return R.breakdown(sums(spark, sf_dir), central(spark), ["variant"], shares)


_PREPARED_VIEWS = """
SELECT city, 'city' AS kind, count(*) AS n, count(*) FILTER (WHERE lower) AS n_lower, min(delta_pct) AS least_pct FROM prepared WHERE status = 'ok' GROUP BY city
UNION ALL SELECT DISTINCT city, status, 0, 0, NULL::DOUBLE FROM prepared WHERE status <> 'ok'"""


def _prepared_sql() -> str:
    from .registry import ORACLES

    return f"WITH prepared AS ({ORACLES['q83_prepared_cities']}) {_PREPARED_VIEWS}"


@query(_prepared_sql())
def q156_summary_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cities' counts and the cities without a result, two of a study's four tables, as one."""
    rows = q83_prepared_cities(spark, sf_dir).withColumns({"family": F.lit(""), "parameter": F.lit(0.0)})
    v = R.views(rows)
    cities = v["cities"].select("city", F.lit("city").alias("kind"), "n", "n_lower", "least_pct")
    return cities.unionByName(v["errors"].select("city", F.col("status").alias("kind"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("n_lower"), F.lit(None).cast("double").alias("least_pct")))


@query("SELECT filename, length / n AS length, climb / n AS climb FROM (SELECT p_brand AS filename, CAST(sum(p_size * 10) AS DOUBLE) AS length, CAST(sum(p_size % 9) AS DOUBLE) AS climb, count(*) AS n FROM part GROUP BY 1)")
def q157_per_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("filename")).agg(F.sum(F.col("p_size") * 10).alias("road_L"), F.sum(F.col("p_size") % 9).alias("road_Hu"), F.count("*").alias("road_F"))
    s = X.long_sums(wide)
    of = lambda m: F.max(F.when(F.col("measure") == m, F.col("value")))
    return s.groupBy("filename").agg((of("L") / of("F")).alias("length"), (of("Hu") / of("F")).alias("climb"))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (3, 7, 11)")
def q158_required_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([(3,), (7,), (11,), (7,)], "k long")
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), "n_name")
    return R.required(rows, wanted, "k").select(F.col("k").alias("n_nationkey"), "n_name")


@query(f"WITH {PLACES} SELECT k, 'city ' || k || CASE WHEN k % 3 <> 0 THEN '; x=' || x ELSE '' END || CASE WHEN k % 4 <> 0 THEN '; y=' || y ELSE '' END AS marker FROM places")
def q159_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    text = R.marker(F.concat(F.lit("city "), k.cast("string")), [("x", F.when(k % 3 != 0, F.col("x"))), ("y", F.when(k % 4 != 0, F.col("y")))])
    return places(spark, sf_dir).select("k", text.alias("marker"))


@query("SELECT p_partkey, TRY_CAST(nullif(regexp_extract('graph_trans_' || p_size || CASE WHEN p_partkey % 2 = 0 THEN '.5' ELSE '' END || 'm_a', 'trans_(\\d+(?:\\.\\d+)?)m', 1), '') AS DOUBLE) AS metres FROM part")
def q160_metres_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("graph_trans_"), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, ".5").otherwise(""), F.lit("m_a"))
    return table(spark, sf_dir, "part").select("p_partkey", N.metres_in(text).alias("metres"))


@query(f"WITH {PLACES} SELECT k, x / 8.0::DOUBLE AS x, y / 8.0::DOUBLE AS y FROM places")
def q161_checked_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes moved again must lie where the stored variant has them."""
    at = places(spark, sf_dir).select("k", (F.col("x") / 8.0).alias("x"), (F.col("y") / 8.0).alias("y"))
    path = new_folder(spark, "variant")
    at.select("k", (F.col("x") + 1e-9).alias("x"), "y").write.parquet(path)
    return R.near_stored(at, spark.read.parquet(path), ["k"])


@query(f"WITH {PLACES}, l AS (SELECT p.k % 4 AS kind, [p.x, q.x, p.x + q.x] AS xs, [p.y, q.y, p.y - q.y] AS ys FROM places p JOIN places q ON q.k = p.k + 1), i AS (SELECT *, unnest([1, 2]) AS i FROM l) SELECT kind, xs[i] AS x0, ys[i] AS y0, xs[i + 1] AS x1, ys[i + 1] AS y1 FROM i")
def q162_segments_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda n: places(spark, sf_dir).select(F.col("k").alias(n), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"))
    j = at("u").join(at("v"), F.col("v") == F.col("u") + 1)
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    c = F.col
    line = F.array(p(c("xu"), c("yu")), p(c("xv"), c("yv")), p(c("xu") + c("xv"), c("yu") - c("yv")))
    return R.segments(j.select((c("u") % 4).alias("kind"), line.alias("g")), "kind", "g")


@query(f"""
WITH {LINES}, e AS (SELECT city, variant, d + {R_AT}::DOUBLE * h AS e, observed FROM pairs), s AS (SELECT city, min({{'e': e, 'variant': variant, 'observed': observed}}) AS b, max(CASE WHEN observed THEN e END) AS e_0, count(*) FILTER (WHERE NOT observed) AS n, count(*) AS m FROM e GROUP BY 1)
SELECT city FROM s WHERE n > 0 AND (b.observed OR abs(100.0::DOUBLE * (b.e / e_0 - 1.0::DOUBLE)) < 0.05) AND m % 2 = 0 AND city <> 9
""")
def q163_shown_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observed_lines(spark, sf_dir).select("city", "variant", (F.col("d") + F.lit(R_AT) * F.col("h")).alias("e"), "observed")
    complete = rows.groupBy("city").agg(F.count("*").alias("n")).where("n % 2 = 0")
    return R.shown_cities(T.summary(rows), complete, [9])


@query("""
WITH t AS (SELECT p_type AS city, p_partkey AS id, p_size AS v FROM part), o AS (SELECT city, id, v + 100 AS v FROM t WHERE city IN ('SMALL', 'PROMO'))
SELECT city, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, max(source) AS source FROM (SELECT *, 'other' AS source FROM o UNION ALL SELECT *, 'default' FROM t WHERE city NOT IN (SELECT city FROM o)) WHERE city <> 'LARGE' GROUP BY 1
""")
def q164_substituted_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cities of a catalogue without the excluded ones, some with another table in place of their own."""
    path = new_folder(spark, "tables")
    t = table(spark, sf_dir, "part").select(F.col("p_type").alias("city"), F.col("p_partkey").alias("id"), F.col("p_size").alias("v"))
    X.write_results(t, f"{path}/default")
    X.write_results(t.where("city in ('SMALL', 'PROMO')").withColumn("v", F.col("v") + 100), f"{path}/other")
    columns = X.schema(**{f.name: f.dataType for f in t.schema})
    default = X.existing_or(spark, f"{path}/none", f"{path}/default", columns)
    other = X.existing_or(spark, f"{path}/other", f"{path}/default", columns)
    rows = R.substituted(default, other, ["city"])
    kept = R.catalogue(rows, ["LARGE"])
    return rows.join(kept, "city", "left_semi").groupBy("city").agg(F.count("*").alias("n"), F.sum("v").cast("long").alias("total"), F.max("source").alias("source"))


@query("""
WITH w AS (SELECT c_nationkey AS o, o_orderkey % 25 AS d, o_orderkey % 4 AS n FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT 'geolocated' AS source, CAST(o AS VARCHAR) AS origin, CAST(d AS VARCHAR) AS dest, CAST(sum(CASE WHEN n > 0 THEN n ELSE 0 END + CASE WHEN n > 2 THEN 1 ELSE 0 END) AS DOUBLE) AS flow FROM w WHERE n > 0 GROUP BY 1, 2, 3
UNION ALL SELECT 'mitma_far', CAST(o AS VARCHAR), CAST(d AS VARCHAR), CAST(sum(n) AS DOUBLE) FROM w WHERE o <> d GROUP BY 1, 2, 3 HAVING sum(n) > 0
""")
def q165_named_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A city's trips by the name of their source."""
    w = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("cell_origin"), (F.col("o_orderkey") % 25).alias("cell_destination"), (F.col("o_orderkey") % 4).alias("count"))
    folder = new_folder(spark, "city")
    X.write_results(w, f"{folder}/od_work")
    X.write_results(w.where("count > 2").withColumn("count", F.lit(1)), f"{folder}/od_holiday")
    X.write_results(w.where("cell_origin <> cell_destination").groupBy("cell_origin", "cell_destination").agg(F.sum("count").alias("count")), f"{folder}/od_weekday_far")
    out = [X.flows_of(spark, folder, s).select(F.lit(s).alias("source"), "origin", "dest", "flow") for s in ("geolocated", "mitma_far")]
    return out[0].unionByName(out[1])


@query(f"WITH {PLACES}, a AS (SELECT DISTINCT l_suppkey % 25 AS u, l_partkey % 25 AS v FROM lineitem) SELECT u, v, p.x AS ux, q.y AS vy FROM a JOIN places p ON p.k = u JOIN places q ON q.k = v")
def q166_stored_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A network as tables of nodes and arcs, written and read again."""
    path = new_folder(spark, "graph")
    arcs_ = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 25).alias("u"), (F.col("l_partkey") % 25).alias("v")).distinct()
    X.write_graph(places(spark, sf_dir), arcs_, path)
    nodes, arcs_ = X.read_graph(spark, path)
    return arcs_.join(nodes.select(F.col("k").alias("u"), F.col("x").alias("ux")), "u").join(nodes.select(F.col("k").alias("v"), F.col("y").alias("vy")), "v").select("u", "v", "ux", "vy")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS cell, n_nationkey * 4.0::DOUBLE + 2.0 AS cent_x, n_nationkey * 2.0::DOUBLE + 1.0 AS cent_y, n_nationkey * 4.0::DOUBLE AS x0, n_nationkey * 2.0::DOUBLE + 2.0 AS y2 FROM nation")
def q167_cell_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells as polygons in a frame of metres (here: eight to a degree), with their centres."""
    k = F.col("n_nationkey")
    c = X.normalised_cells(table(spark, sf_dir, "nation").select(k.alias("cell_id"), (k * 0.5).alias("lon_min"), (k * 0.25).alias("lat_min"), (k * 0.5 + 0.5).alias("lon_max"), (k * 0.25 + 0.25).alias("lat_max")))
    p = X.cell_polygons(c, lambda lon, lat: (lon * 8, lat * 8))
    return p.select("cell", "cent_x", "cent_y", F.element_at("ring", 1)["x"].alias("x0"), F.element_at("ring", 3)["y"].alias("y2"))


@query("SELECT n_nationkey AS key, 5 AS n_points, n_nationkey * 0.5::DOUBLE AS first_x, n_nationkey * 0.25::DOUBLE + 1 AS top, 4 AS n_box, n_nationkey + 10.0::DOUBLE AS box_x FROM nation")
def q168_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds as a closed ring, and a city's box from JSON pairs of latitude and longitude."""
    k = F.col("n_nationkey")
    ring = X.box_ring(k * 0.5, k * 0.25, k * 0.5 + 1, k * 0.25 + 1)
    text = F.concat(F.lit("[[1, "), (k + 10).cast("string"), F.lit("], [2, 3], [4, 5], [6, 7]]"))
    box = X.lat_lon_box(text)
    return table(spark, sf_dir, "nation").select(k.alias("key"), F.size(ring).alias("n_points"), F.element_at(ring, 1)["x"].alias("first_x"), F.element_at(ring, 3)["y"].alias("top"), F.size(box).alias("n_box"), F.element_at(box, 1)["x"].alias("box_x"))


@query(f"""
WITH {PLACES}, p AS (SELECT k % 3 AS kind, k, '<Placemark><name>N&amp;' || k || '</name><description>&lt;' || m || '</description>' || CASE k % 3 WHEN 0 THEN '<Point><coordinates>' || x || ',' || y || '</coordinates></Point>' WHEN 1 THEN '<LineString><coordinates>' || x || ',' || y || ' ' || y || ',' || x || '</coordinates></LineString>' ELSE '<Polygon><outerBoundaryIs><LinearRing><coordinates>' || x || ',' || y || ' ' || y || ',' || x || '</coordinates></LinearRing></outerBoundaryIs></Polygon>' END || '</Placemark>' AS t FROM places)
SELECT kind, '<Folder><name>' || kind || '</name>' || string_agg(t, '' ORDER BY k) || '</Folder>' AS kml FROM p GROUP BY kind
""")
def q169_kml_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, x, y = F.col("k"), F.col("x"), F.col("y")
    name, said = F.concat(F.lit("N&"), k.cast("string")), F.concat(F.lit("<"), F.col("m").cast("string"))
    pts = F.array(F.struct(x.alias("x"), y.alias("y")), F.struct(y.alias("x"), x.alias("y")))
    mark = F.when(k % 3 == 0, X.kml_point(name, x, y, said)).when(k % 3 == 1, X.kml_line(name, pts, said)).otherwise(X.kml(name, pts, said))
    return X.kml_folders(places(spark, sf_dir).select((k % 3).alias("kind"), "k", mark.alias("t")), "kind", "k", "t")


@query("SELECT n_regionkey, to_json(list({'n_regionkey': n_regionkey, 'n_nationkey': n_nationkey, 'n_name': n_name} ORDER BY n_name)) AS json FROM nation GROUP BY 1")
def q170_summary_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.summary_json(table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", "n_name"), ["n_regionkey"], F.col("n_name")).withColumn("json", F.col("json").cast("string"))


@query("""
WITH w AS (SELECT p_brand AS g, CAST(p_size AS BIGINT) AS x, p_partkey % 7 AS w FROM part), s AS (SELECT g, CAST(count(*) AS DOUBLE) AS n, sum(x) AS sx, sum(x * x) AS sxx, CAST(sum(x * w) AS DOUBLE) / CAST(sum(w) AS DOUBLE) AS mean FROM w GROUP BY g)
SELECT g, mean FROM s
""")
def q171_weighted_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("g"), F.col("p_size").cast("long").alias("x"), (F.col("p_partkey") % 7).alias("w"))
    return p.groupBy("g").agg((F.sum(F.col("x") * F.col("w")).cast("double") / F.sum("w").cast("double")).alias("mean"))


@query("""
WITH c AS (SELECT (c_custkey % 12 + 1) * 250 AS distance, c_custkey // 12 % 4 * 90 AS angle, min(c_acctbal) < 0 AND c_custkey % 12 < 8 + c_custkey // 12 % 4 AS ok FROM customer GROUP BY c_custkey % 12, c_custkey // 12 % 4),
s AS (SELECT min(distance) AS stop FROM (SELECT distance FROM c GROUP BY 1 HAVING NOT bool_or(ok)))
SELECT distance, angle FROM c, s WHERE ok AND (stop IS NULL OR distance < stop)
""")
def q172_admissible_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").groupBy((key % 12).alias("k"), (F.floor(key / 12) % 4).alias("a")).agg(F.min("c_acctbal").alias("least"))
    c = c.select(((F.col("k") + 1) * 250).alias("distance"), (F.col("a") * 90).alias("angle"), ((F.col("least") < 0) & (F.col("k") < 8 + F.col("a"))).alias("ok"))
    return G.admissible_distances(c, "distance", "ok").select("distance", "angle")


@query(f"WITH {LINES}, t AS (SELECT a.city, a.variant AS a, b.variant AS b FROM lines a JOIN lines b ON a.city = b.city AND a.variant <> b.variant WHERE a.d + 1000.0::DOUBLE * a.h <= (b.d + 1000.0::DOUBLE * b.h) * (1 + 0.01::DOUBLE) AND a.d + 60000.0::DOUBLE * a.h <= (b.d + 60000.0::DOUBLE * b.h) * (1 + 0.01::DOUBLE)) SELECT city, a, b FROM t")
def q173_no_more_costly(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (observed_lines(spark, sf_dir).select("city", F.col("variant").alias(n), F.col("d").alias(f"d{n}"), F.col("h").alias(f"h{n}")) for n in "ab")
    c = F.col
    return a.join(b, "city").where((c("a") != c("b")) & K.no_more_costly(c("da"), c("ha"), c("db"), c("hb"), 1000.0, 60000.0, 0.01)).select("city", "a", "b")


@query("SELECT c_nationkey, CAST(count(*) AS BIGINT) AS n, CAST(floor(CASE WHEN count(*) > 1 THEN stddev_samp(x) ELSE 0 END * 1e6) AS BIGINT) AS millionths FROM (SELECT c_nationkey, CAST(c_custkey % 8 AS DOUBLE) AS x FROM customer) GROUP BY 1")
def q174_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = (F.col("c_custkey") % 8).cast("double")
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.floor(S.sample_or_population_sd(x) * 1e6).alias("millionths"))


@query("SELECT p_partkey, floor(radians(lon) * 6378137.0::DOUBLE) AS x, floor(ln(tan(3.141592653589793::DOUBLE / 4 + radians(lat) / 2)) * 6378137.0::DOUBLE) AS y FROM (SELECT p_partkey, p_partkey % 350 - 175.0::DOUBLE AS lon, p_partkey % 160 - 80.0::DOUBLE AS lat FROM part)")
def q175_web_metres(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    x, y = G.to_web_mercator(k % 350 - F.lit(175.0), k % 160 - F.lit(80.0))
    return table(spark, sf_dir, "part").select("p_partkey", F.floor(x).cast("double").alias("x"), F.floor(y).cast("double").alias("y"))


@query(f"WITH {PLACES} SELECT count(*) AS n, true AS degrees, false AS metres FROM places")
def q176_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The guard against other units, on degrees and on metres."""
    p = places(spark, sf_dir)
    degrees, metres = G.looks_like_degrees(p.select("x", "y")), G.looks_like_degrees(p.select((F.col("x") * 1000).alias("x"), "y"))
    return p.agg(F.count("*").alias("n")).withColumn("degrees", F.lit(degrees)).withColumn("metres", F.lit(metres))


@query("SELECT p_brand AS variant, 'observed' AS type, CAST(sum(p_size) AS DOUBLE) AS z_mean, max(p_size) > 30 AS on_land FROM part GROUP BY 1")
def q177_stats_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics' format, written and read again."""
    s = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("variant")).agg(F.sum("p_size").cast("double").alias("z_mean"), F.when(F.max("p_size") > 30, "True").otherwise("False").alias("on_land"))
    full = s.select(*((F.col(f.name) if f.name in s.columns else F.lit("observed") if f.name == "type" else F.lit(None)).cast(f.dataType).alias(f.name) for f in X.STATS))
    path = new_folder(spark, "stats")
    X.write_results(X.checked(full, X.STATS), path)
    return X.read_stats(spark, path).select("variant", "type", "z_mean", "on_land")


@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY 1, 2")
def q178_hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.events import hourly

    folder = new_folder(spark, "hourly-in")
    table(spark, sf_dir, "events").write.parquet(f"{folder}/day")
    return hourly(spark, folder).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(f"""
WITH {PLACES}, r AS (SELECT k, radians(x / 10.0::DOUBLE) AS lon, radians(y / 10.0::DOUBLE) AS lat, radians(5.0::DOUBLE) AS lon0, radians(4.0::DOUBLE) AS lat0 FROM places),
c AS (SELECT *, acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, sin(lat0) * sin(lat) + cos(lat0) * cos(lat) * cos(lon - lon0)))) AS c FROM r)
SELECT c.k, CAST(floor(6371000.0::DOUBLE * (CASE WHEN sin(c) = 0 THEN 1.0 ELSE c / sin(c) END) * cos(lat) * sin(lon - lon0) / 10) AS BIGINT) AS east_dam, CAST(floor(x * 1000.0 + 0.5) AS BIGINT) AS lon_e4, CAST(floor(y * 1000.0 + 0.5) AS BIGINT) AS lat_e4 FROM c JOIN places p ON p.k = c.k
""")
def q179_metric_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees to metres about a centre and back."""
    lon0, lat0 = F.lit(5.0), F.lit(4.0)
    x, y = G.to_metric(F.col("x") / 10.0, F.col("y") / 10.0, lon0, lat0)
    m = places(spark, sf_dir).select("k", x.alias("mx"), y.alias("my"))
    lon, lat = G.to_lonlat(F.col("mx"), F.col("my"), lon0, lat0)
    return m.select("k", F.floor(F.col("mx") / 10).alias("east_dam"), F.floor(lon * 10000 + 0.5).alias("lon_e4"), F.floor(lat * 10000 + 0.5).alias("lat_e4"))


@query(f"""
WITH {LINES}, s AS (SELECT city, list(variant) FILTER (WHERE d < d_0) AS a, list(variant) FILTER (WHERE h < h_0) AS b FROM pairs GROUP BY 1), t AS (SELECT city, coalesce(a, []) AS a, coalesce(b, []) AS b FROM s)
SELECT city, len(list_intersect(a, b)) / nullif(CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE), 0) AS jaccard FROM t
""")
def q180_common_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants that are shorter, and those that climb less: how much the two choices have in common."""
    of = lambda c: F.collect_list(F.when(F.col(c) < F.col(f"{c}_0"), F.col("variant")))
    s = observed_lines(spark, sf_dir).groupBy("city").agg(of("d").alias("a"), of("h").alias("b"))
    return s.select("city", S.jaccard(F.col("a"), F.col("b")).alias("jaccard"))


@query(f"""
WITH {_CENTRAL_SQL}, f AS (SELECT 1 + n_regionkey / 4.0::DOUBLE AS factor, count(*) AS n_cities FROM nation GROUP BY 1), b AS (SELECT 8 + count(*) FILTER (WHERE l_returnflag = 'R') / CAST(count(*) AS DOUBLE) AS riders FROM lineitem) SELECT factor, n_cities, mode, CASE WHEN mode IN ('bus', 'rail') THEN mass * factor ELSE mass END AS mass, CASE WHEN mode IN ('bus', 'rail') THEN lam * factor ELSE lam END AS lam, CASE mode WHEN 'bus' THEN riders ELSE occupancy END AS occupancy FROM central, f, b
""")
def q181_scaled_and_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters with a measured value in place of a default, and public modes scaled."""
    low, high = F.col("occupancy") / 2, F.col("occupancy") * 2
    riders = 8 + F.count_if(F.col("l_returnflag") == "R") / F.count("*").cast("double")
    measured = table(spark, sf_dir, "lineitem").agg(riders.alias("occupancy")).select(F.lit("bus").alias("mode"), "occupancy")
    factors = table(spark, sf_dir, "nation").groupBy((1 + F.col("n_regionkey") / F.lit(4.0)).alias("factor")).agg(F.count("*").alias("n_cities"))
    p = C.overridden(central(spark).withColumns({"low": low, "high": high}), measured, ["mode"], "occupancy").crossJoin(F.broadcast(factors))  # five regions
    return C.scaled(p, ["bus", "rail"], F.col("factor")).select("factor", "n_cities", "mode", "mass", "lam", "occupancy")


_LOOPS = "e AS (SELECT DISTINCT u, v FROM (SELECT l_suppkey % 97 AS u, l_partkey % 89 AS v FROM lineitem UNION ALL SELECT CAST(n_nationkey AS BIGINT) + 200, (CAST(n_nationkey AS BIGINT) + 1) % 25 + 200 FROM nation UNION ALL SELECT CAST(300 AS BIGINT), CAST(200 AS BIGINT)) WHERE u <> v)"


@query(f"""
WITH RECURSIVE {_LOOPS}, n AS (SELECT u AS k FROM e UNION SELECT v FROM e), r(a, b) AS (SELECT k, k FROM n UNION SELECT r.a, e.v FROM r JOIN e ON r.b = e.u),
c AS (SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1), b AS (SELECT component FROM c GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1)
SELECT u, v FROM e WHERE u IN (SELECT node FROM c WHERE component = (SELECT component FROM b)) AND v IN (SELECT node FROM c WHERE component = (SELECT component FROM b))
""")
def q182_largest_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.graph import largest_component

    k = F.col("n_nationkey").cast("long")
    a = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 97).alias("u"), (F.col("l_partkey") % 89).alias("v"))
    ring = table(spark, sf_dir, "nation").select((k + 200).alias("u"), ((k + 1) % 25 + 200).alias("v"))
    more = spark.createDataFrame([(300, 200)], "u long, v long")
    return largest_component(a.unionByName(ring).unionByName(more).where("u <> v").distinct())


@query(f"""
WITH {PLACES}, l AS (SELECT p.k, p.x AS ux, p.y AS uy, CASE WHEN p.k % 2 = 0 THEN q.x ELSE p.x END AS ax, CASE WHEN p.k % 2 = 0 THEN q.y ELSE p.y END AS ay, p.x + 3 AS mx, p.y + 4 AS my, CASE WHEN p.k % 2 = 0 THEN p.x ELSE q.x END AS bx, CASE WHEN p.k % 2 = 0 THEN p.y ELSE q.y END AS b_y FROM places p JOIN places q ON q.k = p.k + 1)
SELECT k, CASE WHEN (ax - ux) * (ax - ux) + (ay - uy) * (ay - uy) <= (bx - ux) * (bx - ux) + (b_y - uy) * (b_y - uy) THEN ax ELSE bx END AS first_x, sqrt(CAST((mx - ax) * (mx - ax) + (my - ay) * (my - ay) AS DOUBLE)) + sqrt(CAST((bx - mx) * (bx - mx) + (b_y - my) * (b_y - my) AS DOUBLE)) AS length FROM l
""")
def q183_polylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that begin at either end, turned to begin at u, and their lengths."""
    from ..operators import profile as P

    at = lambda n: places(spark, sf_dir).select(F.col("k").alias(n), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"))
    j = at("u").join(at("v"), F.col("v") == F.col("u") + 1)
    c = F.col
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    u, m, v = p(c("xu"), c("yu")), p(c("xu") + 3, c("yu") + 4), p(c("xv"), c("yv"))
    g = F.when(c("u") % 2 == 0, F.array(v, m, u)).otherwise(F.array(u, m, v))
    lines = j.select(c("u").alias("k"), "xu", "yu", g.alias("g"))
    return lines.select("k", F.element_at(P.from_u(c("g"), c("xu"), c("yu")), 1)["x"].alias("first_x"), P.polyline_length(c("g")).alias("length"))


@query("SELECT 'm' || n_nationkey AS mode, 'mass_kg' AS parameter, n_nationkey * 1.0::DOUBLE AS low, n_nationkey * 2.0::DOUBLE AS central, n_nationkey * 4.0::DOUBLE AS high FROM nation")
def q184_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configuration of parameters as one JSON document, written and read."""
    k = F.col("n_nationkey").cast("string")
    n = F.col("n_nationkey")
    one = F.concat(F.lit('"m'), k, F.lit('": {"mass_kg": ['), n.cast("string"), F.lit(", "), (n * 2).cast("string"), F.lit(", "), (n * 4).cast("string"), F.lit('], "note": "x"}'))
    doc = table(spark, sf_dir, "nation").agg(F.concat(F.lit('{"modes": {'), F.array_join(F.sort_array(F.collect_list(one)), ", "), F.lit("}}")).alias("value"))
    path = new_folder(spark, "parameters")
    doc.coalesce(1).write.text(path)
    return X.read_parameters(spark, path)


@query("""
SELECT 'way ' || k AS part, CAST(k % 3 AS BIGINT) AS position, k + 100 + k % 3 AS node, k % 4 = 0 AND k % 5 <> 0 AS grounded FROM (SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation) WHERE k % 3 < 2 AND k % 3 = 0
UNION ALL SELECT 'way ' || k, 1, k + 101, k % 4 = 0 AND k % 5 <> 0 FROM (SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation) WHERE k % 3 = 0
UNION ALL SELECT 'member', 0, k, false FROM (SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation) WHERE k % 3 = 1
UNION ALL SELECT 'node', 0, k, false FROM (SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation) WHERE k % 3 = 2
""")
def q185_map_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes, ways and members of routes from one JSON document; which ways lie on the ground."""
    n = F.col("n_nationkey")
    k = n.cast("string")
    tags = F.concat(F.lit('{"layer": "'), F.when(n % 4 == 0, "0").otherwise("1"), F.lit('", "tunnel": "'), F.when(n % 5 == 0, "yes").otherwise("no"), F.lit('"}'))
    way = F.concat(F.lit('{"type": "way", "id": '), k, F.lit(', "nodes": ['), (n + 100).cast("string"), F.lit(", "), (n + 101).cast("string"), F.lit('], "tags": '), tags, F.lit("}"))
    route = F.concat(F.lit('{"type": "relation", "id": '), k, F.lit(', "tags": {"route": "tram"}, "members": [{"type": "way", "ref": '), k, F.lit(', "role": ""}]}'))
    node = F.concat(F.lit('{"type": "node", "id": '), k, F.lit(', "lon": 2.5, "lat": 41.5}'))
    one = F.when(n % 3 == 0, way).when(n % 3 == 1, route).otherwise(node)
    doc = table(spark, sf_dir, "nation").agg(F.concat(F.lit('{"elements": ['), F.array_join(F.collect_list(one), ", "), F.lit("]}")).alias("value"))
    path = new_folder(spark, "elements")
    doc.coalesce(1).write.text(path)
    nodes, ways, members = X.transit_parts(spark, path)
    out = ways.select(F.concat(F.lit("way "), F.col("id").cast("string")).alias("part"), F.col("position").cast("long").alias("position"), "node", X.on_terrain(F.col("tags")).alias("grounded"))
    flat = lambda df, part, c: df.select(F.lit(part).alias("part"), F.lit(0).cast("long").alias("position"), F.col(c).alias("node"), F.lit(False).alias("grounded"))
    return out.unionByName(flat(members, "member", "member")).unionByName(flat(nodes, "node", "id"))


@query("""
WITH a AS (SELECT p_partkey, [p_partkey % 720 - 360.0::DOUBLE, p_size * 90.0::DOUBLE, 181.0::DOUBLE, -179.0::DOUBLE] AS l FROM part), m AS (SELECT p_partkey, list_transform(l, lambda x: x - 360 * floor(x / 360)) AS l FROM a)
SELECT p_partkey, array_to_string(list_transform(list_sort(list_distinct(list_transform(l, lambda x: CASE WHEN x > 180 THEN x - 360 ELSE x END))), lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',') AS angles FROM m
""")
def q186_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angles in one turn, distinct and ascending."""
    a = F.array((F.col("p_partkey") % 720 - 360).cast("double"), F.col("p_size") * 90.0, F.lit(181.0), F.lit(-179.0))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(N.normalised_angles(a), lambda x: x.cast("long").cast("string")), ",").alias("angles"))


@query(r"SELECT n_nationkey, regexp_replace(n_name || ' & 5% #1 {a_b}', '([&%$#_{}])', '\\\1', 'g') AS tex, '&lt;' || n_name || '&gt; &amp; &quot;x&quot;' AS xml FROM nation")
def q187_escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("n_name")
    return table(spark, sf_dir, "nation").select("n_nationkey", N.escaped_tex(F.concat(name, F.lit(" & 5% #1 {a_b}"))).alias("tex"), N.escaped_xml(F.concat(F.lit("<"), name, F.lit('> & "x"'))).alias("xml"))


@query("SELECT o_orderkey, o_totalprice FROM orders")
def q188_checked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that must keep a rule: it does."""
    return A.require(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), F.col("o_totalprice") >= 0, "negative price")


@query("""
WITH w AS (SELECT CAST(c_nationkey AS VARCHAR) AS o, CAST(o_orderkey % 25 AS VARCHAR) AS d, CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 3 AS VARCHAR) END AS n FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT o AS origin, d AS dest, sum(coalesce(TRY_CAST(n AS DOUBLE), 0)) AS flow FROM w GROUP BY 1, 2 HAVING sum(coalesce(TRY_CAST(n AS DOUBLE), 0)) > 0
""")
def q189_cleaned_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows of text: what is no number is none, and only positive ones stay."""
    n = F.when(F.col("o_orderkey") % 5 == 0, "n/a").when(F.col("o_orderkey") % 7 == 0, F.lit(None).cast("string")).otherwise((F.col("o_orderkey") % 3).cast("string"))
    w = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").cast("string").alias("o"), (F.col("o_orderkey") % 25).cast("string").alias("d"), n.alias("n"))
    return X.summed_flows(w.where("o < '2'"), w.where("o >= '2'"))


@query(f"""
WITH {_NAMED}, t AS (SELECT p_partkey, regexp_extract(name, '^(graph_)?trans_(\\d+)m_a([+-])(\\d+)(\\.pkl)?$', 2) AS m, regexp_extract(name, '^(graph_)?trans_(\\d+)m_a([+-])(\\d+)(\\.pkl)?$', 3) AS s, regexp_extract(name, '^(graph_)?trans_(\\d+)m_a([+-])(\\d+)(\\.pkl)?$', 4) AS a FROM named)
SELECT p_partkey, CAST(nullif(m, '') AS DOUBLE) AS metres, CASE WHEN s = '-' THEN -CAST(a AS DOUBLE) ELSE CAST(nullif(a, '') AS DOUBLE) END AS angle FROM t
""")
def q199_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and direction of translations, null for other variants."""
    name = F.col("name")
    return _named(spark, sf_dir).select("p_partkey", N.translation_m(name).alias("metres"), N.translation_angle(name).alias("angle"))
