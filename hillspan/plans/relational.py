"""Queries of filters, order-aware deduplication, joins, aggregates and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions.physics import TIE, number
from ..operators import relational as X
from ..operators import stats as S
from .registry import cents, query, table

_NAMED = """
named AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'graph_trans_' || (p_size * 50) || 'm_a+' || lpad(CAST(p_partkey % 4 * 30 + 90 AS VARCHAR), 3, '0') || '.pkl'
  WHEN 1 THEN 'scale_ns_' || CAST(p_size // 40 AS VARCHAR) || 'p' || printf('%02d', p_size * 2 % 100)
  WHEN 2 THEN 'rot_' || CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END || printf('%02d', p_size * 7) || 'p50deg' ELSE CASE WHEN p_size = 7 THEN 'original' ELSE 'other_' || p_size END END AS name FROM part)"""


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    name = (
        F.when(k % 4 == 0, F.concat(F.lit("graph_"), N.translation_name(size * 50, k % 4 * 30 + 90), F.lit(".pkl")))
        .when(k % 4 == 1, F.format_string("scale_ns_%dp%02d", F.floor(size / 40), size * 2 % 100))
        .when(k % 4 == 2, F.concat(F.lit("rot_"), F.when(size % 2 == 0, "+").otherwise("-"), F.format_string("%02dp50deg", size * 7)))
        .otherwise(F.when(size == 7, "original").otherwise(F.concat(F.lit("other_"), size.cast("string"))))
    )
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name"))


@query(f"""
WITH {_NAMED},
parsed AS (SELECT *, regexp_replace(regexp_replace(name, '^graph_', ''), '\\.pkl$', '') AS bare FROM named),
x AS (SELECT p_partkey, name, bare,
  TRY_CAST(nullif(regexp_extract(bare, '^trans_(\\d+)m_a[+-]\\d+$', 1), '') AS DOUBLE) AS metres, nullif(regexp_extract(bare, '^trans_\\d+m_a[+-](\\d+)$', 1), '') AS angle,
  TRY_CAST(nullif(regexp_extract(bare, '^scale_(ns|ew)_(\\d+)p(\\d+)$', 2), '') || '.' || nullif(regexp_extract(bare, '^scale_(ns|ew)_(\\d+)p(\\d+)$', 3), '') AS DOUBLE) AS factor, nullif(regexp_extract(bare, '^scale_(ns|ew)_(\\d+)p(\\d+)$', 1), '') AS axis,
  CASE WHEN bare LIKE 'rot\\_-%' ESCAPE '\\' THEN -1 ELSE 1 END * TRY_CAST(nullif(regexp_extract(bare, '^rot_[+-](\\d+)p(\\d+)deg$', 1), '') || '.' || nullif(regexp_extract(bare, '^rot_[+-](\\d+)p(\\d+)deg$', 2), '') AS DOUBLE) AS turned FROM parsed),
y AS (SELECT *, CASE WHEN turned > 180 THEN turned - 360 ELSE turned END AS deg FROM x)
SELECT p_partkey, name, CASE WHEN bare = 'original' THEN 'original' WHEN deg IS NOT NULL THEN 'rotation' WHEN metres IS NOT NULL THEN 'translation_' || angle WHEN factor IS NOT NULL THEN 'scale_' || axis ELSE 'unknown' END AS family,
       CASE WHEN bare = 'original' THEN 0.0 ELSE coalesce(deg, metres, factor) END AS parameter
FROM y WHERE NOT coalesce(factor < 1, false) AND NOT coalesce(metres < 200, false)
""")
def q02_main_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("name")
    return _named(spark, sf_dir).where(N.in_main_ensemble(name)).select("p_partkey", "name", N.family(name).alias("family"), N.parameter(name).alias("parameter"))


_ORDER = ("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")


def _by_order(df: DataFrame, keep) -> DataFrame:
    return keep(df, ["l_orderkey"], [F.col(c) for c in _ORDER]).select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")


_KEPT = "SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {}) AS n FROM lineitem) WHERE n = 1"


@query(_KEPT.format(", ".join(f"{c} DESC" for c in _ORDER)))
def q03_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_order(table(spark, sf_dir, "lineitem"), X.keep_last)


@query(_KEPT.format(", ".join(_ORDER)))
def q04_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_order(table(spark, sf_dir, "lineitem"), X.keep_first)


@query(f"""
WITH e AS (SELECT p_type AS city, p_brand AS variant, CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) AS e FROM part GROUP BY 1, 2),
o AS (SELECT *, first_value(e) OVER (PARTITION BY city ORDER BY variant) AS e_0, variant = min(variant) OVER (PARTITION BY city) AS observed FROM e)
SELECT city, variant, e - e_0 AS delta, (e - e_0) / e_0 * 100 AS delta_pct, (e_0 - e) / e_0 * 100 AS improvement_pct, NOT observed AND e < {1 - TIE!r}::DOUBLE * e_0 AS lower FROM o
""")
def q05_delta_vs_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("city"), F.col("p_brand").alias("variant")).agg(cents("p_retailprice").alias("e"))
    seen = e.withColumn("observed", F.col("variant") == F.min("variant").over(Window.partitionBy("city")))
    df = X.with_observed(seen, ["city"], F.col("observed"), ["e"])
    change = F.col("e") - F.col("e_0")
    return df.select("city", "variant", change.alias("delta"), (change / F.col("e_0") * 100).alias("delta_pct"), ((F.col("e_0") - F.col("e")) / F.col("e_0") * 100).alias("improvement_pct"), (~F.col("observed") & (F.col("e") < (1 - TIE) * F.col("e_0"))).alias("lower"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) > 50")
def q06_coerce_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", number(F.get_json_object("props", "$.k")).alias("k")).where("k > 50")


FLOWS = """
flows AS (SELECT c_nationkey AS origin, s_nationkey AS dest, o_orderdate AS day, l_linenumber AS draw FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)
"""


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An item as a trip from its customer's nation to its supplier's."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderdate", F.col("c_nationkey").alias("origin"))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber").join(table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dest")), F.col("l_suppkey") == F.col("s_suppkey"))
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("origin", "dest", F.col("o_orderdate").alias("day"), F.col("l_linenumber").alias("draw"))


@query(f"""
WITH {FLOWS}, a AS (SELECT origin, dest, count(*) AS flow FROM flows WHERE day < TIMESTAMP '1998-01-01' GROUP BY 1, 2), b AS (SELECT origin, dest, count(*) AS flow FROM flows WHERE day >= TIMESTAMP '1998-01-01' GROUP BY 1, 2)
SELECT origin, dest, CAST(sum(flow) AS BIGINT) AS flow FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2
""")
def q07_od_two_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, cut = flows(spark, sf_dir), F.lit("1998-01-01").cast("timestamp_ntz")
    count = lambda df: df.groupBy("origin", "dest").agg(F.count("*").alias("flow"))
    return count(f.where(F.col("day") < cut)).unionByName(count(f.where(F.col("day") >= cut))).groupBy("origin", "dest").agg(F.sum("flow").alias("flow"))


@query(f"""
WITH {FLOWS}, k AS (SELECT origin, draw, count(*) AS n FROM flows GROUP BY 1, 2), s AS (SELECT origin, count(*) AS m, CAST(sum(n) AS DOUBLE) AS a, CAST(sum(n) AS HUGEINT) AS a2, CAST(sum(n * n) AS HUGEINT) AS b2 FROM k GROUP BY 1)
SELECT origin, a / m AS mean, CASE WHEN m > 1 THEN sqrt(CAST(m * b2 - a2 * a2 AS DOUBLE) / CAST(m * (m - 1) AS DOUBLE)) ELSE 0.0 END AS sd_sample, sqrt(CAST(m * b2 - a2 * a2 AS DOUBLE) / CAST(m * m AS DOUBLE)) AS sd_population FROM s
""")
def q08_sd_over_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The draws' counts are integers: sums of squares are exact, and the deviations follow from them."""
    s = flows(spark, sf_dir).groupBy("origin", "draw").agg(F.count("*").alias("n")).groupBy("origin").agg(F.count("*").alias("m"), F.sum("n").alias("a"), F.sum(F.col("n") * F.col("n")).alias("b"))
    sample, population = S.exact_deviations(F.col("m"), F.col("a"), F.col("b"))
    return s.select("origin", (F.col("a").cast("double") / F.col("m")).alias("mean"), sample.alias("sd_sample"), population.alias("sd_population"))


@query("""
SELECT o_orderpriority AS priority, count(*) AS n, count(DISTINCT o_custkey) AS n_customers, CAST(CAST(quantile_cont(o_totalprice, 0.05) AS DECIMAL(18,4)) AS DOUBLE) AS p05, CAST(CAST(quantile_cont(o_totalprice, 0.5) AS DECIMAL(18,4)) AS DOUBLE) AS median, CAST(CAST(quantile_cont(o_totalprice, 0.95) AS DECIMAL(18,4)) AS DOUBLE) AS p95, max(abs(o_totalprice - 200000)) AS furthest
FROM orders GROUP BY 1
""")
def q09_quantile_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.percentile("o_totalprice", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    out = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("n_customers"), p.alias("p"), F.max(F.abs(F.col("o_totalprice") - 200000)).alias("furthest"))
    return out.select("priority", "n", "n_customers", *(F.col("p")[i].cast("decimal(18,4)").cast("double").alias(k) for i, k in enumerate(("p05", "median", "p95"))), "furthest")


@query("""
SELECT c_nationkey AS city, count(*) AS n, count(*) FILTER (WHERE c_mktsegment = 'AUTOMOBILE') AS "n_AUTOMOBILE", count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS "n_BUILDING", count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS "n_MACHINERY",
       count(*) FILTER (WHERE c_acctbal < 0) / greatest(count(*), 1) AS share_negative FROM customer GROUP BY 1
""")
def q10_family_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "city")
    return S.counts_by(df, ["city"], "c_mktsegment", ["AUTOMOBILE", "BUILDING", "MACHINERY"]).join(df.groupBy("city").agg(S.share_where(F.col("c_acctbal") < 0).alias("share_negative")), "city")


SUPPLIERS = "sup AS (SELECT s_suppkey, s_nationkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(cents("l_extendedprice").alias("price"), cents("l_quantity").alias("quantity"))
    return sums.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).drop("l_suppkey").withColumn("g", F.lit(0))


@query(f"WITH {SUPPLIERS}, r AS (SELECT s_nationkey % 5 AS g, row_number() OVER (PARTITION BY s_nationkey % 5 ORDER BY price, s_suppkey) AS i, row_number() OVER (PARTITION BY s_nationkey % 5 ORDER BY quantity, s_suppkey) AS j FROM sup) SELECT g, count(*) FILTER (WHERE i <= 10 AND j <= 10) AS n_common FROM r GROUP BY g")
def q11_topk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.top_overlap(suppliers(spark, sf_dir).withColumn("g", F.col("s_nationkey") % 5), ["g"], "s_suppkey", "price", "quantity", 10)


_RANKS = "r AS (SELECT s_nationkey % 5 AS g, 2 * rank() OVER (PARTITION BY s_nationkey % 5 ORDER BY price) + count(*) OVER (PARTITION BY s_nationkey % 5, price) - 1 AS a, 2 * rank() OVER (PARTITION BY s_nationkey % 5 ORDER BY quantity) + count(*) OVER (PARTITION BY s_nationkey % 5, quantity) - 1 AS b FROM sup)"


@query(f"""
WITH {SUPPLIERS}, {_RANKS}, s AS (SELECT g, CAST(count(*) AS DOUBLE) AS n, CAST(sum(a) AS DOUBLE) AS sa, CAST(sum(b) AS DOUBLE) AS sb, CAST(sum(a * a) AS DOUBLE) AS aa, CAST(sum(b * b) AS DOUBLE) AS bb, CAST(sum(a * b) AS DOUBLE) AS ab FROM r GROUP BY g)
SELECT g, (n * ab - sa * sb) / nullif(sqrt((n * aa - sa * sa) * (n * bb - sb * sb)), 0) AS rho FROM s
""")
def q12_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.rank_correlation(suppliers(spark, sf_dir).withColumn("g", F.col("s_nationkey") % 5), ["g"], "price", "quantity")


@query(f"""
WITH {SUPPLIERS}, p AS (SELECT x.s_nationkey AS g, CAST(sign(x.price - y.price) AS BIGINT) AS sa, CAST(sign(x.quantity - y.quantity) AS BIGINT) AS sb FROM sup x JOIN sup y ON x.s_nationkey = y.s_nationkey AND x.s_suppkey < y.s_suppkey)
SELECT g AS s_nationkey, CAST(sum(sa * sb) AS DOUBLE) / nullif(sqrt(CAST(sum(abs(sa)) AS DOUBLE) * CAST(sum(abs(sb)) AS DOUBLE)), 0) AS tau FROM p GROUP BY g
""")
def q13_kendall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.kendall(suppliers(spark, sf_dir), ["s_nationkey"], "s_suppkey", "price", "quantity")


_SHIFTED = "b AS (SELECT c_mktsegment AS segment, c_custkey, CAST(c_acctbal + 1000 AS DECIMAL(18,2)) AS v FROM customer)"


def _shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"), "c_custkey", (F.col("c_acctbal") + 1000).cast("decimal(18,2)").alias("v"))


@query(f"""
WITH {_SHIFTED}, i AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY v) AS i FROM b)
SELECT segment, 2.0::DOUBLE * CAST(sum(i * v) AS DOUBLE) / (count(*) * CAST(sum(v) AS DOUBLE)) - (count(*) + 1) / count(*) AS gini FROM i GROUP BY segment
""")
def q14_lorenz_gini(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.gini(_shifted(spark, sf_dir), ["segment"], "v")


@query(f"WITH {_SHIFTED} SELECT segment, c_custkey, row_number() OVER w / count(*) OVER (PARTITION BY segment) AS share_of_rows, CAST(sum(v) OVER w AS DOUBLE) / CAST(sum(v) OVER (PARTITION BY segment) AS DOUBLE) AS share_of_value FROM b WINDOW w AS (PARTITION BY segment ORDER BY v, c_custkey ROWS UNBOUNDED PRECEDING)")
def q14b_lorenz_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.lorenz(_shifted(spark, sf_dir), ["segment"], "v", "c_custkey")


@query(f"""
WITH {_SHIFTED}, i AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY v DESC) AS i, round_even(count(*) OVER (PARTITION BY segment) * 0.1::DOUBLE, 0) AS n FROM b)
SELECT segment, CAST(sum(v) FILTER (WHERE i <= n) AS DOUBLE) / CAST(sum(v) AS DOUBLE) AS top_share FROM i GROUP BY segment
""")
def q15_top_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.top_share(_shifted(spark, sf_dir), ["segment"], "v", 0.1)


_YEARS = "y AS (SELECT c_nationkey AS city, year(o_orderdate) % 2 AS source, max(o_totalprice) AS e FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"


@query(f"WITH {_YEARS} SELECT coalesce(a.city, b.city) AS city, a.e AS even, b.e AS odd, (b.e - a.e) / a.e * 100 AS change_pct FROM (SELECT * FROM y WHERE source = 0) a FULL JOIN (SELECT * FROM y WHERE source = 1) b ON a.city = b.city")
def q55_pivot_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    best = orders.groupBy(F.col("c_nationkey").alias("city"), (F.year("o_orderdate") % 2).alias("source")).agg(F.max("o_totalprice").alias("e"))
    out = X.compared(best.where("source = 0"), best.where("source = 1"), ["city"], "e", ("even", "odd"))
    return out.select("city", "even", "odd", ((F.col("odd") - F.col("even")) / F.col("even") * 100).alias("change_pct"))


@query(f"WITH {SUPPLIERS} SELECT s_suppkey, component, e FROM (SELECT s_suppkey, 'price' AS component, price AS e FROM sup UNION ALL SELECT s_suppkey, 'quantity', quantity FROM sup)")
def q56_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppliers(spark, sf_dir).unpivot("s_suppkey", ["price", "quantity"], "component", "e")


@query("""
WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)
SELECT isodow(day) - 1 AS weekday, CAST(sum(n) AS DOUBLE) / count(*) AS mean, count(*) AS n_days FROM d WHERE isodow(day) <= 5 AND day <> DATE '2024-01-15' GROUP BY 1
""")
def q57_weekday_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return days.where(X.working_day(F.col("day"), ["2024-01-15"])).groupBy(F.weekday("day").cast("long").alias("weekday")).agg((F.sum("n") / F.count("*")).alias("mean"), F.count("*").alias("n_days"))


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')")
def q58_anti_join_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").where("o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_partkey").alias("p_partkey"))
    return X.not_done(table(spark, sf_dir, "part").select("p_partkey"), done, "p_partkey")


@query("""
WITH p AS (SELECT DISTINCT c_nationkey AS city, c_custkey FROM customer), w AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority <> '5-LOW')
SELECT city, count(*) AS n, count(*) FILTER (WHERE o_custkey IS NULL) AS n_missing, count(*) FILTER (WHERE o_custkey IS NULL) = 0 AS complete FROM p LEFT JOIN w ON c_custkey = o_custkey GROUP BY city
""")
def q59_subset_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("city"), "c_custkey")
    whole = table(spark, sf_dir, "orders").where("o_orderpriority <> '5-LOW'").select(F.col("o_custkey").alias("c_custkey"))
    return X.is_subset(part, whole, ["c_custkey"], ["city"])


@query("""
WITH a AS (SELECT p_brand AS city, p_type AS panel, p_size % 2 = 0 AS valid, p_size >= 25 AS positive FROM part)
SELECT city, panel, count(*) AS attempted, count(*) FILTER (WHERE valid) AS n_valid, count(*) FILTER (WHERE NOT valid) AS rejected, count(*) FILTER (WHERE valid) > 0 AND count(*) FILTER (WHERE NOT valid) > 0 AS limited,
       (count(*) FILTER (WHERE valid AND positive) = 0) <> (count(*) FILTER (WHERE valid AND NOT positive) = 0) AS one_sided
FROM a GROUP BY 1, 2
""")
def q60_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid, positive = F.col("p_size") % 2 == 0, F.col("p_size") >= 25
    n = F.count_if
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("city"), F.col("p_type").alias("panel")).agg(
        F.count("*").alias("attempted"), n(valid).alias("n_valid"), n(~valid).alias("rejected"), ((n(valid) > 0) & (n(~valid) > 0)).alias("limited"), ((n(valid & positive) == 0) != (n(valid & ~positive) == 0)).alias("one_sided"))


@query("""
SELECT p_partkey, CASE WHEN list_has_any(string_split(p_name, ' '), ['red', 'blue', 'green']) THEN 'coloured' WHEN p_name LIKE '%ring%' THEN 'ring' ELSE 'plain' END AS context, len(list_intersect(string_split(p_name, ' '), ['small', 'ring', 'red'])) AS n_tags,
       p_size BETWEEN 10 AND 20 OR p_type = 'PROMO' AS urban FROM part
""")
def q62_tag_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.split("p_name", " ")
    context = F.when(F.arrays_overlap(tags, F.array(*map(F.lit, ("red", "blue", "green")))), "coloured").when(F.col("p_name").contains("ring"), "ring").otherwise("plain")
    n = F.size(F.array_intersect(tags, F.array(*map(F.lit, ("small", "ring", "red"))))).cast("long")
    return table(spark, sf_dir, "part").select("p_partkey", context.alias("context"), n.alias("n_tags"), (F.col("p_size").between(10, 20) | (F.col("p_type") == "PROMO")).alias("urban"))


@query(f"""
SELECT doc_id, regexp_replace(regexp_replace(translate(lower(trim(source || ' É-' || lang || ' !')), '{N.MARKED}', '{N.UNMARKED}'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS name FROM documents
""")
def q63_name_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", N.normalised(F.concat("source", F.lit(" É-"), "lang", F.lit(" !"))).alias("name"))


@query("SELECT p_brand AS brand, string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS types, count(DISTINCT p_type) AS n_types, bool_and(p_size > 0) AS all_sized, bool_or(p_size = 50) AS any_largest FROM part GROUP BY 1")
def q66_text_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(S.text_list(F.col("p_type")).alias("types"), F.countDistinct("p_type").alias("n_types"), F.bool_and(F.col("p_size") > 0).alias("all_sized"), F.bool_or(F.col("p_size") == 50).alias("any_largest"))


@query("""
WITH p AS (SELECT *, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT p_brand, p_partkey FROM p WHERE n <= 5 OR i = 0 OR i * 4 // greatest(n - 1, 1) > (i - 1) * 4 // greatest(n - 1, 1)
""")
def q67_even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.evenly_spaced(table(spark, sf_dir, "part"), ["p_brand"], [F.col("p_partkey")], 5).select("p_brand", "p_partkey")


@query("SELECT p_brand, p_partkey, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 7 AS part FROM part")
def q68_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.chunked(table(spark, sf_dir, "part").select("p_brand", "p_partkey"), [F.col("p_partkey")], 7, ["p_brand"])


@query("""
WITH x AS (SELECT p_size * 3.0::DOUBLE / 10.0 AS u, (p_partkey % 37) * 2.0::DOUBLE / (10.0 * sqrt(3.0::DOUBLE)) AS v, CAST(p_retailprice AS DECIMAL(18,2)) AS z FROM part),
c AS (SELECT *, floor(u + 0.5) AS a1, floor(v + 0.5) AS b1, floor(u) + 0.5 AS a2, floor(v) + 0.5 AS b2 FROM x),
h AS (SELECT z, (u - a1) * (u - a1) + 3 * (v - b1) * (v - b1) <= (u - a2) * (u - a2) + 3 * (v - b2) * (v - b2) AS one, a1, b1, a2, b2 FROM c)
SELECT CASE WHEN one THEN a1 ELSE a2 END AS col, CASE WHEN one THEN b1 ELSE b2 END AS row, CAST(sum(z) AS DOUBLE) / count(*) AS mean, count(*) AS n FROM h GROUP BY 1, 2
""")
def q69_hexbin(spark: SparkSession, sf_dir: str) -> DataFrame:
    col, row = S.hexagon(F.col("p_size") * F.lit(3.0), (F.col("p_partkey") % 37) * F.lit(2.0), 10.0)
    return table(spark, sf_dir, "part").groupBy(col.alias("col"), row.alias("row")).agg((cents("p_retailprice") / F.count("*")).alias("mean"), F.count("*").alias("n"))
