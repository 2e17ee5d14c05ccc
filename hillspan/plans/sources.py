"""Queries that write a table in one of the exchange formats and read it back, and the one over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import ring_to_wkt
from ..sources import tables as S
from ..sources.folders import new_folder
from ..streaming.events import windowed
from .registry import query, table


@query("SELECT p_partkey AS key, p_name AS name, p_size AS size FROM part WHERE p_size > 10")
def q74_results_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "results")
    S.write_results(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_size").alias("size"), "p_type"), path)
    kinds = {f.name: f.dataType for f in table(spark, sf_dir, "part").schema}
    return S.read_results(spark, path, S.schema(key=kinds["p_partkey"], name=kinds["p_name"], size=kinds["p_size"], p_type=kinds["p_type"])).select("key", "name", "size").where("size > 10")


@query("SELECT 'z' || c_nationkey AS origen, 'z' || (o_orderkey % 25) AS destino, CAST(count(*) AS DOUBLE) AS viajes FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey < 20 AND o_orderkey % 25 < 20 AND o_orderpriority <> '5-LOW' GROUP BY 1, 2")
def q75_daily_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    trips = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.concat(F.lit("z"), "c_nationkey").alias("origen"), F.concat(F.lit("z"), (F.col("o_orderkey") % 25).cast("string")).alias("destino"), F.col("o_orderpriority").alias("distancia"), F.lit(1.0).alias("viajes"), (F.col("o_orderkey") % 3).alias("day"))
    folder = new_folder(spark, "trips")
    for day in range(3):
        trips.where(f"day = {day}").drop("day").write.options(header=True, sep="|", compression="gzip").csv(f"{folder}/{day}")
    return S.read_trips(spark, [f"{folder}/{day}" for day in range(3)], [f"z{i}" for i in range(20)], ["5-LOW"])


@query("SELECT CAST(n_nationkey AS VARCHAR) AS cell, n_nationkey * 0.5::DOUBLE AS lon_min, n_nationkey * 0.25::DOUBLE AS lat_min, n_nationkey * 0.5::DOUBLE + 0.5 AS lon_max, n_nationkey * 0.25::DOUBLE + 0.25 AS lat_max, n_nationkey * 0.5::DOUBLE + 0.25 AS cent_lon, n_nationkey * 0.25::DOUBLE + 0.125 AS cent_lat FROM nation")
def q76_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return S.normalised_cells(table(spark, sf_dir, "nation").select(k.alias(" cell_id"), (k * 0.5).alias("min_lon"), (k * 0.25).alias("min_lat"), (k * 0.5 + 0.5).alias("max_lon"), (k * 0.25 + 0.25).alias("max_lat")))


@query("SELECT n_nationkey AS key, 4 AS n_points, n_nationkey * 1.0::DOUBLE AS first_x, 2.5::DOUBLE AS last_y FROM nation WHERE n_nationkey % 4 <> 0")
def q77_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey").cast("double")
    ring = F.array(*(F.struct(x.alias("x"), F.lit(y).alias("y")) for x, y in ((k, 0.0), (k + 1, 0.0), (k + 1, 1.5), (k, 2.5))))
    path = new_folder(spark, "polygons")
    S.write_results(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.when(F.col("n_nationkey") % 4 != 0, ring_to_wkt(ring)).alias("geometry")), path, ";")
    kinds = table(spark, sf_dir, "nation").schema
    df = S.read_polygons(spark, path, S.schema(key=kinds["n_nationkey"].dataType, geometry=S._S))
    return df.select("key", F.size("ring").alias("n_points"), F.element_at("ring", 1)["x"].alias("first_x"), F.element_at("ring", -1)["y"].alias("last_y"))


@query("SELECT p_brand AS filename, leg, measure, CAST(sum(v) AS DOUBLE) AS value FROM (SELECT p_brand, 'road' AS leg, 'L' AS measure, p_size AS v FROM part UNION ALL SELECT p_brand, 'a1000_rail', 'L', p_size * 2 FROM part UNION ALL SELECT p_brand, 'a1000_rail', 'Hu', p_size % 3 FROM part) GROUP BY 1, 2, 3")
def q78_variant_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "sums")
    wide = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("filename")).agg(F.sum("p_size").alias("road_L"), F.sum(F.col("p_size") * 2).alias("a1000_rail_L"), F.sum(F.col("p_size") % 3).alias("a1000_rail_Hu"))
    wide.write.json(path)
    return S.long_sums(S.read_sums(spark, path))


@query("SELECT p_partkey, p_type, CASE WHEN p_type = 'SMALL' THEN p_size + 1000 ELSE p_size END AS size FROM part")
def q79_resumed_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part of a run is repeated with other values: its rows are replaced, once."""
    path, part = new_folder(spark, "resumed"), table(spark, sf_dir, "part").select("p_partkey", "p_type", F.col("p_size").alias("size"))
    S.overwrite_partitions(part, path, ["p_type"])
    for _ in range(2):
        S.overwrite_partitions(part.where("p_type = 'SMALL'").withColumn("size", F.col("size") + 1000), path, ["p_type"])
    return spark.read.schema("p_partkey long, size int, p_type string").parquet(path)


@query("""
SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events
WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY 1, 2
""")
def q80_streamed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of one folder: windows that the watermark has closed at its end."""
    from ..streaming.events import run_available

    folder = new_folder(spark, "events")
    events = table(spark, sf_dir, "events")
    events.write.parquet(f"{folder}/in")
    out = f"{folder}/out"
    run_available(windowed(spark.readStream.schema(events.schema).parquet(f"{folder}/in")), out, f"{folder}/state")
    return spark.read.schema("start timestamp, event_type string, n long, total double").parquet(out).withColumn("start", F.col("start").cast("timestamp_ntz"))
