"""Counts over a stream of events, and idempotent writes of its batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import new_folder

#: Time that events may be late.
LATE = "10 minutes"


def windowed(events: DataFrame, width: str = "1 hour", late: str = LATE) -> DataFrame:
    """start, event_type, n, total of event windows that the watermark has closed. ts: a timestamp (of local tables without a zone, cast first)."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    counts = timed.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))
    return counts.select(F.col("window.start").alias("start"), "event_type", "n", F.col("total").cast("double").alias("total"))


def run_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Appends to out all that the stream has to say about the input at hand; run again, it goes on from there."""
    query = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def hourly(spark: SparkSession, folder: str) -> DataFrame:
    """windowed() over the Parquet files of a folder, by way of a stream."""
    example = spark.read.option("recursiveFileLookup", True).parquet(folder)
    stream = spark.readStream.schema(example.schema).option("recursiveFileLookup", True).parquet(folder)
    out = new_folder(spark, "hourly")
    run_available(windowed(stream), out, f"{out}-state")
    return spark.read.schema("start timestamp, event_type string, n long, total double").parquet(out)
