"""Mixing sources to target weights by hash-threshold histograms (operator 8).

A source gives every document as many whole times as its target allows, and one time more those whose hash lies below a
threshold that makes up the rest. The threshold comes from nested histograms: words by source and the hash's first BITS
bits show the bucket in which the budget runs out, words by the next BITS bits of that bucket alone refine it, and so on
to the last bit. A histogram has at most 2^BITS rows a source whatever the input; nothing is sorted by document, and the
documents are then filtered by comparing hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import broadcast_if_few, checkpointed, unused, word_count

#: Bits of the hash that a histogram resolves, and the histograms: the hash has BITS * LEVELS bits.
BITS, LEVELS = 12, 5
#: Weights of the sources in code-point order, repeating, and the times of its own size that a source's target stops at.
WEIGHTS, TIMES = (1, 2, 3), 3


def hashed(column: F.Column) -> F.Column:
    """60 bits of the MD5 of a column's text; null counts as empty."""
    return F.conv(F.substring(F.md5(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(totals: DataFrame) -> DataFrame:
    """source, source_size, target from source, source_size: one row a source, so the windows here see as many rows as there are sources.

    The level L at which min(TIMES * size, L * weight) adds up to all sizes is where it first holds that no source still
    below its stop would pass it.
    """
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(w) for w in WEIGHTS)), ((F.row_number().over(rank) - 1) % len(WEIGHTS) + 1).cast("int"))
    t = totals.withColumn("weight", weight.cast("long")).withColumn("stop", F.col("source_size") * TIMES)
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    t = t.select("*", F.sum("source_size").over(everything).alias("all_size"), F.sum("weight").over(everything).alias("all_weight"), F.coalesce(F.sum("stop").over(before), F.lit(0)).alias("stopped"), F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("stopped_weight"))
    t = t.withColumn("level", (F.col("all_size") - F.col("stopped")).cast("double") / (F.col("all_weight") - F.col("stopped_weight")).cast("double"))
    t = t.withColumn("level", F.max(F.when(F.col("level") <= F.col("stop").cast("double") / F.col("weight").cast("double"), F.col("level"))).over(everything))
    return t.select("source", "source_size", F.least(F.col("stop").cast("double"), F.col("level") * F.col("weight").cast("double")).alias("target"))


def thresholds(sized: DataFrame, totals: DataFrame) -> DataFrame:
    """source, source_size, target, times and below: whole times, and the hash below which a document goes once more. sized: source, size, h."""
    with_target = targets(totals).withColumn("times", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    rest = with_target.withColumn("rest", F.col("target") - (F.col("times") * F.col("source_size")).cast("double"))
    state = rest.select("source", F.lit(0).cast("long").alias("prefix"), "rest")
    ordered = Window.partitionBy("s").orderBy("bucket")
    for level in range(LEVELS):
        left = BITS * (LEVELS - level - 1)
        bounds = broadcast_if_few(checkpointed(state.select(F.col("source").alias("s"), "prefix", "rest")))
        inside = sized.join(bounds, sized.source.eqNullSafe(bounds.s) & (F.shiftright("h", left + BITS) == F.col("prefix")))
        histogram = inside.groupBy("s", "rest", F.shiftright("h", left).alias("bucket")).agg(F.sum("size").alias("words"))
        upto = histogram.withColumn("upto", F.sum("words").over(ordered))
        over = upto.where(F.col("upto") > F.col("rest"))
        state = over.groupBy(F.col("s").alias("source")).agg(F.min(F.struct("bucket", "upto", "words", "rest")).alias("x"))
        state = state.select("source", F.col("x.bucket").alias("prefix"), (F.col("x.rest") - (F.col("x.upto") - F.col("x.words"))).alias("rest"), F.col("x.words").alias("words"))
    # documents of one hash go together: they go if that brings the sum nearer
    found = state.select(F.col("source").alias("s"), (F.col("prefix") + (F.col("words") / 2 <= F.col("rest")).cast("long")).alias("found"))
    # a source at its stop gives nothing more, not even documents without words
    below = F.when(F.col("times") >= TIMES, F.lit(0).cast("long")).otherwise(F.coalesce("found", F.lit(1 << (BITS * LEVELS))))
    return with_target.join(found, with_target.source.eqNullSafe(found.s), "left").select("source", "source_size", "target", "times", below.alias("below"))


def _sized(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """documents' doc_id, source, size and hash, and the thresholds of its sources (their source as s): a row a source."""
    sized = checkpointed(documents.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), hashed(F.col("doc_id")).alias("h")))
    totals = checkpointed(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    return sized, broadcast_if_few(checkpointed(thresholds(sized, totals)).withColumnRenamed("source", "s"))


def mix(documents: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of each row of documents (doc_id, text, source).

    Null text has size 0, a null source is a source, the last one. Rows with the same doc_id share a hash and are taken
    together. taken is a multiple of size, at most TIMES of it. No documents: no rows.
    """
    sized, limits = _sized(documents)
    taken = F.col("size") * (F.col("times") + (F.col("h") < F.col("below")).cast("long"))
    return sized.join(limits, sized.source.eqNullSafe(limits.s)).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mixed(documents: DataFrame) -> DataFrame:
    """The rows of documents, all columns, each as many times as mix() takes it, TIMES at most; rows without words are taken with their source's."""
    _, limits = _sized(documents)
    source, times, below, copy = (unused(documents, x) for x in ("_source", "_times", "_below", "_copy"))
    limits = broadcast_if_few(limits.select(F.col("s").alias(source), F.col("times").alias(times), F.col("below").alias(below)))
    copies = (F.col(times) + (hashed(documents.doc_id) < F.col(below)).cast("long")).cast("int")
    joined = documents.join(limits, documents.source.cast("string").eqNullSafe(limits[source])).where(copies > 0)
    return joined.withColumn(copy, F.explode(F.array_repeat(F.lit(0), copies))).select(*(documents[c] for c in documents.columns))


SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
t AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(size) * 3 AS BIGINT) AS stop,
         CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight
  FROM d GROUP BY source),
u AS (
  SELECT *, sum(source_size) OVER () AS all_size, sum(weight) OVER () AS all_weight, coalesce(sum(stop) OVER b, 0) AS stopped, coalesce(sum(weight) OVER b, 0) AS stopped_weight
  FROM t WINDOW b AS (ORDER BY stop / CAST(weight AS DOUBLE), source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, CAST(all_size - stopped AS DOUBLE) / CAST(all_weight - stopped_weight AS DOUBLE) AS level FROM u),
w AS (SELECT *, max(CASE WHEN level <= CAST(stop AS DOUBLE) / CAST(weight AS DOUBLE) THEN level END) OVER () AS fixed FROM v),
x AS (SELECT source, source_size, least(CAST(stop AS DOUBLE), fixed * CAST(weight AS DOUBLE)) AS target FROM w),
y AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS times FROM x),
z AS (
  SELECT d.doc_id, d.size, y.source_size, y.target, y.times, target - CAST(times * y.source_size AS DOUBLE) AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY h) AS upto, sum(d.size) OVER (PARTITION BY d.source, h) AS words
  FROM d JOIN y ON d.source IS NOT DISTINCT FROM y.source)
SELECT doc_id, size, source_size, target, CAST(size * (times + CASE WHEN upto - words + words / 2.0 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM z
"""
