"""Profiles: ordered points of a line with a position s and a height z, one row a point."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: heights below it (m) are void.
LOWEST_VALID_M = -30.0


def valid(z: Column) -> Column:
    return z.isNotNull() & ~F.isnan(z) & (z >= LOWEST_VALID_M)


def filled(df: DataFrame, line: Sequence[str], s: str, z: str, known: Column | None = None, out: str | None = None) -> DataFrame:
    """z with its unknown values on the straight line, along s, between the nearest known ones; flat beyond the first and last; 0 where a line has none.

    known: by default whether z is not null. One sort of each line's points serves both directions.
    """
    known = F.col(z).isNotNull() if known is None else known
    point = F.when(known, F.struct(F.col(s).alias("s"), F.col(z).alias("z")))
    w = Window.partitionBy(*line).orderBy(s)
    df = df.withColumn("_a", F.last(point, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_b", F.first(point, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    a, b = F.col("_a"), F.col("_b")
    between = a["z"] + (b["z"] - a["z"]) * (F.col(s) - a["s"]) / F.nullif(b["s"] - a["s"], F.lit(0))
    return df.withColumn(out or z, F.when(known, F.col(z)).otherwise(F.coalesce(between, a["z"], b["z"], F.lit(0.0)))).drop("_a", "_b")


def cumulative(df: DataFrame, line: Sequence[str], order: Sequence[str], step: Column, out: str = "s") -> DataFrame:
    """Position along the line: the sum of steps up to each point."""
    return df.withColumn(out, F.sum(step).over(Window.partitionBy(*line).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def steps(df: DataFrame, line: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Differences to the point before, as d_<column>; null at a line's first point."""
    w = Window.partitionBy(*line).orderBy(*order)
    return df.select("*", *((F.col(c) - F.lag(c).over(w)).alias(f"d_{c}") for c in columns))


def gains(df: DataFrame, line: Sequence[str], dz: str, dxy: str | None = None) -> DataFrame:
    """line, up, down and (with dxy) length along the slope, from steps. Sums of the type of dz: exact for decimals."""
    up, down = F.sum(F.greatest(F.col(dz), F.lit(0))), F.sum(F.greatest(-F.col(dz), F.lit(0)))
    more = [F.sum(F.sqrt(F.col(dxy) * F.col(dxy) + F.col(dz) * F.col(dz))).alias("length")] if dxy else []
    return df.groupBy(*line).agg(F.coalesce(up, F.lit(0)).alias("up"), F.coalesce(down, F.lit(0)).alias("down"), *more)


def resampled(df: DataFrame, line: Sequence[str], s: str, z: str, every: float) -> DataFrame:
    """line, k, s, z: points at even positions no farther apart than every, both ends among them, z on straight lines between the given points.

    Points and samples are merged in one order along each line: an as-of join by window, without a range join. Of points
    at one position the last one in order of z counts.
    """
    size = df.groupBy(*line).agg(F.max(s).alias("_l"))
    n = F.greatest(F.ceil(F.col("_l") / every) + 1, F.lit(2))
    samples = size.withColumn("_n", n).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n").cast("long") - 1))).select(*line, "k", (F.col("_l") * F.col("k") / (F.col("_n") - 1)).alias(s))
    knots = df.groupBy(*line, s).agg(F.max(z).alias(z)).withColumn("k", F.lit(None).cast("long"))
    both = knots.unionByName(samples.withColumn(z, F.lit(None).cast("double")))
    point = F.when(F.col("k").isNull(), F.struct(F.col(s).alias("s"), F.col(z).alias("z")))
    w = Window.partitionBy(*line).orderBy(F.col(s), F.col("k").asc_nulls_first())
    v = Window.partitionBy(*line).orderBy(F.col(s), F.col("k").asc_nulls_last())
    a = F.last(point, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    b = F.first(point, ignorenulls=True).over(v.rowsBetween(0, Window.unboundedFollowing))
    found = both.withColumn("_a", a).withColumn("_b", b).where(F.col("k").isNotNull())
    a, b = F.col("_a"), F.col("_b")
    height = F.when(b["s"] > a["s"], a["z"] + (b["z"] - a["z"]) * (F.col(s) - a["s"]) / F.nullif(b["s"] - a["s"], F.lit(0.0))).otherwise(F.coalesce(a["z"], b["z"]))
    return found.select(*line, "k", s, height.alias(z))


def over_anchors(df: DataFrame, line: Sequence[str], s: str, z: str, on_terrain: Column) -> DataFrame:
    """Heights of a track that leaves the terrain: kept on it and at both ends, at an even grade between. z: as before; anchored: the new heights."""
    w = Window.partitionBy(*line).orderBy(s)
    df = df.withColumn("_anchor", on_terrain | F.lag(s).over(w).isNull() | F.lead(s).over(w).isNull())
    return filled(df, line, s, z, F.col("_anchor"), "anchored").drop("_anchor")


def gains_off_terrain(df: DataFrame, line: Sequence[str], s: str, z: str, on_terrain: str) -> DataFrame:
    """line, up, down, up_off, down_off: gains in all, and on the steps that end off the terrain."""
    d = steps(df, line, [s], [z])
    up, down = F.greatest(F.col(f"d_{z}"), F.lit(0.0)), F.greatest(-F.col(f"d_{z}"), F.lit(0.0))
    return d.groupBy(*line).agg(*(F.sum(x).alias(n) for n, x in (("up", up), ("down", down), ("up_off", F.when(~F.col(on_terrain), up).otherwise(0.0)), ("down_off", F.when(~F.col(on_terrain), down).otherwise(0.0)))))


def from_u(geometry: Column, ux: Column, uy: Column) -> Column:
    """A polyline (array of structs x, y) in the direction that begins nearer to u."""
    away = lambda p: (p["x"] - ux) * (p["x"] - ux) + (p["y"] - uy) * (p["y"] - uy)
    return F.when(away(F.element_at(geometry, 1)) <= away(F.element_at(geometry, -1)), geometry).otherwise(F.reverse(geometry))


def polyline_length(geometry: Column) -> Column:
    """Sum of the segments of an array of structs x, y; 0 of fewer than two points."""
    pairs = F.arrays_zip(F.slice(geometry, F.lit(1), F.greatest(F.size(geometry) - 1, F.lit(0))).alias("a"), F.slice(geometry, F.lit(2), F.greatest(F.size(geometry) - 1, F.lit(0))).alias("b"))
    hypot = lambda p: F.sqrt((p["b"]["x"] - p["a"]["x"]) * (p["b"]["x"] - p["a"]["x"]) + (p["b"]["y"] - p["a"]["y"]) * (p["b"]["y"] - p["a"]["y"]))
    return F.aggregate(F.transform(pairs, hypot), F.lit(0.0), lambda t, x: t + x)


def without_repeats(df: DataFrame, line: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Points that differ from the one before."""
    w = Window.partitionBy(*line).orderBy(*order)
    here = F.struct(*columns)
    return df.withColumn("_p", F.lag(here).over(w)).where(F.col("_p").isNull() | (F.col("_p") != here)).drop("_p")
