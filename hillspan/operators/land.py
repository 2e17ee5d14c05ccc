"""Land and areas: distances to rings, masks, clipping, selection of areas. A ring is an array of structs x, y, closed by its first point."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import normalised
from .geo import in_ring, moved

#: Degrees by which lakes shrink and land grows in a mask.
LAKE_SHRINK, LAND_BUFFER = 0.003, 1e-5


def edges(ring: Column) -> Column:
    """The ring's edges as an array of structs a, b."""
    n = F.size(ring)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.element_at(ring, i).alias("a"), F.element_at(ring, (i % n + 1).cast("int")).alias("b")))


def ring_area(ring: Column) -> Column:
    """Area inside of the ring; 0 of fewer than three points."""
    twice = F.aggregate(edges(ring), F.lit(0.0), lambda t, e: t + (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]))
    return F.when(F.size(ring) > 2, F.abs(twice) / 2.0).otherwise(0.0)


def ring_distance2(x: Column, y: Column, ring: Column) -> Column:
    """Square of the distance from a point to the ring's line."""

    def one(e: Column) -> Column:
        dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - e["a"]["x"]) * dx + (y - e["a"]["y"]) * dy) / (dx * dx + dy * dy)))
        ex, ey = x - (e["a"]["x"] + t * dx), y - (e["a"]["y"] + t * dy)
        return ex * ex + ey * ey

    return F.array_min(F.transform(edges(ring), one))


def on_land(x: Column, y: Column, land: Sequence[Column], lakes: Sequence[Column], buffer: float = LAND_BUFFER, shrink: float = LAKE_SHRINK) -> Column:
    """Whether a point is on one of the land's rings, grown by buffer, and not in a lake's, shrunk by shrink."""
    any_of = lambda xs: F.greatest(*xs, F.lit(False))
    firm = any_of([in_ring(x, y, r) | (ring_distance2(x, y, r) <= buffer * buffer) for r in land])
    wet = any_of([in_ring(x, y, r) & (ring_distance2(x, y, r) > shrink * shrink) for r in lakes])
    return firm & ~wet


def outside_after(nodes: DataFrame, variants: DataFrame, ring: Column) -> DataFrame:
    """variant, n, n_outside: of the nodes (node, x, y) that lie in the ring as they are, how many a variant moves out of it."""
    there = nodes.where(in_ring(F.col("x"), F.col("y"), ring)).select("node")
    kept = moved(nodes, variants).join(there, "node", "left_semi")
    return kept.groupBy("variant").agg(F.count("*").alias("n"), F.count_if(~in_ring(F.col("mx"), F.col("my"), ring)).alias("n_outside"))


def _cut(ring: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """The part of a ring to the left of a line."""
    side = lambda p: (bx - ax) * (p["y"] - ay) - (by - ay) * (p["x"] - ax)

    def kept(e: Column) -> Column:
        p, q = e["p"], e["q"]
        t = side(p) / F.nullif(side(p) - side(q), F.lit(0.0))
        on_line = F.struct((p["x"] + t * (q["x"] - p["x"])).alias("x"), (p["y"] + t * (q["y"] - p["y"])).alias("y"))
        a, b = side(p) >= 0, side(q) >= 0
        return F.when(a & b, F.array(q)).when(a, F.array(on_line)).otherwise(F.array(on_line, q))

    following = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, F.lit(1), F.least(F.size(ring), F.lit(1))))
    pairs = F.zip_with(ring, following, lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    return F.flatten(F.transform(F.filter(pairs, lambda e: (side(e["p"]) >= 0) | (side(e["q"]) >= 0)), kept))


def clipped(ring: Column, clip: Sequence[tuple[float, float]]) -> Column:
    """The part of a ring (of doubles) inside of a convex one, counter-clockwise; an empty array where they are apart. One edge of clip after the other cuts."""
    lines = F.array(*(F.struct(*(F.lit(float(v)).alias(n) for v, n in zip((*p, *q), ("ax", "ay", "bx", "by"), strict=True))) for p, q in zip(clip, [*clip[1:], clip[0]], strict=True)))
    kind = "array<struct<x:double,y:double>>"
    return F.aggregate(lines, ring.cast(kind), lambda r, e: _cut(r, e["ax"], e["ay"], e["bx"], e["by"]).cast(kind))


def read_areas(spark: SparkSession, path: str, west: float, south: float, east: float, north: float) -> DataFrame:
    """Areas of a Parquet table with bounds (x_min, y_min, x_max, y_max) that touch a box: the filter reaches the reader."""
    return spark.read.parquet(path).where((F.col("x_min") <= east) & (F.col("x_max") >= west) & (F.col("y_min") <= north) & (F.col("y_max") >= south))


def overlapping(areas: DataFrame, ring: str, west: float, south: float, east: float, north: float) -> DataFrame:
    """Areas whose ring shares area with a box, with it as overlap."""
    box = [(west, south), (east, south), (east, north), (west, north)]
    return areas.withColumn("overlap", ring_area(clipped(F.col(ring), box))).where("overlap > 0")


def largest_named(areas: DataFrame, name: str, ring: str, wanted: str) -> DataFrame:
    """The largest area whose name holds the wanted one, whatever the case, marks and spaces; ties to the first name. Fails where there is none."""
    found = areas.where(F.contains(normalised(F.col(name)), normalised(F.lit(wanted)))).withColumn("area", ring_area(F.col(ring)))
    best = found.agg(F.min_by(F.struct(*found.columns), F.struct((-F.col("area")).alias("a"), F.col(name).alias("k"))).alias("x"))
    return best.where(F.when(F.col("x").isNotNull(), F.lit(True)).otherwise(F.raise_error(F.lit("no area of this name")).cast("boolean"))).select("x.*")
