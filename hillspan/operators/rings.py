"""Rings from ways: open lines joined at their ends, in order and direction, and what lies in what."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.folders import checkpointed
from .polygons import containing, polygon_index, ring_edges


def _ends(ways: DataFrame) -> DataFrame:
    """Both directions of each way: h (its number, times two, and one more for the way back), tail and head."""
    both = F.array(F.struct((F.col("way") * 2).alias("h"), F.col("a").alias("tail"), F.col("b").alias("head")), F.struct((F.col("way") * 2 + 1).alias("h"), F.col("b").alias("tail"), F.col("a").alias("head")))
    return ways.select(F.explode(both).alias("x")).select("x.*")


def _next(ends: DataFrame) -> DataFrame:
    """h and nx: the other way's direction that goes on where h ends, where just two ends meet; null elsewhere."""
    joints = ends.groupBy("tail").agg(F.count("*").alias("n"), F.min("h").alias("p"), F.max("h").alias("q")).where("n = 2").select(F.col("tail").alias("head"), "p", "q")
    back = F.col("h").bitwiseXOR(F.lit(1))
    # a closed way's own two directions meet at its end, and it goes on itself
    follow = F.when(F.col("p").bitwiseXOR(F.lit(1)) == F.col("q"), F.col("h")).when(F.col("p") == back, F.col("q")).when(F.col("q") == back, F.col("p"))
    return ends.join(joints, "head", "left").select("h", follow.alias("nx"))


def _jumped(state: DataFrame) -> DataFrame:
    """Each pointer over the one that it points to, with the least of both stretches."""
    ahead = state.select(F.col("h").alias("nx"), F.col("nx").alias("_nx"), F.col("least").alias("_least"))
    return state.join(ahead, "nx", "left").select("h", F.col("_nx").alias("nx"), F.least("least", "_least").alias("least"))


def stitched(ways: DataFrame) -> DataFrame:
    """ring (the least way), n_ways and points of the rings that ways (way, a, b, points: structs x, y from end a to end b) form.

    Ways join where just two ends meet, whichever way they were drawn; lines that end, or fork, are in no ring. A ring begins
    with its least way, in that one's direction, and does not repeat its first point. Pointers double their reach in each round,
    so a ring of n ways takes log n rounds, and no ring's ways are gathered before they are in order. Ways have different
    numbers, not negative; those without points or ends take no part.
    """
    w = checkpointed(ways.where("a IS NOT NULL AND b IS NOT NULL AND size(points) > 1").select(F.col("way").cast("long").alias("way"), "a", "b", "points"))
    follow = checkpointed(_next(_ends(w)))
    # the least direction of each circle; pointers of lines that end become null
    state, before = follow.withColumn("least", F.col("h")), None
    while True:
        state = checkpointed(_jumped(state))
        now = tuple(state.agg(F.count("nx"), F.sum(F.col("least").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    circles = checkpointed(state.where("nx IS NOT NULL").select("h", "least"))
    # of both directions of a ring, the one with its least way as it was drawn: steps from each to the last
    kept = circles.where("least % 2 = 0")
    steps = checkpointed(follow.join(kept, "h").select("h", "least", F.when(F.col("nx") != F.col("least"), F.col("nx")).alias("nx"), F.lit(0).cast("long").alias("d")).withColumn("d", F.when(F.col("nx").isNull(), 0).otherwise(1).cast("long")))
    while not steps.where("nx IS NOT NULL").isEmpty():
        ahead = steps.select(F.col("h").alias("nx"), F.col("nx").alias("_nx"), F.col("d").alias("_d"))
        steps = checkpointed(steps.join(ahead, "nx", "left").select("h", "least", F.col("_nx").alias("nx"), (F.col("d") + F.coalesce("_d", F.lit(0))).alias("d")))
    placed = steps.join(w.withColumn("h", F.explode(F.array(F.col("way") * 2, F.col("way") * 2 + 1))), "h")
    line = F.when(F.col("h") % 2 == 0, F.col("points")).otherwise(F.reverse("points"))
    parts = placed.select(F.shiftright("least", 1).alias("ring"), F.struct((-F.col("d")).alias("at"), F.slice(line, F.lit(1), F.size(line) - 1).alias("p")).alias("x"))
    rings = parts.groupBy("ring").agg(F.count("*").alias("n_ways"), F.sort_array(F.collect_list("x")).alias("x"))
    return rings.select("ring", "n_ways", F.flatten("x.p").alias("points"))


def nested(rings: DataFrame, size: float) -> DataFrame:
    """ring, depth (how many rings hold it) and shell (the ring itself, or of a hole, whose depth is odd, the least ring about it) of rings (ring, points) that do not cross. size: of the index' cells."""
    polygons = rings.select(F.col("ring").alias("poly"), F.col("points").alias("ring"))
    first = rings.select("ring", F.array_min(F.transform("points", lambda p: F.struct(p["y"].alias("y"), p["x"].alias("x")))).alias("p")).select("ring", "p.x", "p.y")
    held = containing(first, "ring", polygon_index(ring_edges(polygons), size), size).where("ring <> poly")
    depth = checkpointed(rings.select("ring").join(held.groupBy("ring").agg(F.count("*").alias("depth")), "ring", "left").select("ring", F.coalesce("depth", F.lit(0)).alias("depth")))
    around = held.join(depth.select(F.col("ring").alias("poly"), F.col("depth").alias("_d")), "poly").groupBy("ring").agg(F.max_by("poly", "_d").alias("_about"))
    return depth.join(around, "ring", "left").select("ring", "depth", F.when(F.col("depth") % 2 == 1, F.col("_about")).otherwise(F.col("ring")).alias("shell"))
