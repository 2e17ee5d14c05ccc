"""Networks of lines and stops: members of routes, tracks between stops, sums by mode."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import checkpointed
from .geo import nearest_node
from .graph import nodes_of
from .relational import numbered
from .routing import paths_between
from .studies import straight_enough

#: Fixed value: least weight of an arc that is searched; a weight of 0 would be no arc.
LEAST_WEIGHT = 1e-3


def stop_members(members: DataFrame, route: str = "route") -> DataFrame:
    """The members (route, member, position, role) that are stops: those whose role begins with stop, or with platform on routes with fewer than two of them. Routes with fewer than two of either go."""
    w = Window.partitionBy(route)
    kind = F.when(F.startswith("role", F.lit("stop")), "stop").when(F.startswith("role", F.lit("platform")), "platform")
    m = members.withColumn("_k", kind).withColumn("_s", F.count_if(F.col("_k") == "stop").over(w)).withColumn("_p", F.count_if(F.col("_k") == "platform").over(w))
    use = F.when(F.col("_s") >= 2, "stop").when(F.col("_p") >= 2, "platform")
    return m.where(F.col("_k") == use).drop("_k", "_s", "_p")


def on_track(stops: DataFrame, track: DataFrame, size: float) -> DataFrame:
    """Stops (route, stop, x, y) with track: the stop itself where it is a node of its route's track (route, node, x, y), the nearest one otherwise, ties to the smaller."""
    exact = track.select("route", F.col("node").alias("stop")).distinct().withColumn("_on", F.lit(True))
    j = stops.join(exact, ["route", "stop"], "left")
    off = j.where("_on is null").withColumn("_id", F.struct("route", "stop"))
    near = nearest_node(off.select("_id", "route", "x", "y"), track, "_id", size, ["route"]).select("_id.route", "_id.stop", F.col("node").alias("_near"))
    return j.join(near, ["route", "stop"], "left").select(*stops.columns, F.when(F.col("_on"), F.col("stop")).otherwise(F.col("_near")).alias("track"))


def grouped_paths(arcs: DataFrame, pairs: DataFrame, group: str, carried: Sequence[str] = ()) -> DataFrame:
    """paths_between() within each group: arcs (group, u, v, w, carried), pairs (group, i, j). Nodes are not negative; groups are numbered, and a node's number includes its group's."""
    numbers = checkpointed(numbered(arcs.select(group).union(pairs.select(group)).distinct(), [F.col(group)], "_g"))
    most = nodes_of(arcs).agg(F.max("node")).first()[0]
    size = (most if most is not None else 0) + 1
    coded = arcs.join(numbers, group).select((F.col("_g") * size + F.col("u")).alias("u"), (F.col("_g") * size + F.col("v")).alias("v"), "w", *carried)
    asked = pairs.join(numbers, group).where((F.col("i") < size) & (F.col("j") < size)).select((F.col("_g") * size + F.col("i")).alias("i"), (F.col("_g") * size + F.col("j")).alias("j"))
    p = paths_between(coded, asked, carried)
    return p.withColumn("_g", F.floor(F.col("i") / size)).join(numbers, "_g").select(group, (F.col("i") % size).alias("i"), (F.col("j") % size).alias("j"), "w", *carried)


def tracks_between(pairs: DataFrame, arcs: DataFrame) -> DataFrame:
    """pairs (route, u, v: stops; tu, tv: their nodes on the track; lu, lv: ways from stop to track; straight) with length and fallback: along the route's track (arcs route, u, v, w; both directions), or the straight line where the track has a gap."""
    both = arcs.unionByName(arcs.select("route", F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    found = grouped_paths(both, pairs.select("route", F.col("tu").alias("i"), F.col("tv").alias("j")), "route").select("route", F.col("i").alias("tu"), F.col("j").alias("tv"), F.col("w").alias("_w"))
    j = pairs.join(found, ["route", "tu", "tv"], "left")
    return j.select(*pairs.columns, F.coalesce(F.col("lu") + F.col("_w") + F.col("lv"), F.col("straight")).alias("length"), F.col("_w").isNull().alias("fallback"))


def plausible(tracks: DataFrame, most: float = 3.0) -> DataFrame:
    """Tracks (length, straight) that are no detour around a gap of the map."""
    return tracks.where(straight_enough(F.col("length"), F.col("straight"), most))


def mode_arcs(arcs: DataFrame, modes: Sequence[str], measures: Sequence[str], weight: Column) -> DataFrame:
    """Arcs u, v, w for a search, with <measure>_<mode> of each: an arc counts for its mode alone, one of another mode (a walk) for none. w: the weight, LEAST_WEIGHT or more."""
    of = lambda m, k: F.when(F.col("mode") == k, F.col(m)).otherwise(F.lit(0)).alias(f"{m}_{k}")
    return arcs.select("u", "v", weight.alias("w"), *(of(m, k) for k in modes for m in measures))


def least_weight(weight: Column, least: float = LEAST_WEIGHT) -> Column:
    return F.greatest(weight, F.lit(least))


def dense_matrix(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """i, j, w of all pairs of nodes (node), infinite where no path joins them: the model's matrix, for a number of nodes that its user bounds."""
    pairs = nodes.select(F.col("node").alias("i")).crossJoin(nodes.select(F.col("node").alias("j")))
    return pairs.join(paths.select("i", "j", "w"), ["i", "j"], "left").select("i", "j", F.coalesce(F.col("w").cast("double"), F.lit(float("inf"))).alias("w"))


def evaluated(arcs: DataFrame, flows: DataFrame, group: str, draw: Sequence[str]) -> DataFrame:
    """group, draw and the totals of each routing: every flow (origin, dest, flow, draw) goes by the shortest way in plan (l2) and by the shortest one on the terrain (l3), in each group (a variant) of arcs (group, u, v, l2, l3, gain).

    gain_on_2d, l2_on_2d, l3_on_2d, gain_on_3d, l2_on_3d, l3_on_3d: sums of flow times the paths' attributes; trips that
    end where they begin, and those without a way, do not count.
    """
    od = flows.where("origin <> dest").groupBy("origin", "dest", *draw).agg(F.sum("flow").alias("flow"))
    asked = checkpointed(arcs.select(group).distinct().crossJoin(od.select(F.col("origin").alias("i"), F.col("dest").alias("j")).distinct()))  # every flow in every variant
    out = None
    for name, weight, other in (("2d", "l2", "l3"), ("3d", "l3", "l2")):
        p = grouped_paths(arcs.select(group, "u", "v", F.col(weight).alias("w"), "gain", F.col(other).alias("_o")), asked, group, ["gain", "_o"])
        j = od.join(p, (F.col("origin") == F.col("i")) & (F.col("dest") == F.col("j")))
        part = j.groupBy(group, *draw).agg(F.sum(F.col("flow") * F.col("gain")).alias(f"gain_on_{name}"), F.sum(F.col("flow") * F.col("w")).alias(f"{weight}_on_{name}"), F.sum(F.col("flow") * F.col("_o")).alias(f"{other}_on_{name}"))
        out = part if out is None else out.join(part, [group, *draw])
    return out
