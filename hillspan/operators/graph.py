"""Networks as tables of arcs (u, v, weight and attributes): representative arcs, shortest paths, components."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.folders import checkpointed, removed, stored
from .routing import MOST_ARCS, batches_of, network_of, path_schema


def representative_arcs(arcs: DataFrame, by: Sequence[str]) -> DataFrame:
    """One arc for each (u, v): the least by the columns in by, which should end with a key."""
    rest = [c for c in arcs.columns if c not in ("u", "v")]
    best = arcs.groupBy("u", "v").agg(F.min_by(F.struct(*rest), F.struct(*by)).alias("_x"))
    return best.select("u", "v", *(F.col(f"_x.{c}").alias(c) for c in rest))


def reversed_arcs(arcs: DataFrame) -> DataFrame:
    return _swapped(arcs, {"u": "v", "v": "u"})


def _swapped(arcs: DataFrame, names: dict[str, str]) -> DataFrame:
    return arcs.select(*(F.col(names.get(c, c)).alias(c) for c in arcs.columns))


def nodes_of(arcs: DataFrame) -> DataFrame:
    """node: all ends of arcs."""
    return arcs.select(F.explode(F.array("u", "v")).alias("node")).distinct()


def shortest_paths(arcs: DataFrame, origins: DataFrame, carried: Sequence[str] = (), most_arcs: int = MOST_ARCS) -> DataFrame:
    """i, j, w and sums of carried from each origin (i) to all nodes in reach: Dijkstra's algorithm for each origin in parallel, ties by the least sums.

    The network goes to all tasks, as arrays of numbers, if it has at most most_arcs arcs; a larger one is searched by
    all_from() in rounds.
    """
    cols = ["w", *carried]
    network = network_of(arcs, cols, most_arcs)
    if network is None:
        return all_from(arcs, origins, carried)
    shared = arcs.sparkSession.sparkContext.broadcast(network)
    schema = path_schema(arcs, cols)
    kind = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        zero = (0,) * len(cols)

        def found(i: int) -> Iterator[tuple]:
            k = net.place(i)
            if k < 0:
                yield i, i, *zero
            else:
                best = net.search(k)
                for j, d in zip(net.nodes[list(best)].tolist(), best.values(), strict=True):
                    yield i, j, *d

        yield from batches_of((x for b in batches for i in b.column(0).to_pylist() for x in found(i)), kind)

    return origins.select(F.col("i").cast("long").alias("i")).distinct().mapInArrow(run, schema)


def all_from(arcs: DataFrame, origins: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """The same by rounds of relaxation: the nodes that came nearer in a round pass it on to their neighbours. For any size of network."""
    cols = ["w", *carried]
    value = F.struct(*cols)
    base = arcs.select("u", "v", *(F.col(c).alias(f"_{c}") for c in cols))
    known = origins.select(F.col("i").cast("long").alias("i")).distinct().select("i", F.col("i").alias("j"), *(F.lit(0).cast(arcs.schema[c].dataType).alias(c) for c in cols))
    front = known
    while True:
        passed = front.join(base, F.col("j") == F.col("u")).select("i", F.col("v").alias("j"), *((F.col(c) + F.col(f"_{c}")).alias(c) for c in cols))
        both = known.select("i", "j", value.alias("x"), F.lit(0).alias("new")).unionByName(passed.select("i", "j", value.alias("x"), F.lit(1).alias("new")))
        best = both.groupBy("i", "j").agg(F.min(F.struct("x", "new")).alias("b"))
        best = checkpointed(best.select("i", "j", *(F.col(f"b.x.{c}").alias(c) for c in cols), F.col("b.new").alias("new")))
        known, front = best.drop("new"), best.where("new = 1").drop("new")
        if front.isEmpty():
            return known


def path_totals(flows: DataFrame, paths: DataFrame, group: Sequence[str], carried: Sequence[str]) -> DataFrame:
    """group, flow, f_<column> (sums of flow times column) and n_unrouted, of flows (origin, dest, flow) over paths (i, j, ...). Trips from a node to itself do not count."""
    j = flows.where("origin <> dest").join(paths, (F.col("origin") == F.col("i")) & (F.col("dest") == F.col("j")), "left")
    there = F.col("j").isNotNull()
    return j.groupBy(*group).agg(F.sum(F.when(there, F.col("flow"))).alias("flow"), *(F.sum(F.col("flow") * F.col(c)).alias(f"f_{c}") for c in carried), F.count_if(~there).alias("n_unrouted"))


def reachable(arcs: DataFrame, start: DataFrame) -> DataFrame:
    """node of all that paths from start (node) reach, start included: rounds over the newly found."""
    known = checkpointed(start.select("node").distinct())
    front = known
    while not front.isEmpty():
        found = front.join(arcs, F.col("node") == F.col("u")).select(F.col("v").alias("node")).distinct()
        front = checkpointed(found.join(known, "node", "left_anti"))
        known = checkpointed(known.unionByName(front))
    return known


def strong_components(arcs: DataFrame) -> DataFrame:
    """node, component (its least node) of strongly connected components.

    In a round every node takes the least node that reaches it as its colour; a colour's own node, and all that reach it within the colour,
    are its component and leave. Components with many in and out arcs leave in the first rounds.
    """
    arcs = checkpointed(arcs.select("u", "v").where("u <> v").distinct())
    nodes = checkpointed(arcs.select(F.col("u").alias("node")).union(arcs.select("v")).distinct())
    out = None
    while not nodes.isEmpty():
        colour, before = nodes.withColumn("c", F.col("node")), None
        while True:
            passed = arcs.join(colour, F.col("u") == F.col("node")).select(F.col("v").alias("node"), "c")
            colour = checkpointed(colour.unionByName(passed).groupBy("node").agg(F.min("c").alias("c")))
            now = colour.agg(F.sum(F.col("c").cast("decimal(38,0)"))).first()[0]
            if now == before:
                break
            before = now
        cu, cv = colour.select(F.col("node").alias("u"), F.col("c").alias("cu")), colour.select(F.col("node").alias("v"), F.col("c").alias("cv"))
        inner = checkpointed(arcs.join(cu, "u").join(cv, "v").where("cu = cv").select("u", "v"))
        found = reachable(reversed_arcs(inner), colour.where("node = c"))
        done = checkpointed(colour.join(found, "node", "left_semi").withColumnRenamed("c", "component"))
        out = done if out is None else out.unionByName(done)
        nodes = checkpointed(nodes.join(done, "node", "left_anti"))
        arcs = checkpointed(arcs.join(nodes.withColumnRenamed("node", "u"), "u", "left_semi").join(nodes.withColumnRenamed("node", "v"), "v", "left_semi"))
    return out if out is not None else nodes.withColumn("component", F.col("node"))


def connected(links: DataFrame) -> DataFrame:
    """node, component (the least node that links (u, v) lead to, in either direction) of all ends of links: every round takes the least label of a node's neighbours and then that label's own, so that labels move on by ever larger steps."""
    spark = links.sparkSession
    both = checkpointed(links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct())
    (label, at), before = stored(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("c")).select("node", F.least("node", "c").alias("c"))), None
    while True:
        near = both.join(label, F.col("v") == F.col("node")).groupBy(F.col("u").alias("node")).agg(F.min("c").alias("_n"))
        low, low_at = stored(label.join(near, "node").select("node", F.least("c", "_n").alias("c")))
        up = low.select(F.col("node").alias("c"), F.col("c").alias("_u"))
        label, label_at = stored(low.join(up, "c").select("node", F.least("c", "_u").alias("c")))
        removed(spark, at)
        removed(spark, low_at)
        at, now = label_at, label.agg(F.sum(F.col("c").cast("decimal(38,0)"))).first()[0]
        if now == before:
            out = checkpointed(label.select("node", F.col("c").alias("component")))
            removed(spark, at)
            return out
        before = now


def largest_component(arcs: DataFrame) -> DataFrame:
    """The arcs inside the strong component with the most nodes; of equal ones that with the least node."""
    c = checkpointed(strong_components(arcs))
    best = c.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    nodes = c.join(best, "component", "left_semi").select("node")
    return arcs.join(nodes.withColumnRenamed("node", "u"), "u", "left_semi").join(nodes.withColumnRenamed("node", "v"), "v", "left_semi").select(*arcs.columns)


def route_arcs(stops: DataFrame, route: Sequence[str], order: str) -> DataFrame:
    """route, u, v of stops that follow one another."""
    from pyspark.sql import Window

    following = F.lead("stop").over(Window.partitionBy(*route).orderBy(order))
    return stops.select(*route, F.col("stop").alias("u"), following.alias("v")).where("v is not null")


def directed_terms(arcs: DataFrame, up: str = "up", down: str = "down") -> DataFrame:
    """Arcs in both directions, the way back with ascent and descent exchanged."""
    return arcs.unionByName(_swapped(arcs, {"u": "v", "v": "u", up: down, down: up}))


def consolidated(nodes: DataFrame, arcs: DataFrame, radius: float) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, x, y) and arcs (u, v, length) with all nodes that steps of radius or less join made one: the least number, in the middle of them, with their number n. Arcs between joined nodes go; of parallel ones the shortest stays."""
    from .geo import near_groups

    joined = near_groups(nodes, "node", radius)
    named = nodes.join(joined, "node", "left").withColumn("_to", F.coalesce("component", "node"))
    out = named.groupBy(F.col("_to").alias("node")).agg(F.count("*").alias("n"), (F.sum("x") / F.count("*")).alias("x"), (F.sum("y") / F.count("*")).alias("y"))
    of = lambda end: named.select(F.col("node").alias(end), F.col("_to").alias(f"_{end}"))
    moved = arcs.join(of("u"), "u").join(of("v"), "v").where("_u <> _v")
    return out, moved.groupBy(F.col("_u").alias("u"), F.col("_v").alias("v")).agg(F.min("length").alias("length"))


def simplified(arcs: DataFrame) -> DataFrame:
    """u, v, length, n: arcs (u, v, length; both directions of each street) with nodes that join just two others taken out, each chain as one arc.

    A chain's arcs hand over sums by doubling: a round joins every stretch with the one that follows it, so the longest
    chain takes the logarithm of its length in rounds. Rings without a crossing have no end and are left out.
    """
    a = checkpointed(arcs.where("u <> v").groupBy("u", "v").agg(F.min("length").alias("length")))
    inner = checkpointed(a.groupBy(F.col("u").alias("_m")).agg(F.count("*").alias("_k")).where("_k = 2").select("_m"))
    after = a.select(F.col("u").alias("v"), F.col("v").alias("_w"))
    following = a.join(inner, F.col("v") == F.col("_m")).join(after, "v").where("_w <> u").select("u", "v", "_w")
    state = a.join(following, ["u", "v"], "left").select("u", "v", F.col("v").alias("end"), "length", F.lit(1).cast("long").alias("n"), F.when(F.col("_w").isNotNull(), F.col("v")).alias("nu"), F.col("_w").alias("nv"))
    starts = lambda s: s.join(inner, F.col("u") == F.col("_m"), "left_anti")
    while True:
        state = checkpointed(state)
        if starts(state).where("nu is not null").isEmpty():
            return starts(state).select("u", F.col("end").alias("v"), "length", "n")
        nxt = state.select(F.col("u").alias("nu"), F.col("v").alias("nv"), F.col("end").alias("_e"), F.col("length").alias("_l"), F.col("n").alias("_n"), F.col("nu").alias("_nu"), F.col("nv").alias("_nv"))
        j = state.join(nxt, ["nu", "nv"], "left")
        state = j.select("u", "v", F.coalesce("_e", "end").alias("end"), (F.col("length") + F.coalesce("_l", F.lit(0))).alias("length"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"), F.col("_nu").alias("nu"), F.col("_nv").alias("nv"))
