"""Selection of places: quantile groups, comparable costs, spacing."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def candidates(cells: DataFrame, most: int) -> DataFrame:
    """Cells (cell, x, y, pop) to look at, at most most: of the densest 35 %, of the half around the weighted centre and of the outer quarter the most populous, each cell once. Ties by cell."""
    s = cells.agg((F.sum(F.col("pop") * F.col("x")) / F.sum("pop")).alias("cx"), (F.sum(F.col("pop") * F.col("y")) / F.sum("pop")).alias("cy"))
    d = (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy"))
    c = cells.crossJoin(F.broadcast(s)).withColumn("d", F.sqrt(d)).drop("cx", "cy")
    cuts = c.agg(F.percentile("pop", F.lit(0.65)).alias("q_pop"), F.percentile("d", F.lit(0.5)).alias("q_half"), F.percentile("d", F.lit(0.75)).alias("q_outer"))
    c = c.crossJoin(F.broadcast(cuts))
    groups = ((F.col("pop") >= F.col("q_pop"), most // 2), (F.col("d") <= F.col("q_half"), most // 4), (F.col("d") >= F.col("q_outer"), most // 4))
    parts = [c.where(cond).orderBy(F.desc("pop"), "cell").limit(n) for cond, n in groups]
    chosen = parts[0].unionByName(parts[1]).unionByName(parts[2]).select("cell", "x", "y", "pop", "d").distinct()
    return chosen.orderBy(F.desc("pop"), "cell").limit(most)


def comparable(costs: DataFrame, group: Sequence[str], tolerances: Sequence[float], least: int) -> DataFrame:
    """Rows (key, flat, climb) whose flat cost is within the first tolerance of its median that keeps least rows, with the tolerance; all rows, tolerance null, if none does. One pass over all tolerances."""
    w = Window.partitionBy(*group)
    ref = costs.withColumn("_ref", F.median("flat").over(w))
    inside = lambda t: F.col("flat").between(F.col("_ref") * (1 - t), F.col("_ref") * (1 + t))
    first = F.lit(None).cast("double")
    for t in reversed(tolerances):
        first = F.when(F.count_if(inside(t)).over(w) >= least, F.lit(t)).otherwise(first)
    chosen = ref.withColumn("tolerance", first)
    keep = F.col("tolerance").isNull() | inside(F.col("tolerance"))
    return chosen.where(keep).drop("_ref")


def greedy_spaced(x: np.ndarray, y: np.ndarray, n: int, distance: float, taken: Sequence[tuple[float, float]] = ()) -> list[int]:
    """Places in order, each at least distance from all before it and from those taken, until there are n."""
    chosen: list[int] = []
    held = list(taken)
    for i in range(len(x)):
        if len(chosen) == n:
            break
        if distance <= 0 or all(np.hypot(x[i] - a, y[i] - b) >= distance for a, b in held):
            chosen.append(i)
            held.append((x[i], y[i]))
    return chosen


def spaced(costs: DataFrame, group: Sequence[str], n_low: int, n_high: int, distance: float, relaxations: Sequence[float] = (1.0, 0.75, 0.5, 0.25, 0.0)) -> DataFrame:
    """group, cell, kind, rank, distance_used: the n_low cheapest and n_high dearest by climb (ties by cell) that keep their distance, at the first relaxation that gives all; none if no one does.

    A scan in order, for the bounded number of candidates of a group (see candidates()).
    """
    schema = ", ".join([*(f"{c} {costs.schema[c].dataType.simpleString()}" for c in group), f"cell {costs.schema['cell'].dataType.simpleString()}", "kind string", "rank long", "distance_used double"])

    def select(t: pd.DataFrame) -> pd.DataFrame:
        low, high = t.sort_values(["climb", "cell"]), t.sort_values(["climb", "cell"], ascending=[False, True])
        for r in relaxations:
            a = greedy_spaced(low["x"].to_numpy(), low["y"].to_numpy(), n_low, distance * r)
            first = low.iloc[a]
            b = greedy_spaced(high["x"].to_numpy(), high["y"].to_numpy(), n_high, distance * r, list(zip(first["x"], first["y"], strict=True)))
            if len(a) == n_low and len(b) == n_high:
                out = pd.concat([first.assign(kind="favourable"), high.iloc[b].assign(kind="unfavourable")]).sort_values(["climb", "cell"])
                return out.assign(rank=range(1, len(out) + 1), distance_used=distance * r)[[*group, "cell", "kind", "rank", "distance_used"]]
        return t.iloc[:0].assign(kind="", rank=0, distance_used=0.0)[[*group, "cell", "kind", "rank", "distance_used"]]

    return costs.groupBy(*group).applyInPandas(select, schema)
