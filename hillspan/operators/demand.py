"""Demand between places: models of flows, disaggregation, thinning, draws."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.physics import unit_interval
from .relational import broadcast_if_few


def distances(places: DataFrame, key: str = "k") -> DataFrame:
    """i, j, m_i, m_j, d2, d of all ordered pairs of places (key, x, y, m): the model's matrix, for a number of places that its user bounds."""
    a = places.select(F.col(key).alias("i"), F.col("x").alias("_xi"), F.col("y").alias("_yi"), F.col("m").alias("m_i"))
    b = places.select(F.col(key).alias("j"), F.col("x").alias("_xj"), F.col("y").alias("_yj"), F.col("m").alias("m_j"))
    d2 = (F.col("_xi") - F.col("_xj")) * (F.col("_xi") - F.col("_xj")) + (F.col("_yi") - F.col("_yj")) * (F.col("_yi") - F.col("_yj"))
    return a.crossJoin(b).where("i <> j").withColumn("d2", d2).select("i", "j", "m_i", "m_j", "d2", F.sqrt("d2").alias("d"))


def gravity(pairs: DataFrame, epsilon: float = 1e-6) -> DataFrame:
    return pairs.withColumn("flow", F.col("m_i") * F.col("m_j") / (F.col("d2") + epsilon))


def radiation(pairs: DataFrame, d: str = "d2") -> DataFrame:
    """flow by the mass strictly nearer to i than j is: a running sum by distance less the sum at that distance, in place of a triple join. Null distance: out of reach, no flow."""
    upto = F.sum("m_j").over(Window.partitionBy("i").orderBy(d).rangeBetween(Window.unboundedPreceding, 0))
    nearer = upto - F.sum("m_j").over(Window.partitionBy("i", d))
    m, n = F.col("m_i"), F.col("m_j")
    out = pairs.withColumn("nearer", nearer)
    s = F.col("nearer")
    return out.withColumn("flow", F.when(F.col(d).isNull(), F.lit(0.0)).otherwise(m * n / ((m + s) * (m + n + s))))


def logit(pairs: DataFrame, beta: float = -0.01) -> DataFrame:
    """flow: i's mass dealt out by the soft maximum of beta * d."""
    w = Window.partitionBy("i")
    weight = F.exp(F.lit(beta) * F.col("d") - F.max(F.lit(beta) * F.col("d")).over(w))
    return pairs.withColumn("_w", weight).withColumn("flow", F.col("m_i") * F.col("_w") / F.sum("_w").over(w)).drop("_w")


def cost(flows: DataFrame, least: float = 1e-12) -> DataFrame:
    """cost: less the logarithm of j's share of i's flows, at least of a small one."""
    share = F.col("flow") / F.sum("flow").over(Window.partitionBy("i"))
    return flows.withColumn("cost", -F.ln(F.greatest(share, F.lit(least))))


def destination_choice(pairs: DataFrame, weight: Column, threshold: float = 0.0) -> DataFrame:
    """p: weights of j as shares of i's; those at or below the threshold go and the rest is brought back to 1."""
    w = Window.partitionBy("i")
    p = pairs.withColumn("_w", weight).withColumn("p", F.col("_w") / F.sum("_w").over(w)).where(F.col("p") > threshold)
    return p.withColumn("p", F.col("p") / F.sum("p").over(w)).drop("_w")


def fit_decay(flows: DataFrame, low: float = 200.0, high: float = 200_000.0, steps: int = 60) -> dict[str, float]:
    """d0 of p ~ m_j exp(-d / d0) for each origin, by Newton's method on beta = 1/d0, its error by origins, and counts.

    flows: i, j, m_j, d and flow (0 where none was seen). A step is one aggregate over origins, of which the driver gets
    two sums. Fails where the optimum is at a bound.
    """
    def sums(beta: float):
        z = F.ln("m_j") - F.lit(beta) * F.col("d")
        w = F.exp(z - F.max(z).over(Window.partitionBy("i")))
        each = flows.withColumn("w", w).groupBy("i").agg(F.sum("flow").alias("f"), F.sum(F.col("flow") * F.col("d")).alias("fd"), F.sum("w").alias("s0"), F.sum(F.col("w") * F.col("d")).alias("s1"), F.sum(F.col("w") * F.col("d") * F.col("d")).alias("s2"))
        mean = F.col("s1") / F.col("s0")
        score = -F.col("fd") + F.col("f") * mean
        return each.agg(F.sum(score).alias("score"), F.sum(score * score).alias("square"), F.sum(F.col("f") * (F.col("s2") / F.col("s0") - mean * mean)).alias("curve"), F.count_if(F.col("f") > 0).alias("n"), F.sum("f").alias("trips")).first()

    a, b = math.log(low), math.log(high)
    x = 0.5 * (a + b)
    for _ in range(steps):
        beta = math.exp(-x)
        s = sums(beta)
        # the likelihood rises with beta where the score is positive, so with log d0 where it is negative
        a, b = (a, x) if s.score > 0 else (x, b)
        new = x - s.score / (s.curve * beta) if s.curve > 0 else x
        new = new if a < new < b else 0.5 * (a + b)
        if abs(new - x) < 1e-9:
            break
        x = new
    if min(x - math.log(low), math.log(high) - x) < 1e-3:
        raise ValueError(f"the fit did not converge inside its bounds (log d0 = {x:.3f})")
    beta = math.exp(-x)
    s = sums(beta)
    error = math.sqrt(s.square) / abs(s.curve)
    return {"d0": 1 / beta, "d0_error": error / beta**2, "n_origins": s.n, "n_trips": float(s.trips), "z": beta / error if error else math.inf}


def weights(pixels: DataFrame, with_nodes: DataFrame) -> DataFrame:
    """district, cell, w: the cell's share of the district's population; the district's is of all pixels, also those of cells that have no nodes."""
    total = pixels.groupBy("district").agg(F.sum("pop").alias("_total"))
    inside = pixels.join(with_nodes.select("cell").distinct(), "cell", "left_semi").groupBy("district", "cell").agg(F.sum("pop").alias("_pop"))
    return inside.join(total, "district").select("district", "cell", (F.col("_pop") / F.col("_total")).alias("w"))


def disaggregated(trips: DataFrame, w: DataFrame) -> DataFrame:
    """origin, dest, flow by cell from trips by district (o, d, n): both ends dealt out by weights; two joins and a sum."""
    a = w.select(F.col("district").alias("o"), F.col("cell").alias("origin"), F.col("w").alias("_a"))
    b = w.select(F.col("district").alias("d"), F.col("cell").alias("dest"), F.col("w").alias("_b"))
    return trips.join(a, "o").join(b, "d").groupBy("origin", "dest").agg(F.sum(F.col("n") * F.col("_a") * F.col("_b")).alias("flow"))


def thinning_threshold(flows: DataFrame, most: int, group: Sequence[str] = ()) -> DataFrame:
    """group, tau: the least flow for which keeping all flows of tau or more, and f of f / tau for the others, keeps most pairs on average; 0 if there are no more.

    In ascending order with F the sum of the flows below one, n those from it on: tau = F / (most - n) where it falls
    between the flow before and that one. Values are counted once each before the window: a group has as many rows there
    as it has different flows.
    """
    g = list(group)
    once = flows.groupBy(*g, "flow").agg(F.count("*").alias("_c"))
    w, all_ = Window.partitionBy(*g).orderBy("flow"), Window.partitionBy(*g)
    below = F.sum(F.col("flow") * F.col("_c")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = once.select(*g, "flow", F.sum("_c").over(all_).alias("_n"), F.coalesce(below, F.lit(0)).alias("_below"), (F.sum("_c").over(all_) - F.coalesce(F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_from"), F.coalesce(F.lag("flow").over(w), F.lit(0)).alias("_before"))
    tau = F.col("_below") / F.nullif(F.lit(most) - F.col("_from"), F.lit(0))
    fits = (F.col("_from") < most) & (tau > F.col("_before")) & (tau <= F.col("flow"))
    largest = F.max("flow").cast("double")
    return s.groupBy(*g).agg(F.when(F.max("_n") <= most, F.lit(0.0)).otherwise(F.coalesce(F.min(F.when(fits, tau)), largest)).alias("tau"))


def thinned(flows: DataFrame, tau: DataFrame, draw: Column, group: Sequence[str] = ()) -> DataFrame:
    """Flows of tau or more as they are; the others with chance f / tau, at tau. draw: a number in [0, 1) of each pair."""
    joined = flows.join(broadcast_if_few(tau), list(group)) if group else flows.crossJoin(F.broadcast(tau))  # one row without a group
    kept = joined.where((F.col("flow") >= F.col("tau")) | (draw * F.col("tau") < F.col("flow")))
    return kept.withColumn("kept", F.greatest(F.col("flow").cast("double"), F.col("tau"))).drop("tau")


def draws(cells: DataFrame, k: int, seed: int) -> DataFrame:
    """cell, draw, role, u, v: two numbers in [0, 1) for the origin (0) and the destination (1) of each of k draws; they depend on seed, cell, draw and role alone."""
    rows = cells.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("role", F.explode(F.array(F.lit(0), F.lit(1))))
    h = lambda salt: F.pmod(F.xxhash64(F.lit(seed), "cell", "draw", "role", F.lit(salt)), F.lit(1 << 52)) / float(1 << 52)
    return rows.withColumn("u", h(0)).withColumn("v", h(1))


def net_rise(flows: DataFrame, places: DataFrame, group: Sequence[str]) -> DataFrame:
    """group, rise (sum of flow times the height that it gains), flow_used, n_missing. flows: origin, dest, flow; places: node, z."""
    a = places.select(F.col("node").alias("origin"), F.col("z").alias("_za"))
    b = places.select(F.col("node").alias("dest"), F.col("z").alias("_zb"))
    j = flows.join(a, "origin", "left").join(b, "dest", "left").withColumn("_dz", F.col("_zb") - F.col("_za"))
    return j.groupBy(*group).agg(F.sum(F.col("flow") * F.col("_dz")).alias("rise"), F.sum(F.when(F.col("_dz").isNotNull(), F.col("flow"))).alias("flow_used"), F.count_if(F.col("_dz").isNull()).alias("n_missing"))


def pair_draw(i: Column, j: Column, seed: int) -> Column:
    """A number in [0, 1) of a pair, by integer arithmetic that SQL engines share."""
    return unit_interval(i.cast("bigint") * 7919 + j.cast("bigint") * 104729 + seed)
