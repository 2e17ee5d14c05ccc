"""Whole studies of a city's variants: candidates, summaries, statuses, costs of new places, networks of stops and roads."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import family, in_main_ensemble, parameter, rotation_name, scale_name, translation_name
from ..functions.physics import TIE, path_energy
from .relational import broadcast_if_few, keep_last

#: Change of energy (%) below which the best variant is a tie in summaries; excess (share) that counts as near the lowest.
NEGLIGIBLE_PCT, NEAR_LOWEST = 0.05, 0.01
#: Rank of a road's class on maps, 50 for others.
ROAD_RANKS = {
    "motorway": 1,
    "trunk": 2,
    "primary": 3,
    "secondary": 4,
    "tertiary": 5,
    "motorway_link": 6,
    "trunk_link": 7,
    "primary_link": 8,
    "secondary_link": 9,
    "tertiary_link": 10,
    "residential": 20,
    "unclassified": 21,
    "service": 30,
}
OTHER_ROAD = 50
#: Fixed value: walking costs this many times its length when a route is chosen.
WALK_FACTOR = 3.0


def motions(spark: SparkSession, step_m: float, n: int, angles: Sequence[float] = (0, 90, 180, 270), rotations: Sequence[float] = (), scales: Sequence[float] = ()) -> DataFrame:
    """variant, family, parameter, angle, a, b, c, e, dx, dy of all candidates: the observed network, translations (n distances in each direction), rotations, and scalings of either axis."""
    angle, size = F.radians(F.col("angle")), F.col("size")
    t = spark.range(1, n + 1).select((F.col("id") * step_m).alias("size")).crossJoin(F.broadcast(spark.createDataFrame([(float(a),) for a in sorted(set(angles))], "angle double")))
    kind = "variant string, family string, parameter double, angle double, a double, b double, c double, e double, dx double, dy double"
    out = spark.createDataFrame([("original", "original", 0.0, None, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0)], kind)
    one, zero = F.lit(1.0), F.lit(0.0)
    out = out.unionByName(t.select(translation_name(size, F.col("angle")).alias("variant"), F.lit("translation").alias("family"), size.alias("parameter"), "angle", one.alias("a"), zero.alias("b"), zero.alias("c"), one.alias("e"), (size * F.cos(angle)).alias("dx"), (size * F.sin(angle)).alias("dy")))
    if rotations:
        turned = [(float(x), math.cos(math.radians(x)), math.sin(math.radians(x))) for x in sorted(set(rotations)) if x]
        r = spark.createDataFrame(turned, "p double, c double, s double")
        out = out.unionByName(r.select(rotation_name(F.col("p")).alias("variant"), F.lit("rotation").alias("family"), F.col("p").alias("parameter"), F.lit(None).cast("double").alias("angle"), F.col("c").alias("a"), (-F.col("s")).alias("b"), F.col("s").alias("c"), F.col("c").alias("e"), zero.alias("dx"), zero.alias("dy")))
    if scales:
        s = spark.createDataFrame([(float(x), axis) for x in sorted(set(scales)) for axis in ("ns", "ew") if x > 0], "p double, axis string")
        along = lambda k: F.when(F.col("axis") == k, F.col("p")).otherwise(one)
        out = out.unionByName(s.select(scale_name(F.col("axis"), F.col("p")).alias("variant"), F.concat(F.lit("scale_"), "axis").alias("family"), F.col("p").alias("parameter"), F.lit(None).cast("double").alias("angle"), along("ew").alias("a"), zero.alias("b"), zero.alias("c"), along("ns").alias("e"), zero.alias("dx"), zero.alias("dy")))
    return out


def sampled_nodes(nodes: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """The nodes nearest to the box's corners and centre, and n others by a hash: a test before the full one (node, x, y)."""
    box = nodes.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    at = lambda a, b: (F.col("x") - a) * (F.col("x") - a) + (F.col("y") - b) * (F.col("y") - b)
    x0, x1, y0, y1 = (F.col(c) for c in ("x0", "x1", "y0", "y1"))
    spots = ((x0, y0), (x1, y0), (x0, y1), (x1, y1), ((x0 + x1) / 2, (y0 + y1) / 2))
    ends = nodes.crossJoin(F.broadcast(box)).agg(*(F.min_by("node", F.struct(at(a, b), "node")).alias(f"n{i}") for i, (a, b) in enumerate(spots)))
    ends = ends.select(F.explode(F.array(*(f"n{i}" for i in range(5)))).alias("node")).where("node is not null").distinct()
    rest = nodes.join(ends, "node", "left_anti").orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(n).select("node")
    return nodes.join(ends.unionByName(rest), "node", "left_semi")


def prepared(results: DataFrame, cities: DataFrame, energy: str = "e", sequence: str = "seq") -> DataFrame:
    """The main ensemble's rows of each city (city, filename, energy as text, sequence in the file): the last row of a variant, with changes against the observed one and whether it is lower. Of a city without them a row with a status alone."""
    e = F.col(energy).try_cast("double")
    rows = keep_last(results.withColumn("e", e).where(F.col("e").isNotNull() & ~F.isnan("e")), ["city", "filename"], [F.col(sequence)]).where(in_main_ensemble(F.col("filename")))
    seen = F.col("filename").rlike(r"^(graph_)?original(\.pkl)?$")
    w = Window.partitionBy("city")
    rows = rows.withColumn("e_0", F.max(F.when(seen, F.col("e"))).over(w)).select("city", "filename", "e", "e_0", family(F.col("filename")).alias("family"), parameter(F.col("filename")).alias("parameter"), (F.col("e") - F.col("e_0")).alias("delta"), (100 * (F.col("e") - F.col("e_0")) / F.col("e_0")).alias("delta_pct"), (~seen & (F.col("e") < (1 - TIE) * F.col("e_0"))).alias("lower"))
    there = results.select("city").distinct().withColumn("_file", F.lit(True))
    j = cities.select("city").join(there, "city", "left").join(rows, "city", "left")
    status = F.when(F.col("_file").isNull(), "read_error").when(F.col("filename").isNull(), "empty").when(F.col("e_0").isNull(), "missing_original").otherwise("ok")
    return j.withColumn("status", status).drop("_file")


def summary(rows: DataFrame, overridden: Sequence[str] = ()) -> DataFrame:
    """city, status (OK, DISPLACED_LOWER, CONSTRAINED), best and its change, rank of the observed and number of variants (the observed among them), of rows city, variant, e, observed. Ties by variant."""
    w = Window.partitionBy("city")
    x = rows.withColumn("e_0", F.max(F.when(F.col("observed"), F.col("e"))).over(w))
    s = x.groupBy("city").agg(F.min(F.struct("e", "variant", "observed")).alias("b"), F.max("e_0").alias("e_0"), F.count("*").alias("n_variants"), F.count_if(~F.col("observed")).alias("_n"), (F.count_if(F.col("e") < F.col("e_0")) + 1).alias("rank"))
    pct = 100.0 * (F.col("b.e") / F.col("e_0") - 1.0)
    constrained = (F.col("_n") == 0) | (F.col("city").isin(*overridden) if overridden else F.lit(False))
    status = F.when(constrained, "CONSTRAINED").when(F.col("b.observed") | (F.abs(pct) < NEGLIGIBLE_PCT), "OK").otherwise("DISPLACED_LOWER")
    return s.select("city", status.alias("status"), F.col("b.variant").alias("best"), (F.col("b.e") - F.col("e_0")).alias("delta"), pct.alias("delta_pct"), "rank", "n_variants")


def family_summary(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    """group, n, least and its parameter, largest, spread (% of the least), of rows with e and parameter."""
    s = rows.groupBy(*group).agg(F.count("*").alias("n"), F.min("e").alias("least"), F.min_by("parameter", F.struct("e", "parameter")).alias("best_parameter"), F.max("e").alias("largest"))
    return s.withColumn("spread_pct", 100 * (F.col("largest") - F.col("least")) / F.col("least"))


def best_and_worst(rows: DataFrame, valid: DataFrame) -> DataFrame:
    """city, best, worst of the moved variants among the valid ones (city, variant)."""
    moved = rows.where(~F.col("observed")).join(valid.select("city", "variant"), ["city", "variant"], "left_semi")
    return moved.groupBy("city").agg(F.min_by("variant", F.struct("e", "variant")).alias("best"), F.max_by("variant", F.struct("e", "variant")).alias("worst"))


def matched(places: DataFrame, name: str, wanted: DataFrame) -> DataFrame:
    """Of each wanted name (wanted) the places that fit best: equal in any case, or holding it, or held by it; two equal ones fail."""
    a, b = F.lower(name), F.lower("wanted")
    level = F.when(a == b, 1).when(F.contains(a, b), 2).when(F.contains(b, a), 3)
    j = places.crossJoin(broadcast_if_few(wanted)).withColumn("level", level).where("level is not null")
    w = Window.partitionBy("wanted")
    j = j.withColumn("_least", F.min("level").over(w)).where("level = _least").withColumn("_n", F.count("*").over(w))
    return j.where(F.when((F.col("level") == 1) & (F.col("_n") > 1), F.raise_error(F.lit("several places have this name")).cast("boolean")).otherwise(True)).drop("_least", "_n")


def regret_over(lines: DataFrame, group: Sequence[str], low: float, high: float, points: int = 201) -> DataFrame:
    """group, worst_regret, near_lowest: over an even grid of r, of observed lines (d_0, h_0) against all (d, h); near the lowest is NEAR_LOWEST or less everywhere."""
    grid = lines.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("r", low + (high - low) * F.col("i") / (points - 1))
    at = grid.groupBy(*group, "i").agg(F.min(F.col("d") + F.col("r") * F.col("h")).alias("best"), F.max(F.col("d_0") + F.col("r") * F.col("h_0")).alias("e_0"))
    best = F.least("best", "e_0")
    return at.groupBy(*group).agg(F.max((F.col("e_0") - best) / best).alias("worst_regret")).withColumn("near_lowest", F.col("worst_regret") <= NEAR_LOWEST)


def densification(choice: DataFrame, paths: DataFrame, residents: float = 25_000.0, trips: float = 1.0) -> DataFrame:
    """i, n_routed, n_failed, p_routed, mean round-trip length and climb, energy: of new residents at i who choose j with p and travel there and back along paths (i, j, w, g)."""
    out = paths.select("i", "j", F.col("w").alias("_lo"), F.col("g").alias("_go"))
    back = paths.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("w").alias("_lb"), F.col("g").alias("_gb"))
    j = choice.join(out, ["i", "j"], "left").join(back, ["i", "j"], "left").withColumn("_l", F.col("_lo") + F.col("_lb")).withColumn("_g", F.col("_go") + F.col("_gb"))
    there = F.col("_l").isNotNull()
    s = j.groupBy("i").agg(F.count_if(there).alias("n_routed"), F.count_if(~there).alias("n_failed"), F.sum(F.when(there, F.col("p"))).alias("p_routed"), F.sum(F.col("p") * F.col("_l")).alias("_pl"), F.sum(F.col("p") * F.col("_g")).alias("_pg")).where("p_routed > 0")
    s = s.withColumn("length", F.col("_pl") / F.col("p_routed")).withColumn("climb", F.col("_pg") / F.col("p_routed"))
    return s.withColumn("energy", F.lit(residents * trips) * path_energy(F.col("climb"), F.col("length"))).drop("_pl", "_pg")


def streets(arcs: DataFrame) -> DataFrame:
    """One arc for both directions of a street: the same ends and way. Of them the one from the smaller node."""
    keyed = arcs.withColumn("_a", F.least("u", "v")).withColumn("_b", F.greatest("u", "v"))
    w = Window.partitionBy("_a", "_b", "way").orderBy("u", "v", "length")
    return keyed.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_a", "_b", "_n")


def road_rank(classes: Column) -> Column:
    """Of an array of road classes the first one's rank."""
    ranks = F.create_map(*(F.lit(x) for k, v in ROAD_RANKS.items() for x in (k, v)))
    return F.coalesce(F.try_element_at(ranks, F.get(classes, 0)), F.lit(OTHER_ROAD))


def main_roads(arcs: DataFrame, most: int = 6000) -> DataFrame:
    """A map's roads: the most important, then the longest, at most most of them (the map's limit)."""
    return arcs.withColumn("rank", road_rank(F.col("classes"))).orderBy("rank", F.desc("length"), "u", "v").limit(most)


def stop_arcs(tracks: DataFrame, rule: str) -> DataFrame:
    """One track for each ordered pair of stops (u, v, length, n_points, id): the shortest (rail) or that of the fewest points (bus). Ties by id."""
    order = {"shortest": ["length", "id"], "fewest_points": ["n_points", "id"]}[rule]
    return tracks.groupBy("u", "v").agg(F.min_by(F.struct("length", "n_points", "id"), F.struct(*order)).alias("x")).select("u", "v", "x.length", "x.n_points", "x.id")


def straight_enough(track: Column, straight: Column, most: float = 3.0) -> Column:
    """Whether a track is at most most times as long as the straight line, of a metre at least."""
    return track <= most * F.greatest(straight, F.lit(1.0))


def with_transfers(arcs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Arcs (u, v, length) with weight and ride: rides as they are, walks (pairs a, b, d2) in both directions, dearer to choose and without energy."""
    rides = arcs.select("u", "v", "length", F.col("length").cast("double").alias("weight"), F.lit(True).alias("ride"))
    d = F.sqrt(F.col("d2").cast("double"))
    # one array for all pairs: an array of two structs would be made for each
    both = pairs.select("a", "b", d.alias("length")).select("a", "b", "length", F.explode(F.array(F.lit(True), F.lit(False))).alias("there"))
    end = lambda x, y: F.when(F.col("there"), F.col(x)).otherwise(F.col(y))
    walks = both.select(end("a", "b").alias("u"), end("b", "a").alias("v"), "length", (WALK_FACTOR * F.col("length")).alias("weight"), F.lit(False).alias("ride"))
    return rides.withColumn("length", F.col("length").cast("double")).unionByName(walks)


def reading_margin(translation_m: Column, radius_m: Column, rotation_deg: Column, scale: Column) -> Column:
    """Metres around a network in which its candidates can come to lie."""
    return F.greatest(translation_m, radius_m * F.sin(F.radians(rotation_deg)), radius_m * (scale - 1.0))
