"""Summaries and tables of studies: shares, comparisons of tables, statuses, scenario grids, markers, catalogues of cities."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import broadcast_if_few, numbered
from .selection import greedy_spaced
from .studies import NEGLIGIBLE_PCT

#: Tags of places, and the group that any of them makes, in the order in which groups are tried.
CONTEXTS = {
    "coastal": ["coastal", "island", "deltaic", "estuary", "lakefront", "water_network", "reclaimed_land", "coastal_constraint"],
    "relief": ["mountain_front", "basin", "volcanic", "protected_area", "relief_gradient", "forest_edge", "ravines"],
    "plain": ["flat_plain"],
}
#: Change (%) of the nearest alternative up to which a profile is flat, and from which its minimum is clear.
NEAR_FLAT_PCT, CLEAR_PCT = 0.20, 1.00


def share_by_band(df: DataFrame, band: str, value: str) -> DataFrame:
    """band, share of the whole value, to four decimals (halves up)."""
    s = df.groupBy(band).agg(F.sum(value).alias("_v"))
    total = s.agg(F.sum("_v").alias("_t"))  # one row
    return s.crossJoin(F.broadcast(total)).select(band, (F.floor(F.col("_v") / F.col("_t") * 10000 + 0.5) / 10000.0).alias("share"))


def diagonal_share(od: DataFrame, origin: str, dest: str, flow: str, group: Sequence[str] = ()) -> DataFrame:
    """group, share of the flow that ends where it begins."""
    return od.groupBy(*group).agg(F.try_divide(F.sum(F.when(F.col(origin) == F.col(dest), F.col(flow)).otherwise(0)), F.sum(flow)).alias("share"))


def coverage(weights: DataFrame, row: str, weight: str) -> DataFrame:
    """median, least: of the rows' sums of weights."""
    return weights.groupBy(row).agg(F.sum(weight).alias("_s")).agg(F.median("_s").alias("median"), F.min("_s").alias("least"))


def bounding_box(nodes: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    return nodes.groupBy(*group).agg(*(f(c).alias(f"{c}_{n}") for c in ("x", "y") for f, n in ((F.min, "min"), (F.max, "max"))))


def map_extent(west: Column, south: Column, east: Column, north: Column, pad: float = 0.05) -> tuple[list[Column], Column]:
    """Bounds with a share of their size around them, and the largest zoom (0 to 18) whose tile is as wide as they are."""
    dx, dy = (east - west) * pad, (north - south) * pad
    wide = F.greatest(east - west, north - south)
    zoom = F.size(F.filter(F.sequence(F.lit(0), F.lit(18)), lambda z: F.lit(360.0) / F.pow(F.lit(2.0), z) >= wide)) - 1
    return [west - dx, south - dy, east + dx, north + dy], zoom


def five_numbers(value: Column) -> list[Column]:
    """Least, quartiles and largest, on straight lines between values."""
    return [F.percentile(value, F.lit(q)).alias(n) for q, n in ((0.0, "least"), (0.25, "q25"), (0.5, "q50"), (0.75, "q75"), (1.0, "largest"))]


def highlighted(df: DataFrame, group: Sequence[str], value: str, share: float) -> DataFrame:
    """Rows at or above the group's quantile."""
    w = Window.partitionBy(*group)
    return df.withColumn("cut", F.percentile(F.col(value), F.lit(share)).over(w)).where(F.col(value) >= F.col("cut"))


def positioned(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Rows with their position in an order, which must be total."""
    return numbered(df, order, "position")


def thresholds_met(df: DataFrame, group: Sequence[str], holds: Column) -> DataFrame:
    """group, n, n_met: rows (thresholds, variants) for which the condition holds."""
    return df.groupBy(*group).agg(F.count("*").alias("n"), F.count_if(holds).alias("n_met"))


def completeness(rows: DataFrame, extra: DataFrame, keys: Sequence[str], value: str, group: Sequence[str], observed: Column) -> DataFrame:
    """group, n, n_missing, status: incomplete if any row lacks the value that extra has for its keys, constrained if the observed one is alone, ok otherwise."""
    j = rows.withColumn("_o", observed).join(extra.select(*keys, value), list(keys), "left")
    s = j.groupBy(*group).agg(F.count("*").alias("n"), F.count_if(F.col(value).isNull()).alias("n_missing"), F.count_if("_o").alias("_n"))
    status = F.when(F.col("_n") == 0, "incomplete").when(F.col("n") == F.col("_n"), "constrained").when(F.col("n_missing") > 0, "incomplete").otherwise("ok")
    return s.select(*group, "n", "n_missing", status.alias("status"))


def noise_summary(raw: DataFrame, smooth: DataFrame, group: Sequence[str], key: str, value: str, observed: Column) -> DataFrame:
    """group and sigma of smooth: common rows, the observed one's value against the raw one, and the median of these ratios over the rows that both tables have."""
    r = raw.select(*group, key, F.col(value).alias("_raw"))
    j = smooth.withColumn("_o", observed).join(r, [*group, key])
    ratio = F.try_divide(F.col(value), F.col("_raw"))
    return j.groupBy(*group, "sigma").agg(F.count("*").alias("n_common"), F.max(F.when(F.col("_o"), ratio)).alias("observed_ratio"), F.median(ratio).alias("median_ratio"))


def source_comparison(tables: Sequence[tuple[str, DataFrame]], group: Sequence[str], key: str, value: str, observed: Column) -> DataFrame:
    """group, n, and for each source its least change (%) against its own observed row, the key of it, and how many keys are cheaper than the observed: keys that all sources have."""
    out, n = None, len(tables)
    both = None
    for name, t in tables:
        x = t.withColumn("_o", observed).withColumn("_e", F.max(F.when(F.col("_o"), F.col(value))).over(Window.partitionBy(*group)))
        x = x.where(~F.col("_o")).select(*group, key, F.lit(name).alias("_source"), (100 * (F.col(value) / F.col("_e") - 1)).alias("_pct"))
        both = x if both is None else both.unionByName(x)
    there = both.withColumn("_n", F.count("*").over(Window.partitionBy(*group, key))).where(F.col("_n") == n)
    parts = []
    for name, _ in tables:
        mine = F.col("_source") == name
        parts += [F.min(F.when(mine, F.col("_pct"))).alias(f"least_{name}"), F.min(F.when(mine, F.struct("_pct", key)))[key].alias(f"best_{name}"), F.count_if(mine & (F.col("_pct") < -NEGLIGIBLE_PCT)).alias(f"n_cheaper_{name}")]
    out = there.groupBy(*group).agg(F.count_distinct(key).alias("n"), *parts)
    return out


def stale(existing: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """Rows of a resumed table that the run no longer has."""
    return existing.join(allowed.select(key).distinct(), key, "left_anti")


def context_group(tags: Column) -> Column:
    """The first group of CONTEXTS that shares a tag; null without one."""
    out = F.lit(None).cast("string")
    for name, words in reversed(CONTEXTS.items()):
        out = F.when(F.arrays_overlap(tags, F.array(*map(F.lit, words))), F.lit(name)).otherwise(out)
    return out


def profile_shape(rows: DataFrame, group: Sequence[str], e: str, observed: Column) -> DataFrame:
    """group, nearest_pct (the best alternative against the observed, %), shape: near_flat, moderate_increase, clear_increase, or undetermined without an alternative."""
    o = F.max(F.when(observed, F.col(e)))
    pct = 100.0 * (F.min(F.when(~observed, F.col(e))) / o - 1.0)
    s = rows.groupBy(*group).agg(pct.alias("nearest_pct"))
    x = F.col("nearest_pct")
    return s.withColumn("shape", F.when(x.isNull(), "undetermined").when(x <= NEAR_FLAT_PCT, "near_flat").when(x >= CLEAR_PCT, "clear_increase").otherwise("moderate_increase"))


def components(rows: DataFrame, group: Sequence[str], observed: Column) -> DataFrame:
    """Improvements against the observed row, in % of its energy (positive: better): in all, by climbing and by distance, and what the two leave. rows: e, vertical, horizontal; an unknown part counts as none."""
    w = Window.partitionBy(*group)
    of = lambda c: F.max(F.when(observed, F.col(c))).over(w)
    x = rows.select("*", *(of(c).alias(f"_{c}") for c in ("e", "vertical", "horizontal")))
    part = lambda c: (F.col(f"_{c}") - F.col(c)) / F.col("_e") * 100.0
    x = x.withColumn("pct", part("e")).withColumn("pct_vertical", part("vertical")).withColumn("pct_horizontal", part("horizontal"))
    left = F.col("pct") - (F.coalesce("pct_vertical", F.lit(0.0)) + F.coalesce("pct_horizontal", F.lit(0.0)))
    return x.withColumn("residual", left).drop("_e", "_vertical", "_horizontal")


def fixed_selection(costs: DataFrame, group: Sequence[str], tolerance: float, distance: float, n_low: int, n_high: int) -> DataFrame:
    """group, n_comparable, feasible, favourable, unfavourable (cells in order): the spaced choice under fixed criteria, without relaxation; a group that has too few spaced cells is not feasible and has none.

    A scan in order over the cells of a group whose flat cost is near its median: a bounded number of candidates.
    """
    near = costs.withColumn("_ref", F.median("flat").over(Window.partitionBy(*group))).where(F.abs(F.col("flat") - F.col("_ref")) <= tolerance * F.col("_ref")).drop("_ref")
    cell = costs.schema["cell"].dataType.simpleString()
    schema = ", ".join([*(f"{c} {costs.schema[c].dataType.simpleString()}" for c in group), "n_comparable long", "feasible boolean", f"favourable array<{cell}>", f"unfavourable array<{cell}>"])

    def select(t: pd.DataFrame) -> pd.DataFrame:
        low, high = t.sort_values(["climb", "cell"]), t.sort_values(["climb", "cell"], ascending=[False, True])
        first = low.iloc[greedy_spaced(low["x"].to_numpy(), low["y"].to_numpy(), n_low, distance)]
        second = high.iloc[greedy_spaced(high["x"].to_numpy(), high["y"].to_numpy(), n_high, distance, list(zip(first["x"], first["y"], strict=True)))]
        feasible = len(first) == n_low and len(second) == n_high
        keys = {c: t[c].iloc[0] for c in group}
        return pd.DataFrame([keys | {"n_comparable": len(t), "feasible": feasible, "favourable": first["cell"].tolist() if feasible else [], "unfavourable": second["cell"].tolist() if feasible else []}])

    return near.groupBy(*group).applyInPandas(select, schema)


def pair_order(terms: DataFrame, low: DataFrame, high: DataFrame, group: Sequence[str]) -> DataFrame:
    """group, n_pairs, n_failing, worst, holds: whether every place of high costs at least as much as every one of low, for all parameters in a box.

    terms: group, cell, vehicle, vertex (null: the central parameters), term. A pair's worst case adds up the least
    difference of each vehicle over the vertices of its box. low and high are a few chosen cells.
    """
    side = lambda chosen, n: terms.join(broadcast_if_few(chosen.select("cell")), "cell").select(*group, "vehicle", "vertex", F.col("cell").alias(n), F.col("term").alias(f"_{n}"))
    a, b = side(low, "cheap"), side(high, "dear")
    same = [a[c] == b[c] for c in (*group, "vehicle")] + [a.vertex.eqNullSafe(b.vertex)]
    d = a.join(b, same).select(*(a[c] for c in (*group, "vehicle", "vertex", "cheap")), "dear", (F.col("_dear") - F.col("_cheap")).alias("d"))
    each = d.where("vertex is not null").groupBy(*group, "cheap", "dear", "vehicle").agg(F.min("d").alias("d"))
    pairs = each.groupBy(*group, "cheap", "dear").agg(F.sum("d").alias("worst"))
    return pairs.groupBy(*group).agg(F.count("*").alias("n_pairs"), F.count_if(F.col("worst") < 0).alias("n_failing"), F.min("worst").alias("worst"), (F.min("worst") >= 0).alias("holds"))


def scenario_grid(e: DataFrame, dimensions: Sequence[str], key: str, families: Column, observed: Column) -> DataFrame:
    """dimensions, family, n_alternatives, is_minimum, rank, regret_pct, margin_pct, best: the observed row against each family's rows (families: an array of the families that a row counts for; the observed one counts for all)."""
    x = e.withColumn("_o", observed)
    names = x.where(~F.col("_o")).select(F.explode(families).alias("family")).distinct()  # a few families
    rows = x.where(~F.col("_o")).withColumn("family", F.explode(families)).unionByName(x.where("_o").crossJoin(broadcast_if_few(names)))
    e_0, best = F.max(F.when(F.col("_o"), F.col("e"))), F.min(F.when(~F.col("_o"), F.struct("e", F.col(key).alias("k"))))
    s = rows.withColumn("_e0", F.max(F.when(F.col("_o"), F.col("e"))).over(Window.partitionBy(*dimensions, "family")))
    s = s.groupBy(*dimensions, "family").agg(e_0.alias("_e"), best.alias("_b"), F.count_if(~F.col("_o")).alias("n_alternatives"), (1 + F.count_if(~F.col("_o") & (F.col("e") < F.col("_e0")))).alias("rank"))
    least = F.least(F.col("_e"), F.col("_b.e"))
    return s.where("n_alternatives > 0").select(*dimensions, "family", "n_alternatives", (F.col("rank") == 1).alias("is_minimum"), "rank", (100 * (F.col("_e") - least) / least).alias("regret_pct"), (100 * (F.col("_b.e") - F.col("_e")) / F.col("_e")).alias("margin_pct"), F.col("_b.k").alias("best"))


def breakdown(sums: DataFrame, parameters: DataFrame, group: Sequence[str], shares: DataFrame) -> DataFrame:
    """group, e, e_per_metre and the share of each mode's energy in the mix: sums (group, mode, length, climb), parameters and shares by mode (a few rows)."""
    from ..functions.physics import mode_energy

    j = sums.join(broadcast_if_few(parameters), "mode").join(broadcast_if_few(shares.select("mode", "share")), "mode")
    c = F.col
    e = mode_energy(c("mass"), c("recovery"), c("lam"), c("occupancy"), c("length"), c("climb")) * c("share")
    return j.select(*group, "mode", e.alias("e"), (c("length") * c("share")).alias("_l")).select(*group, "mode", "e", F.try_divide("e", "_l").alias("e_per_metre"), F.try_divide(c("e"), F.sum("e").over(Window.partitionBy(*group).orderBy("mode").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("e_share"))


def views(rows: DataFrame) -> dict[str, DataFrame]:
    """The four tables of a study from its classified rows (see studies.prepared): all variants, the lower ones, cities' counts, and cities without a result."""
    ok = rows.where("status = 'ok'")
    return {
        "all": ok.select("city", "filename", "family", "parameter", "e", "delta", "delta_pct"),
        "lower": ok.where("lower").select("city", "filename", "family", "parameter", "delta_pct"),
        "cities": ok.groupBy("city").agg(F.count("*").alias("n"), F.count_if("lower").alias("n_lower"), F.min("delta_pct").alias("least_pct")),
        "errors": rows.where("status <> 'ok'").select("city", "status").distinct(),
    }


def marker(name: Column, pieces: Sequence[tuple[str, Column]], mark: str = "; ") -> Column:
    """A name with those of its attributes (label, value) that are known, as text."""
    return F.concat_ws(mark, name, *(F.concat(F.lit(f"{label}="), value.cast("string")) for label, value in pieces))


def required(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows of the wanted keys; one that is missing fails."""
    there = rows.withColumn("_there", F.lit(True))
    j = wanted.select(key).distinct().join(there, key, "left")
    return j.where(F.when(F.col("_there"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no row of "), F.col(key).cast("string"))).cast("boolean"))).drop("_there")


def near_stored(moved: DataFrame, stored: DataFrame, keys: Sequence[str], most: float = 1e-7) -> DataFrame:
    """moved (keys, x, y), which must lie where the stored table (keys, x, y) has them: farther apart than most fails."""
    s = stored.select(*keys, F.col("x").alias("_x"), F.col("y").alias("_y"))
    j = moved.join(s, list(keys))
    far = F.greatest(F.abs(F.col("x") - F.col("_x")), F.abs(F.col("y") - F.col("_y"))) > most
    return j.where(F.when(~far, F.lit(True)).otherwise(F.raise_error(F.lit("a node is not where the stored variant has it")).cast("boolean"))).drop("_x", "_y")


def segments(lines: DataFrame, kind: str, geometry: str) -> DataFrame:
    """kind, x0, y0, x1, y1 of the straight pieces of lines: what a map draws."""
    n = F.size(geometry)
    pieces = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(F.element_at(geometry, i).alias("a"), F.element_at(geometry, (i + 1).cast("int")).alias("b"))))
    return lines.select(kind, F.explode(pieces).alias("p")).select(kind, F.col("p.a.x").alias("x0"), F.col("p.a.y").alias("y0"), F.col("p.b.x").alias("x1"), F.col("p.b.y").alias("y1"))


def shown_cities(summaries: DataFrame, complete: DataFrame, excluded: Sequence[str] = ()) -> DataFrame:
    """Cities whose observed network is the minimum (status OK), that are complete and not excluded."""
    ok = summaries.where(F.col("status") == "OK").select("city").join(complete.select("city").distinct(), "city", "left_semi")
    return ok.where(~F.col("city").isin(*excluded)) if excluded else ok


def catalogue(tables: DataFrame, excluded: Sequence[str] = ()) -> DataFrame:
    """The study's cities: those with a result table, without the excluded ones. tables: city and more."""
    cities = tables.select("city").distinct()
    return cities.where(~F.col("city").isin(*excluded)) if excluded else cities


def substituted(default: DataFrame, other: DataFrame, group: Sequence[str]) -> DataFrame:
    """Rows of the other table in those groups that it has, of the default one in the rest, with source."""
    has = other.select(*group).distinct()
    rest = default.join(has, list(group), "left_anti")
    return other.withColumn("source", F.lit("other")).unionByName(rest.withColumn("source", F.lit("default")))


def listed(graphs: DataFrame, stats: DataFrame, name: str) -> DataFrame:
    """Graph files in the order of their names, those whose variant the table of statistics has on land (variant, on_land)."""
    on = stats.where("on_land").select(F.col("variant").alias("_v"))
    bare = F.regexp_replace(F.regexp_replace(F.col(name), "^graph_", ""), r"\.pkl$", "")
    return positioned(graphs.withColumn("_v", bare).join(on, "_v", "left_semi").drop("_v"), [F.col(name)])
