"""Scenarios: mode energies in long form, fallbacks between modes, parameter draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.physics import mode_energy, unit_interval

PARAMETERS = ("mass", "lam", "occupancy", "recovery")


def shares(split: DataFrame, trips: str = "trips", group: Sequence[str] = ()) -> DataFrame:
    """Modal shares of the modes at hand."""
    from pyspark.sql import Window

    return split.withColumn("share", F.col(trips) / F.sum(trips).over(Window.partitionBy(*group)))


def with_fallback(od: DataFrame, legs: Sequence[tuple[str, DataFrame, str]], threshold: Column) -> DataFrame:
    """od (origin, dest, ...) with mode and length of the first leg that is there and whose access is within the threshold; legs: mode, table (origin, dest, length, access), column of access. The last one should be there for all."""
    out, mode, length = od, F.lit(None).cast("string"), F.lit(None).cast("double")
    for name, table, access in legs:
        t = table.select("origin", "dest", F.col("length").cast("double").alias(f"_l_{name}"), F.col(access).alias(f"_a_{name}"))
        out = out.join(t, ["origin", "dest"], "left")
        fits = mode.isNull() & F.col(f"_l_{name}").isNotNull() & (F.col(f"_a_{name}") <= threshold)
        mode, length = F.when(fits, name).otherwise(mode), F.when(fits, F.col(f"_l_{name}")).otherwise(length)
    return out.select(*od.columns, mode.alias("mode"), length.alias("length"))


def energies(sums: DataFrame, parameters: DataFrame, keys: Sequence[str], tunnel_factor: Column | float = 1.0) -> DataFrame:
    """keys, mode, e: energy of each mode's sums (mode, length, climb, climb_off) under its parameters. climb_off: the part of the climb off the terrain, which the factor scales."""
    t = F.lit(tunnel_factor) if isinstance(tunnel_factor, float) else tunnel_factor
    climb = F.col("climb") + (t - 1.0) * F.coalesce(F.col("climb_off"), F.lit(0.0))
    j = sums.join(parameters, "mode")
    return j.select(*keys, "mode", mode_energy(F.col("mass"), F.col("recovery"), F.col("lam"), F.col("occupancy"), F.col("length"), climb).alias("e"))


def mixed(e: DataFrame, split: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, e: mode energies weighted by shares (mode, share); modes without a share weigh nothing."""
    return e.join(split.select("mode", "share"), "mode").groupBy(*keys).agg(F.sum(F.col("e") * F.col("share")).alias("e"))


def drawn(boxes: DataFrame, n: int, seed: int) -> DataFrame:
    """draw, mode, parameter, value: uniform between low and high, by integer arithmetic from seed, draw and the row's number. boxes: number, mode, parameter, low, high."""
    rows = boxes.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    u = unit_interval(F.col("draw") * 104729 + F.col("number") * 7919 + seed)
    return rows.select("draw", "mode", "parameter", (F.col("low") + (F.col("high") - F.col("low")) * u).alias("value"))


def wide(values: DataFrame, keys: Sequence[str] = ("draw", "mode")) -> DataFrame:
    """One row for each draw and mode, a column for each of PARAMETERS."""
    return values.groupBy(*keys).agg(*(F.max(F.when(F.col("parameter") == p, F.col("value"))).alias(p) for p in PARAMETERS))


def observed_status(e: DataFrame, group: Sequence[str], key: str, observed: Column, excess: float = 0.0) -> DataFrame:
    """group, e_0, rank, is_minimum, best (the least other key by energy), margin_pct of the best against the observed."""
    from pyspark.sql import Window

    x = e.withColumn("_o", F.max(F.when(observed, F.col("e"))).over(Window.partitionBy(*group)))
    other = ~observed
    out = x.groupBy(*group).agg(F.max("_o").alias("e_0"), (1 + F.count_if(other & (F.col("e") * (1 + excess) < F.col("_o")))).alias("rank"), F.min_by(key, F.struct("e", key)).alias("_all"), F.min(F.when(other, F.struct("e", F.col(key).alias("k")))).alias("_b"))
    return out.select(*group, "e_0", "rank", (F.col("rank") == 1).alias("is_minimum"), F.col("_b.k").alias("best"), (100 * (F.col("_b.e") / F.col("e_0") - 1)).alias("margin_pct"))


def breaking_factor(lines: DataFrame, group: Sequence[str], at_one: str, slope: str) -> DataFrame:
    """group, factor: the least s >= 1 at which a margin m + k (s - 1) of the group falls below 0: 1 if one does already, infinite if none will."""
    m, k = F.col(at_one), F.col(slope)
    s = F.when(m < 0, F.lit(1.0)).when(k < 0, 1.0 - m / F.nullif(k, F.lit(0.0))).otherwise(F.lit(float("inf")))
    return lines.groupBy(*group).agg(F.min(s).alias("factor"))


def overridden(defaults: DataFrame, measured: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Measured values in place of defaults; one outside of the default's low and high fails."""
    j = defaults.join(measured.select(*keys, F.col(value).alias("_m")), list(keys), "left")
    sound = F.col("_m").isNull() | F.col("_m").between(F.col("low"), F.col("high"))
    checked = F.when(sound, F.coalesce("_m", F.col(value))).otherwise(F.raise_error(F.lit("a measured value is outside of its range")).cast("double"))
    return j.withColumn(value, checked).drop("_m")


def scaled(parameters: DataFrame, modes: Sequence[str], factor: Column | float) -> DataFrame:
    """Masses of some modes times a factor, their energy per metre in proportion."""
    f = F.lit(factor) if isinstance(factor, float) else factor
    there = F.col("mode").isin(*modes)
    return parameters.withColumns({c: F.when(there, F.col(c) * f).otherwise(F.col(c)) for c in ("mass", "lam")})
