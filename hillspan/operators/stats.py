"""Aggregates over groups: spread, shares, inequality, agreement of orders."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import checkpointed
from .relational import broadcast_if_few


def sample_or_population_sd(x: Column) -> Column:
    """Of two or more values the sample's deviation, of one 0."""
    return F.when(F.count(x) > 1, F.stddev_samp(x)).otherwise(F.stddev_pop(x))


def exact_deviations(n: Column, total: Column, squares: Column) -> tuple[Column, Column]:
    """Deviations of a sample (0 of one value) and of a population from the number of whole numbers, their sum and their squares' sum: n * squares - total^2 is exact, where a difference of means cancels."""
    d = lambda c: c.cast("decimal(19,0)")
    spread = (d(n) * d(squares) - d(total) * d(total)).cast("double")
    return F.when(n > 1, F.sqrt(spread / F.nullif((n * (n - 1)).cast("double"), F.lit(0.0)))).otherwise(F.lit(0.0)), F.sqrt(spread / (n * n).cast("double"))


def weighted_mean(x: Column, w: Column) -> Column:
    return F.sum(x * w) / F.sum(w)


def share_where(condition: Column) -> Column:
    """Of the rows; 0 of none."""
    return F.count_if(condition) / F.greatest(F.count("*"), F.lit(1))


def counts_by(df: DataFrame, group: Sequence[str], what: str, values: Sequence[str]) -> DataFrame:
    """group, n, n_<value> for each value: one aggregate, no pivot's extra pass."""
    return df.groupBy(*group).agg(F.count("*").alias("n"), *(F.count_if(F.col(what) == v).alias(f"n_{v}") for v in values))


def text_list(x: Column, most: int | None = None, mark: str = ", ") -> Column:
    """The group's values in order, as text; most: that many at most (a report's limit)."""
    ordered = F.sort_array(F.collect_set(x.cast("string")))
    return F.array_join(F.slice(ordered, 1, most) if most else ordered, mark)


def average_rank(value: Column, group: Sequence[str] = ()) -> Column:
    """Rank from 1 with ties at their mean."""
    return F.rank().over(Window.partitionBy(*group).orderBy(value)) + (F.count("*").over(Window.partitionBy(*group, value)) - 1) / F.lit(2.0)


def rank_correlation(df: DataFrame, group: Sequence[str], a: str, b: str) -> DataFrame:
    """group, rho (Spearman). The sums are of doubled ranks, which are integers, so the order of rows changes nothing."""
    r = df.select(*group, (2 * average_rank(F.col(a), group)).cast("long").alias("ra"), (2 * average_rank(F.col(b), group)).cast("long").alias("rb"))
    s = r.groupBy(*group).agg(*(F.sum(x).cast("double").alias(n) for n, x in (("n", F.lit(1)), ("a", F.col("ra")), ("b", F.col("rb")), ("aa", F.col("ra") * F.col("ra")), ("bb", F.col("rb") * F.col("rb")), ("ab", F.col("ra") * F.col("rb")))))
    spread = F.sqrt((F.col("n") * F.col("aa") - F.col("a") * F.col("a")) * (F.col("n") * F.col("bb") - F.col("b") * F.col("b")))
    return s.select(*group, F.try_divide(F.col("n") * F.col("ab") - F.col("a") * F.col("b"), spread).alias("rho"))


#: Rows of a group from which it is cut in ranges, and how many of either value.
LARGE_GROUP, RANGES = 1_000_000, 64


def concordance(a: np.ndarray, b: np.ndarray) -> int:
    """Concordant less discordant pairs, by merging: in each round, every run counts what is less and more in the run before it."""
    n = len(a)
    if n < 2:
        return 0
    order = np.lexsort((b, a))
    a, rank = a[order], np.unique(b, return_inverse=True)[1][order].astype(np.int64)
    # pairs of one a, in the order of b, look concordant where b differs
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    same = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (rank[1:] != rank[:-1])]))

    def pairs(begin: np.ndarray) -> int:
        m = np.diff(np.append(begin, n))
        return int((m * (m - 1) // 2).sum())

    out = pairs(same) - pairs(first)
    width = 1
    place = np.arange(n)
    while width < n:
        run = place // (2 * width)
        left = place % (2 * width) < width
        key = run * np.int64(n + 1) + rank
        before, after = key[left], key[~left]
        size = np.bincount(run[left], minlength=int(run[-1]) + 1)
        begin = (np.cumsum(size) - size)[run[~left]]
        less, upto = np.searchsorted(before, after), np.searchsorted(before, after, side="right")
        out += int((less - begin).sum() - (size[run[~left]] - (upto - begin)).sum())
        rank = rank[np.lexsort((rank, run))]
        width *= 2
    return out


def _across(p: np.ndarray, q: np.ndarray, n: np.ndarray) -> int:
    """Concordant less discordant pairs of cells with counts, of different p and q."""
    m = np.zeros((p.max() + 1, q.max() + 1), np.int64)
    np.add.at(m, (p, q), n)
    rows = np.cumsum(m, axis=0) - m  # of smaller p
    low = np.cumsum(rows, axis=1) - rows
    high = rows.sum(axis=1, keepdims=True) - low - rows
    return sum(int(x) * int(y) for x, y in zip(m[p, q], (low - high)[p, q], strict=True))


def kendall(df: DataFrame, group: Sequence[str], key: str, a: str, b: str, large: int = LARGE_GROUP, ranges: int = RANGES) -> DataFrame:
    """group, tau_b, of groups of two rows or more with both values; infinite ones are left out.

    A group of more than large rows is cut in ranges of a and of b. Pairs of different ranges of both are counted by the numbers of
    rows in the cells; those of one range of a, and of one of b, by the task that has it, and those of one cell once less. So a task
    has a range of a group; one of a single value has no pairs to count.
    """
    usable = lambda c: F.col(c).isNotNull() & (F.abs(c) < float("inf"))
    rows = df.select(*group, F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b")).where(usable("_a") & usable("_b"))
    keys = {c: f"_g{i}" for i, c in enumerate(group)}
    at = F.array(*(F.lit(k / ranges) for k in range(1, ranges)))
    cut = lambda c: F.when(F.count("*") > large, F.array_distinct(F.percentile_approx(c, at))).otherwise(F.array().cast("array<double>"))
    cuts = checkpointed(rows.groupBy(*group).agg(F.count("*").alias("_n"), cut("_a").alias("_ca"), cut("_b").alias("_cb")).where("_n > 1").withColumnsRenamed(keys))
    met = rows.join(broadcast_if_few(cuts), reduce(and_, (F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items())) if group else F.lit(True))
    place = lambda c, v: F.size(F.filter(c, lambda t: t < F.col(v))).cast("int")
    met = met.select(*keys, "_a", "_b", place("_ca", "_a").alias("_p"), place("_cb", "_b").alias("_q"), (F.size("_ca") > 0).alias("_cut"))
    part = lambda p, q, sign: F.struct(p.cast("int").alias("p"), q.cast("int").alias("q"), F.lit(sign).alias("sign"))
    none = F.lit(-1)
    parts = F.when(F.col("_cut"), F.array(part(F.col("_p"), none, 1), part(none, F.col("_q"), 1), part(F.col("_p"), F.col("_q"), -1))).otherwise(F.array(part(none, none, 1)))
    pieces = met.select(*group, "_a", "_b", F.explode(parts).alias("_x")).select(*group, "_a", "_b", "_x.*")
    several = pieces.groupBy(*group, "p", "q", "sign").agg(F.min("_a").alias("a1"), F.max("_a").alias("a2"), F.min("_b").alias("b1"), F.max("_b").alias("b2")).where("a1 < a2 AND b1 < b2")
    several = checkpointed(several.select(*(F.col(c).alias(k) for c, k in keys.items()), F.col("p").alias("_sp"), F.col("q").alias("_sq"), F.col("sign").alias("_ss")))
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in (keys | {"p": "_sp", "q": "_sq", "sign": "_ss"}).items()]
    pieces = pieces.join(broadcast_if_few(several), reduce(and_, same), "left_semi")
    schema = ", ".join([*(f"{c} {df.schema[c].dataType.simpleString()}" for c in group), "c long"])
    own = lambda t, c: pa.table([*(t.column(k)[:1] for k in group), pa.array([c], pa.int64())], [*group, "c"])

    def within(t: pa.Table) -> pa.Table:
        return own(t, t.column("sign")[0].as_py() * concordance(t.column("_a").to_numpy(), t.column("_b").to_numpy()))

    def between(t: pa.Table) -> pa.Table:
        return own(t, _across(*(t.column(c).to_numpy() for c in ("_p", "_q", "n"))))

    cells = met.where("_cut").groupBy(*group, "_p", "_q").agg(F.count("*").alias("n"))
    counted = pieces.groupBy(*group, "p", "q", "sign").applyInArrow(within, schema).unionByName((cells.groupBy(*group) if group else cells.withColumn("_all", F.lit(0)).groupBy("_all")).applyInArrow(between, schema))
    # pairs that differ in a value: all but those of equal ones
    def apart(v: str, name: str) -> DataFrame:
        tied = met.groupBy(*group, v).agg(F.count("*").alias("m")).groupBy(*group).agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("m")).alias("s"))
        return tied.select(*group, ((F.col("n") * F.col("n") - F.col("s")) / 2).cast("long").alias(name))

    each = [apart("_a", "na"), apart("_b", "nb"), counted]
    every = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), each).groupBy(*group).agg(*(F.sum(c).cast("double").alias(c) for c in ("na", "nb", "c")))
    return every.select(*group, F.try_divide(F.coalesce("c", F.lit(0.0)), F.sqrt(F.col("na") * F.col("nb"))).alias("tau"))


def top_overlap(df: DataFrame, group: Sequence[str], key: str, a: str, b: str, k: int) -> DataFrame:
    """group, n_common: keys among the k least by a and by b. Ties by key."""
    w = Window.partitionBy(*group)
    ranked = df.withColumn("_i", F.row_number().over(w.orderBy(a, key))).withColumn("_j", F.row_number().over(w.orderBy(b, key)))
    return ranked.groupBy(*group).agg(F.count_if((F.col("_i") <= k) & (F.col("_j") <= k)).alias("n_common"))


def lorenz(df: DataFrame, group: Sequence[str], value: str, key: str) -> DataFrame:
    """group, key, share_of_rows, share_of_value: the curve's points in ascending order of value. value: exact (integer or decimal)."""
    w = Window.partitionBy(*group)
    order = w.orderBy(value, key)
    upto = F.sum(value).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("double")
    return df.select(*group, key, (F.row_number().over(order) / F.count("*").over(w)).alias("share_of_rows"), (upto / F.sum(value).over(w).cast("double")).alias("share_of_value"))


def gini(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """group, gini: rank-weighted sums; ties in any order give the same."""
    ranked = df.withColumn("_i", F.row_number().over(Window.partitionBy(*group).orderBy(value)))
    s = ranked.groupBy(*group).agg(F.count("*").alias("n"), F.sum(F.col("_i") * F.col(value)).cast("double").alias("ix"), F.sum(value).cast("double").alias("x"))
    return s.select(*group, (2.0 * F.col("ix") / (F.col("n") * F.col("x")) - (F.col("n") + 1) / F.col("n")).alias("gini"))


def top_share(df: DataFrame, group: Sequence[str], value: str, share: float) -> DataFrame:
    """group, share of the value that the largest rows hold: as many as the share of all, rounded half to even."""
    w = Window.partitionBy(*group)
    ranked = df.withColumn("_i", F.row_number().over(w.orderBy(F.col(value).desc()))).withColumn("_n", F.bround(F.count("*").over(w) * share))
    return ranked.groupBy(*group).agg((F.sum(F.when(F.col("_i") <= F.col("_n"), F.col(value))).cast("double") / F.sum(value).cast("double")).alias("top_share"))


def hexagon(x: Column, y: Column, width: float) -> tuple[Column, Column]:
    """Column and row (in halves) of the nearest centre of a hexagonal lattice: two rectangular lattices, moved by half a cell."""
    u, v = x / width, y / (width * 3**0.5)
    d = lambda c, r: (u - c) * (u - c) + 3 * (v - r) * (v - r)
    whole, half = (F.floor(u + 0.5), F.floor(v + 0.5)), (F.floor(u) + 0.5, F.floor(v) + 0.5)
    first = d(*whole) <= d(*half)
    return tuple(F.when(first, a.cast("double")).otherwise(b) for a, b in zip(whole, half, strict=True))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; null of two empty ones."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def pairs_below(df: DataFrame, group: Sequence[str], value: str, low: Column) -> DataFrame:
    """group, share of pairs of a low and another row in which the low one's value is less, and whether it is in all. A running count by value in place of the pairs."""
    w = Window.partitionBy(*group)
    others_upto = F.sum(F.when(~low, 1).otherwise(0)).over(w.orderBy(value).rangeBetween(Window.unboundedPreceding, 0))
    x = df.select(*group, F.col(value).alias("_v"), low.alias("_low"), (F.sum(F.when(~low, 1).otherwise(0)).over(w) - others_upto).alias("_above"))
    n, m = F.count_if("_low"), F.count_if(~F.col("_low"))
    share = F.try_divide(F.sum(F.when(F.col("_low"), F.col("_above"))), n * m)
    return x.groupBy(*group).agg(share.alias("share_below"), (F.max(F.when(F.col("_low"), F.col("_v"))) < F.min(F.when(~F.col("_low"), F.col("_v")))).alias("all_below"))
