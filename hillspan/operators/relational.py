"""Filters, joins, order-aware deduplication and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import checkpointed


#: Rows of numbers and short strings, at most, of a table that goes to all tasks.
FEW_ROWS = 100_000


def broadcast_if_few(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it has at most FEW_ROWS (one job counts up to there); otherwise a join with it is as Spark plans it."""
    return F.broadcast(df) if df.limit(FEW_ROWS + 1).count() <= FEW_ROWS else df


def numbered(df: DataFrame, order: Sequence[Column], out: str, group: Sequence[str] = ()) -> DataFrame:
    """Rows with their number from 1 in an order, which must be total: within each group by a window, of the whole table by ranges, each of which adds the rows before it."""
    if group:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    placed = checkpointed(df.orderBy(*order).withColumn("_p", F.spark_partition_id()))
    sizes = placed.groupBy("_p").agg(F.count("*").alias("_n"))  # a row for each range
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    here = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return placed.join(F.broadcast(before), "_p").withColumn(out, here + F.col("_b")).drop("_p", "_b")


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Of rows with equal keys the last in order. The order must be total for the result to be one."""
    w = Window.partitionBy(*keys).orderBy(*(c.desc() for c in order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*(c.asc() for c in order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def with_observed(df: DataFrame, group: Sequence[str], observed: Column, columns: Sequence[str], suffix: str = "_0") -> DataFrame:
    """Every row with the columns of its group's one observed row: a window, so that no group is joined with itself."""
    w = Window.partitionBy(*group)
    return df.select("*", *(F.max(F.when(observed, F.col(c))).over(w).alias(c + suffix) for c in columns))


def not_done(candidates: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed run still has to do."""
    return candidates.join(done.select(key).distinct(), key, "left_anti")


def is_subset(part: DataFrame, whole: DataFrame, keys: Sequence[str], group: Sequence[str]) -> DataFrame:
    """For each group of part: rows, rows that whole lacks, and whether it lacks none."""
    there = whole.select(*keys).distinct().withColumn("_there", F.lit(True))
    joined = part.select(*dict.fromkeys([*group, *keys])).distinct().join(there, list(keys), "left")
    return joined.groupBy(*group).agg(F.count("*").alias("n"), F.count_if(F.col("_there").isNull()).alias("n_missing")).withColumn("complete", F.col("n_missing") == 0)


def nearly(a: Column, b: Column, tolerance: float) -> Column:
    return F.abs(a - b) <= tolerance


def compared(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, names: tuple[str, str]) -> DataFrame:
    """Two results side by side, rows of either kept: a union pivoted by source, one shuffle on the keys."""
    both = left.select(*keys, F.lit(names[0]).alias("_source"), value).unionByName(right.select(*keys, F.lit(names[1]).alias("_source"), value))
    return both.groupBy(*keys).pivot("_source", list(names)).agg(F.first(value))


def evenly_spaced(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """n rows of each group at even steps of its order, first and last among them; all of a group with n or fewer."""
    sizes = df.groupBy(*group).agg(F.count("*").alias("_size"))
    ranked = numbered(df, order, "_i", group).withColumn("_i", F.col("_i") - 1)
    ranked = ranked.join(sizes, list(group)) if group else ranked.crossJoin(F.broadcast(sizes))  # one row
    step = F.floor(F.col("_i") * (n - 1) / F.greatest(F.col("_size") - 1, F.lit(1)))
    before = F.floor((F.col("_i") - 1) * (n - 1) / F.greatest(F.col("_size") - 1, F.lit(1)))
    return ranked.where((F.col("_size") <= n) | (F.col("_i") == 0) | (step > before)).drop("_i", "_size")


def chunked(df: DataFrame, order: Sequence[Column], size: int, group: Sequence[str] = ()) -> DataFrame:
    """Rows with the number of their part of size rows (within each group)."""
    return numbered(df, order, "_i", group).withColumn("part", F.floor((F.col("_i") - 1) / size)).drop("_i")


def in_band(value: Column, excluded: Sequence[str]) -> Column:
    return ~value.isin(*excluded)


def working_day(day: Column, holidays: Sequence[str] = ()) -> Column:
    return (F.weekday(day) < 5) & ~day.cast("date").cast("string").isin(*holidays) if holidays else F.weekday(day) < 5


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """df, whose evaluation fails with the message at the first row that breaks the condition."""
    return df.where(F.when(condition, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))
