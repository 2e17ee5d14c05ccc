"""Rasters of heights and people as rows of pixels (col, row, z): windows, resampling, heights of nodes, features.

A pixel's number grows eastwards and southwards from longitude and latitude 0, in steps of the raster's pixel size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .geo import pixel_rows
from .profile import valid


def dem_window(tiles: DataFrame, west: float, south: float, east: float, north: float, margin: float = 0.01) -> DataFrame:
    """col, row, z of the pixels whose centres are in a box and its margin, from tiles (west, south, east, north in degrees; step; z: rows of pixels from the north). Voids are null.

    Whole tiles are left out by their bounds first, four filters that reach the file's reader before any pixels are read.
    """
    w, s, e, n = west - margin, south - margin, east + margin, north + margin
    near = tiles.where((F.col("west") <= e) & (F.col("east") >= w) & (F.col("south") <= n) & (F.col("north") >= s))
    first = (F.round(F.col("west") / F.col("step")).cast("long"), -F.round(F.col("north") / F.col("step")).cast("long"))
    p = pixel_rows(near).select((first[0] + F.col("col")).alias("col"), (first[1] + F.col("row")).alias("row"), "step", F.when(valid(F.col("z")), F.col("z")).alias("z"))
    return p.where(((F.col("col") + 0.5) * F.col("step")).between(w, e) & (-(F.col("row") + 0.5) * F.col("step")).between(s, n)).select("col", "row", "z")


def grid(spark: SparkSession, width: int, height: int) -> DataFrame:
    """col, row of all pixels of a raster."""
    return spark.range(width * height).select((F.col("id") % width).alias("col"), F.floor(F.col("id") / width).alias("row"))


def sampled_known(cells: DataFrame, points: DataFrame, key: Sequence[str]) -> DataFrame:
    """key, z: like geo.sample(), of points (col, row) between the centres of four pixels, but voids weigh nothing: the others share their weight. Null where all are void."""
    c, r = F.col("col") - 0.5, F.col("row") - 0.5
    p = points.select(*key, F.floor(c).alias("_c"), F.floor(r).alias("_r"), (c - F.floor(c)).alias("_u"), (r - F.floor(r)).alias("_v"))
    four = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)))
    part = F.when(F.col("_k.i") == 1, F.col("_u")).otherwise(1 - F.col("_u")) * F.when(F.col("_k.j") == 1, F.col("_v")).otherwise(1 - F.col("_v"))
    q = p.withColumn("_k", F.explode(four)).select(*key, (F.col("_c") + F.col("_k.i")).alias("_pc"), (F.col("_r") + F.col("_k.j")).alias("_pr"), part.alias("_w"))
    known = cells.where(F.col("z").isNotNull()).select(F.col("col").alias("_pc"), F.col("row").alias("_pr"), "z")
    j = q.join(known, ["_pc", "_pr"], "left")
    there = F.col("z").isNotNull()
    return j.groupBy(*key).agg(F.try_divide(F.sum(F.when(there, F.col("z") * F.col("_w"))), F.sum(F.when(there, F.col("_w")))).alias("z"))


def resampled_raster(cells: DataFrame, target: DataFrame, col: Column, row: Column) -> DataFrame:
    """col, row, z of a target raster (col, row): col and row say where a target pixel's centre lies in the source, in pixels."""
    places = target.select(F.col("col").alias("_tc"), F.col("row").alias("_tr"), col.alias("col"), row.alias("row"))
    return sampled_known(cells, places, ["_tc", "_tr"]).select(F.col("_tc").alias("col"), F.col("_tr").alias("row"), "z")


def node_altitudes(cells: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """key, z: of the pixel that a node (col, row in pixels) lies in, its centre being the nearest one; 0 where there is none or it is void."""
    at = nodes.select(key, F.floor("col").alias("col"), F.floor("row").alias("row"))
    return at.join(cells.select("col", "row", "z"), ["col", "row"], "left").select(key, F.when(valid(F.col("z")), F.col("z")).otherwise(0.0).alias("z"))


def raster_runs(cells: DataFrame) -> DataFrame:
    """row, first, last, value: runs of neighbouring pixels of one rounded value along a row; void and 0 have none."""
    p = cells.where(F.col("z").isNotNull()).withColumn("value", F.round("z").cast("long")).where("value <> 0")
    gap = F.col("col") - F.row_number().over(Window.partitionBy("row", "value").orderBy("col"))
    return p.withColumn("_g", gap).groupBy("row", "value", "_g").agg(F.min("col").alias("first"), F.max("col").alias("last")).drop("_g")


def straight_gains(arcs: DataFrame, heights: DataFrame) -> DataFrame:
    """Arcs (u, v) with up and down of the straight line between the heights of their ends (node, z): a network that has heights at nodes alone."""
    at = lambda end: heights.select(F.col("node").alias(end), F.col("z").alias(f"_z_{end}"))
    j = arcs.join(at("u"), "u").join(at("v"), "v")
    rise = F.col("_z_v") - F.col("_z_u")
    return j.select(*arcs.columns, F.greatest(rise, F.lit(0)).alias("up"), F.greatest(-rise, F.lit(0)).alias("down"), F.col("_z_u").alias("z_u"), F.col("_z_v").alias("z_v"))


def graph_statistics(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """num_nodes, num_edges, z_mean, z_min, z_max, edge_len_mean, n_missing (nodes of height 0): one row, zeros where there is nothing. nodes: z; arcs: length."""
    n = nodes.agg(F.count("*").alias("num_nodes"), F.coalesce(F.avg("z"), F.lit(0.0)).alias("z_mean"), F.coalesce(F.min("z"), F.lit(0.0)).alias("z_min"), F.coalesce(F.max("z"), F.lit(0.0)).alias("z_max"), F.count_if(F.col("z") == 0).alias("n_missing"))
    e = arcs.agg(F.count("*").alias("num_edges"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("edge_len_mean"))
    return n.crossJoin(e)  # a row each


def prepared(tiles: DataFrame, people: DataFrame, config: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A study's inputs from its configuration, one row of west, south, east, north and margin: the heights in its box, and the runs of pixels with people there (col, row, z)."""
    c = config.first()
    heights = dem_window(tiles, c.west, c.south, c.east, c.north, c.margin)
    inside = heights.select("col", "row")
    return heights, raster_runs(people.join(inside, ["col", "row"], "left_semi"))
