"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed


def _pairs(df: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """Columns u and v: a row of df gives one for each of pairs."""
    both = F.array(*(F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs))
    return df.select(F.explode(both).alias("p")).select("p.u", "p.v").where("u <> v")


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Every node hands its larger neighbours (small: its smaller ones, and itself) to the least node it knows."""
    if small:
        out = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    else:
        out = _pairs(edges, ("u", "v"), ("v", "u"))
    joined = out.join(out.groupBy("u").agg(F.min("v").alias("m")), "u")
    if small:
        return _pairs(joined, ("v", "m"), ("u", "m")).distinct()
    return joined.where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of links (u, v; longs) but the roots: the least node of its component.

    A step keeps at most as many links as there were and hands over minima, which are combined before the shuffle, so no
    node gathers its neighbours. Steps end when the links have become stars around the roots.
    """
    edges, before = checkpointed(links.select("u", "v").where("u <> v").distinct()), None
    while True:
        edges = checkpointed(_star(_star(edges, small=False), small=True))
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
