"""Polygons as tables of rings: an index of cells for points, masks with tolerance, and the overlay of any two layers.

A polygon is all rows (poly, ring) of a name; a ring is an array of structs x, y, closed by its first point. What an odd
number of its rings' edges separate from far away is inside, so holes are rings like others, in any direction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geo import spread_by
from .relational import broadcast_if_few

#: Edges of a row of the index, at most, about; of a cell with more there are several rows.
PART = 256
#: Edges times heights of a strip that are worked on together, about.
CELLS = 1 << 18
#: Share of a cell by which an edge beside it counts as in it, so that rounding leaves no edge out.
MARGIN = 1e-9
_INDEX = "i long, last long, j long, poly {poly}, base int, toggles array<double>, edges array<struct<ax:double,ay:double,bx:double,by:double>>"


def ring_edges(polygons: DataFrame) -> DataFrame:
    """poly, ax, ay, bx, by: the edges of all rings (poly, ring); points that repeat give none, and rings with a null point go."""
    n = F.size("ring")
    at = lambda i: F.element_at("ring", i)
    whole = polygons.where((n > 0) & ~F.exists("ring", lambda p: p.isNull() | p["x"].isNull() | p["y"].isNull()))
    e = whole.select("poly", F.explode(F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(at(i).alias("a"), at((i % n + 1).cast("int")).alias("b")))).alias("e"))
    ends = e.select("poly", *(F.col(f"e.{p}.{c}").cast("double").alias(f"{p}{c}") for p in "ab" for c in "xy"))
    return ends.where("ax <> bx OR ay <> by")


def _rows_of(size: float, radius: float = 0.0) -> Column:
    low, high = F.least("ay", "by") - radius, F.greatest("ay", "by") + radius
    return F.sequence(F.floor(low / size - MARGIN), F.floor(high / size + MARGIN))


def _runs(edges: pa.Table, size: float) -> Iterator[tuple]:
    """Rows of the index of one polygon's strip, from its edges there."""
    poly, j = edges.column("poly")[0].as_py(), edges.column("j")[0].as_py()
    ax, ay, bx, by = (edges.column(c).to_numpy() for c in ("ax", "ay", "bx", "by"))
    low, high = np.minimum(ay, by), np.maximum(ay, by)
    bottom, margin = j * size, size * MARGIN
    # the cells that each edge passes in the strip
    x1, x2 = (ax + (np.clip(y, low, high) - ay) / (by - ay) * (bx - ax) for y in (bottom - margin, bottom + size + margin))
    first, last = np.floor(np.minimum(x1, x2) / size - 1e-6).astype(np.int64), np.floor(np.maximum(x1, x2) / size + 1e-6).astype(np.int64)
    cells: dict[int, list[int]] = {}
    for k, (c1, c2) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
        for c in range(c1, c2 + 1):
            cells.setdefault(c, []).append(k)
    # what lies to the right of a cell changes a point's parity at the heights of its ends, of which equal ones cancel
    order = np.argsort(-first, kind="stable").tolist()
    toggles: set[float] = set()
    base, taken, before = 0, 0, None
    for c in sorted(cells, reverse=True):
        while taken < len(order) and first[order[taken]] > c:
            for y in (float(low[order[taken]]), float(high[order[taken]])):
                if y < bottom - margin:
                    base ^= 1
                elif y <= bottom + size + margin:
                    toggles ^= {y}
            taken += 1
        if before is not None and c + 1 < before and (base or toggles):
            yield c + 1, before - 1, j, poly, base, sorted(toggles), None  # a run of cells inside
        for p in range(0, len(cells[c]), PART):
            part = [{"ax": float(ax[k]), "ay": float(ay[k]), "bx": float(bx[k]), "by": float(by[k])} for k in cells[c][p : p + PART]]
            yield c, c, j, poly, 0 if p else base, [] if p else sorted(toggles), part
        before = c


def polygon_index(edges: DataFrame, size: float) -> DataFrame:
    """The cells (i, j; squares of a side of size) that polygons touch, from ring_edges(): those wholly inside, and those with edges, each with the edges in it and what those to its right add to a point's parity.

    An edge is in the cells that it passes; a polygon has a row for each cell in it, so size is chosen by area and edges.
    One strip of one polygon is worked on at a time.
    """
    edge = pa.struct([(c, pa.float64()) for c in ("ax", "ay", "bx", "by")])

    def run(t: pa.Table) -> pa.Table:
        columns = list(zip(*_runs(t, size), strict=True)) or [()] * 7
        kinds = [pa.int64(), pa.int64(), pa.int64(), t.schema.field("poly").type, pa.int32(), pa.list_(pa.float64()), pa.list_(edge)]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["i", "last", "j", "poly", "base", "toggles", "edges"])

    sloped = edges.where("ay <> by").withColumn("j", F.explode(_rows_of(size)))
    runs = sloped.groupBy("poly", "j").applyInArrow(run, _INDEX.format(poly=edges.schema["poly"].dataType.simpleString()))
    return runs.withColumn("i", F.explode(F.sequence("i", "last"))).drop("last")


def containing(points: DataFrame, key: str, index: DataFrame, size: float) -> DataFrame:
    """key and poly of every point (key, x, y) and polygon that holds it. A point on an edge is inside where a ray to the right says so, as in_ring() does; points with a null coordinate are in none. Keys are unique."""
    p = points.select(key, F.col("x").cast("double").alias("_x"), F.col("y").cast("double").alias("_y"))
    p = p.withColumns({"i": F.floor(F.col("_x") / size), "j": F.floor(F.col("_y") / size)})
    x, y = F.col("_x"), F.col("_y")
    crosses = lambda e: ((e["ay"] > y) != (e["by"] > y)) & (x < (e["bx"] - e["ax"]) * (y - e["ay"]) / F.nullif(e["by"] - e["ay"], F.lit(0.0)) + e["ax"])
    odd = F.col("base") + F.size(F.filter("toggles", lambda t: t <= y)) + F.coalesce(F.size(F.filter("edges", crosses)), F.lit(0))
    met = p.join(index, ["i", "j"]).select(key, "poly", odd.alias("_odd"))
    return met.groupBy(key, "poly").agg(F.sum("_odd").alias("_odd")).where("_odd % 2 = 1").select(key, "poly")


def near_rings(points: DataFrame, key: str, edges: DataFrame, radius: float, size: float) -> DataFrame:
    """key, poly and d2 of every point (key, x, y) at most radius from a polygon's edge, the least square of the distance: edges are dealt to the cells about them."""
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    e = edges.withColumn("j", F.explode(_rows_of(size, radius)))
    # the part of the edge within radius of the strip, which is its whole extent where it is flat
    at = lambda h: F.col("ax") + (F.least(F.greatest(h, low), high) - F.col("ay")) / F.nullif(dy, F.lit(0.0)) * dx
    y1, y2 = F.col("j") * size - radius, (F.col("j") + 1) * size + radius
    ends = (F.coalesce(at(y1), F.least("ax", "bx")), F.coalesce(at(y2), F.greatest("ax", "bx")))
    e = e.withColumn("i", F.explode(F.sequence(F.floor((F.least(*ends) - radius) / size - 1e-6), F.floor((F.greatest(*ends) + radius) / size + 1e-6))))
    p = points.select(key, F.col("x").cast("double").alias("_x"), F.col("y").cast("double").alias("_y"))
    p = p.withColumns({"i": F.floor(F.col("_x") / size), "j": F.floor(F.col("_y") / size)})
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("_x") - F.col("ax")) * dx + (F.col("_y") - F.col("ay")) * dy) / (dx * dx + dy * dy)))
    ex, ey = F.col("_x") - (F.col("ax") + t * dx), F.col("_y") - (F.col("ay") + t * dy)
    return p.join(e, ["i", "j"]).select(key, "poly", (ex * ex + ey * ey).alias("d2")).where(F.col("d2") <= radius * radius).groupBy(key, "poly").agg(F.min("d2").alias("d2"))


def land_mask(points: DataFrame, key: str, land: DataFrame, lakes: DataFrame, buffer: float, shrink: float, size: float) -> DataFrame:
    """key and on_land of every point (key, x, y): in a polygon of land (poly, ring) grown by buffer, and in none of lakes shrunk by shrink."""
    edges = {"land": ring_edges(land), "lakes": ring_edges(lakes)}
    inside = {k: containing(points, key, polygon_index(e, size), size) for k, e in edges.items()}
    firm = inside["land"].select(key).union(near_rings(points, key, edges["land"], buffer, size).select(key)).distinct()
    wet = inside["lakes"].join(near_rings(points, key, edges["lakes"], shrink, size), [key, "poly"], "left_anti").select(key).distinct()
    flags = firm.withColumn("_f", F.lit(1)).unionByName(wet.withColumn("_f", F.lit(2))).groupBy(key).agg(F.sum("_f").alias("_f"))
    return points.select(key).distinct().join(flags, key, "left").select(key, F.coalesce(F.col("_f") == 1, F.lit(False)).alias("on_land"))


def _crossings(a: np.ndarray, b: np.ndarray, low: float, high: float) -> np.ndarray:
    """Heights, between low and high, at which edges of a (rows of ax, ay, bx, by) cross edges of b."""
    d1, d2 = a[:, 2:] - a[:, :2], b[:, 2:] - b[:, :2]
    out = []
    for lo in range(0, len(a), 256):
        p, r = a[lo : lo + 256, None, :2], d1[lo : lo + 256, None]
        across = r[..., 0] * d2[None, :, 1] - r[..., 1] * d2[None, :, 0]
        away = b[None, :, :2] - p
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (away[..., 0] * d2[None, :, 1] - away[..., 1] * d2[None, :, 0]) / across
            u = (away[..., 0] * r[..., 1] - away[..., 1] * r[..., 0]) / across
            heights = p[..., 1] + t * r[..., 1]
        out.append(heights[(across != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)])
    y = np.concatenate(out) if out else np.zeros(0)
    return y[(y > low) & (y < high)]


def trapezoids(a: np.ndarray, b: np.ndarray, bottom: float, top: float, shared: bool) -> Iterator[tuple[float, float, float, float, float, float]]:
    """y1, left and right there, y2, left and right there of what a polygon's edges (rows of ax, ay, bx, by) hold in a strip and another's do too (shared) or do not.

    Between the heights of ends and crossings no two edges cross, so that each stretch between neighbours is in or out of each polygon as a whole.
    """
    tall = a[:, 1::2]
    bottom, top = max(bottom, float(tall.min(initial=top))), min(top, float(tall.max(initial=bottom)))
    if not bottom < top:
        return
    edges = np.concatenate([a, b])
    of_a = np.arange(len(edges)) < len(a)
    ends = edges[:, [1, 3]].ravel()
    y = np.unique(np.concatenate([np.array([bottom, top]), ends[(ends > bottom) & (ends < top)], _crossings(edges, edges, bottom, top)]))
    low, high = np.minimum(edges[:, 1], edges[:, 3]), np.maximum(edges[:, 1], edges[:, 3])
    slope = (edges[:, 2] - edges[:, 0]) / np.where(low == high, 1.0, edges[:, 3] - edges[:, 1])
    sloped = low < high
    edges, of_a, low, high, slope = edges[sloped], of_a[sloped, None], low[sloped, None], high[sloped, None], slope[sloped, None]
    x_at = lambda h: edges[:, :1] + (h - edges[:, 1:2]) * slope
    step = max(1, CELLS // max(1, len(edges)))
    for at in range(0, len(y) - 1, step):
        # a column for each stretch, where edges that do not pass it come last
        y1, y2 = y[at : at + step][: len(y) - 1 - at], y[at + 1 : at + 1 + step]
        passes = (low <= y1) & (high >= y2)
        order = np.argsort(np.where(passes, x_at((y1 + y2) / 2), np.inf), axis=0, kind="stable")
        there = np.take_along_axis(passes, order, 0)
        mine = of_a[order, 0]
        in_a, in_b = np.cumsum(mine & there, axis=0) % 2 == 1, np.cumsum(~mine & there, axis=0) % 2 == 1
        left, right = np.take_along_axis(x_at(y1), order, 0), np.take_along_axis(x_at(y2), order, 0)
        held = (in_a & (in_b == shared))[:-1] & there[1:] & ((left[1:] > left[:-1]) | (right[1:] > right[:-1]))
        for k, n in np.argwhere(held.T).tolist():
            yield float(y1[k]), float(left[n, k]), float(left[n + 1, k]), float(y2[k]), float(right[n, k]), float(right[n + 1, k])


SHAPE = ["y1", "left1", "right1", "y2", "left2", "right2"]


def _strips(edges: DataFrame, name: str, size: float, first: bool) -> DataFrame:
    return edges.withColumn("j", F.explode(_rows_of(size))).withColumnRenamed("poly", name).withColumn("first", F.lit(first))


def _cut(edges: DataFrame, keys: list[str], size: float, shared: bool) -> DataFrame:
    """keys and SHAPE of what the first polygon of keys holds, with edges (keys, j, first, ax, ay, bx, by) of it and of others.

    Strips of keys follow one another in a task's batches, which hold many small ones; one that goes on is kept for the next batch.
    """

    def starts(t: pa.Table) -> list[int]:
        new = np.zeros(max(0, t.num_rows - 1), bool)
        for k in [*keys, "j"]:
            c = t.column(k).combine_chunks()
            unlike = pc.fill_null(pc.not_equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False)
            null = c.is_null().to_numpy(zero_copy_only=False)
            new |= unlike | (null[1:] != null[:-1])
        return [0, *(np.flatnonzero(new) + 1).tolist()]

    def shapes(t: pa.Table, at: list[int]) -> pa.RecordBatch:
        xy = np.stack([t.column(c).to_numpy() for c in ("ax", "ay", "bx", "by")], axis=1)
        first, j = t.column("first").to_numpy(), t.column("j").to_numpy()
        rows, of = [], []
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            mine, e = first[lo:hi], xy[lo:hi]
            if mine.any() and (not shared or not mine.all()):
                rows += trapezoids(e[mine], e[~mine], int(j[lo]) * size, (int(j[lo]) + 1) * size, shared)
                of += [lo] * (len(rows) - len(of))
        own = t.select(keys).take(pa.array(of, pa.int64())).combine_chunks()
        columns = list(zip(*rows, strict=True)) or [()] * len(SHAPE)
        return pa.RecordBatch.from_arrays([*(own.column(k).combine_chunks() for k in keys), *(pa.array(c, pa.float64()) for c in columns)], [*keys, *SHAPE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if t.num_rows:
                at = starts(t)
                yield shapes(t, at)
                held = t.slice(at[-1]).combine_chunks()
        if held is not None:
            yield shapes(held, [0, held.num_rows])

    schema = ", ".join([*(f"{k} {edges.schema[k].dataType.simpleString()}" for k in keys), *(f"{c} double" for c in SHAPE)])
    dealt = spread_by(edges.select(*keys, "j", "first", "ax", "ay", "bx", "by"), *keys, "j")
    return dealt.sortWithinPartitions(*keys, "j").mapInArrow(run, schema)


def _sent(df: DataFrame) -> DataFrame:
    """df for a join: to all tasks if it has few rows, by count. Otherwise both sides are sorted, since a plan takes exploded rows for as few bytes as the file has that they come from, and would send them through the driver."""
    sent = broadcast_if_few(df)
    return df.hint("merge") if sent is df else sent


def meeting(ea: DataFrame, eb: DataFrame, size: float) -> DataFrame:
    """a, b, j: strips in which the boxes of polygons of two layers of edges meet."""

    def boxes(e: DataFrame, name: str) -> DataFrame:
        b = _strips(e, name, size, True).groupBy(name, "j").agg(F.min(F.least("ax", "bx")).alias(f"{name}1"), F.max(F.greatest("ax", "bx")).alias(f"{name}2"))
        return b.withColumn("i", F.explode(F.sequence(F.floor(F.col(f"{name}1") / size), F.floor(F.col(f"{name}2") / size))))

    return boxes(ea, "a").join(_sent(boxes(eb, "b")), ["i", "j"]).where("a1 <= b2 AND b1 <= a2").select("a", "b", "j").distinct()


def intersection(left: DataFrame, right: DataFrame, size: float) -> DataFrame:
    """a, b and trapezoids (SHAPE) of what polygons (poly, ring) of two layers have in common.

    Polygons may have any rings: holes, notches, points and edges in common. Pairs meet by the cells of their boxes in strips of
    height size, and each strip of a pair is worked out alone, so its edges are what a task holds. Touching is no area.
    """
    ea, eb = ring_edges(left), ring_edges(right)
    met = meeting(ea, eb, size)
    a, b = (_sent(_strips(e, name, size, name == "a")).join(met, [name, "j"]) for name, e in (("a", ea), ("b", eb)))
    return _cut(a.unionByName(b), ["a", "b"], size, True)


def difference(left: DataFrame, right: DataFrame, size: float) -> DataFrame:
    """a and trapezoids (SHAPE) of what a polygon of left holds and none of right, whose polygons do not overlap one another."""
    ea, eb = ring_edges(left), ring_edges(right)
    others = _sent(_strips(eb, "b", size, False)).join(meeting(ea, eb, size), ["b", "j"]).drop("b")
    return _cut(_strips(ea, "a", size, True).unionByName(others), ["a"], size, False)


def trapezoid_area() -> Column:
    return (F.col("y2") - F.col("y1")) * ((F.col("right1") - F.col("left1")) + (F.col("right2") - F.col("left2"))) / 2


def polygon_areas(polygons: DataFrame, size: float) -> DataFrame:
    """poly and area of polygons (poly, ring): of what an odd number of rings holds."""
    cut = _cut(_strips(ring_edges(polygons), "poly", size, True), ["poly"], size, False)
    return cut.groupBy("poly").agg(F.sum(trapezoid_area()).alias("area"))
