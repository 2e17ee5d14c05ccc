"""Walks between stops, both ways, beside the rides."""

from __future__ import annotations

from hillspan.operators import studies as T


def test_walks_both_ways_without_an_array_for_each_pair(spark):
    arcs = spark.createDataFrame([(1, 2, 50.0)], "u long, v long, length double")
    pairs = spark.createDataFrame([(1, 2, 9), (2, 5, 16), (3, 4, 0)], "a long, b long, d2 long")
    out = T.with_transfers(arcs, pairs)
    walks = [(a, b, d, 3 * d, False) for a, b, d in ((1, 2, 3.0), (2, 1, 3.0), (2, 5, 4.0), (5, 2, 4.0), (3, 4, 0.0), (4, 3, 0.0))]
    assert sorted(map(tuple, out.collect())) == sorted([(1, 2, 50.0, 50.0, True), *walks])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(array(true, false))" not in plan and "explode([true,false])" in plan  # a constant
