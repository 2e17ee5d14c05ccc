"""Operator 5 against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hillspan.llm import nearest as module
from hillspan.llm.nearest import nearest, quantised


def brute(rows, every, k):
    sound = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            sound[i] = min(sound.get(i, v), v)
    out = []
    for i, v in sound.items():
        if i % every == 0:
            d = sorted((float(np.sqrt(np.add.accumulate((np.array(v, float) - np.array(w, float)) ** 2)[-1])), j) for j, w in sound.items() if j != i and len(w) == len(v))
            out += [(i, n + 1, j, x) for n, (x, j) in enumerate(d[:k])]
    return sorted(out)


def same(got, want):
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert np.allclose([x[3] for x in got], [x[3] for x in want], rtol=1e-14, atol=0)


@pytest.mark.parametrize("block", [500, 1 << 20])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(module, "BLOCK", block)
    monkeypatch.setattr(module, "SMALL", block // 50)
    monkeypatch.setattr(module, "QUERIES", block)
    monkeypatch.setattr(module, "MERGED", block)
    r = np.random.default_rng(3)
    v = r.normal(size=(300, 8)).astype(np.float32)
    v[50:90] = v[50]
    v[90:100] = v[50] + np.float32(1e-6)
    rows = [(i, [float(x) for x in y]) for i, y in enumerate(v)]
    rows += [(500, None), (501, []), (502, [0.0] * 8), (503, [1.0] * 7 + [None]), (504, [float("nan")] * 8), (505, [float("inf")] * 8), (None, [1.0] * 8), (20, [float(x) for x in v[5]]), (60, rows[60][1]), (510, [1.0, 2.0]), (520, [1.5, 2.0])]
    df = spark.createDataFrame([(*x, 0, 1, 2) for x in rows], "vec_id long, embedding array<float>, rank int, block int, width int").repartition(4)
    as_float = [(i, None if w is None else [None if x is None else float(np.float32(x)) for x in w]) for i, w in rows]
    same(sorted(tuple(x) for x in nearest(df, every=10).collect()), brute(as_float, 10, 10))


def test_few_or_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(x)[:3] for x in nearest(df).collect()] == [(0, 1, 1)]
    assert nearest(df.limit(0)).collect() == []


@given(st.lists(st.lists(st.floats(-1e6, 1e6), min_size=5, max_size=5), min_size=2, max_size=2))
@settings(max_examples=300, deadline=None)
def test_quantisation_bounds_hold(pair):
    x = np.array(pair)
    if (np.abs(x).max(axis=1) < 1e-300).any():
        return
    q, s, e = quantised(x)
    y = q * s[:, None]
    assert abs(np.linalg.norm(x[0] - x[1]) - np.linalg.norm(y[0] - y[1])) <= (e[0] + e[1]) * (1 + 1e-9) + 1e-9
