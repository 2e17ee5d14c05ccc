"""The query of spaced places over every cell, against plain Python."""

from __future__ import annotations

import math
import statistics

from hillspan.plans.networks import q52_spaced_selection


def brute(cells):
    out = set()
    for city in {c["city"] for c in cells}:
        mine = [c for c in cells if c["city"] == city]
        m = statistics.median(c["flat"] for c in mine)
        for t in (0.05, 0.1, 0.15, 0.2, 0.3, None):
            close = [c for c in mine if t is None or m * (1 - t) <= c["flat"] <= m * (1 + t)]
            if t is None or len(close) >= 20:
                break
        for factor in (1.0, 0.75, 0.5, 0.25, 0.0):
            chosen = []
            for kind, most, sign in (("favourable", 3, 1), ("unfavourable", 5, -1)):
                for c in sorted(close, key=lambda c: (sign * c["climb"], c["cell"])):
                    if len(chosen) < most and all(factor == 0 or math.hypot(c["x"] - o["x"], c["y"] - o["y"]) >= 300 * factor for o, _ in chosen):
                        chosen.append((c, kind))
            if len(chosen) == 5:
                chosen.sort(key=lambda x: (x[0]["climb"], x[0]["cell"]))
                out |= {(city, c["cell"], kind, i + 1, 300.0 * factor) for i, (c, kind) in enumerate(chosen)}
                break
    return out


def test_all_cells_can_be_chosen(spark, tmp_path):
    rows = [(k, k % 50 + 1, "ABC"[k * 7 % 11 % 3]) for k in range(300)]
    spark.createDataFrame(rows, "p_partkey long, p_size int, p_type string").write.parquet(str(tmp_path / "part.parquet"))
    cells = [{"cell": k, "x": k * 37 % 1013, "y": k * 53 % 887, "climb": k * 31 % 607, "flat": 1000 + k * 17 % 401, "city": city} for k, _, city in rows]
    got = q52_spaced_selection(spark, str(tmp_path))
    assert {(x.city, x.cell, x.kind, x["rank"], x.distance_used) for x in got.collect()} == brute(cells)
