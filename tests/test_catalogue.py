"""Every catalogue query against its SQL in DuckDB, values bit for bit."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb
import pytest

from hillspan.plans.catalogue import ORACLES, QUERIES

SF = os.environ.get("CATALOGUE_SF", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x + 0.0)
    return str(x)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(tuple(plain(x) for x in r) for r in got.select(*columns).collect())
    if name not in ORACLES:
        assert rows
        return
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    expected = sorted(tuple(plain(r[i]) for i in order) for r in want.fetchall())
    assert len(rows) == len(expected)
    wrong = [(a, b) for a, b in zip(rows, expected, strict=True) if a != b]
    assert not wrong, wrong[:3]
    assert rows
