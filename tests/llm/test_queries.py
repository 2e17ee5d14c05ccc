"""The registered queries that have SQL against it, values bit for bit."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from hillspan.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want, got = con.sql(ORACLES[name]), QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    rows = sorted(repr(tuple(r)) for r in got.select(*columns).collect())
    assert rows and rows == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())


def test_there_is_a_query_for_each_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
