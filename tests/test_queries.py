from __future__ import annotations

import os

import duckdb
import pytest

from tidelog.plans.queries import QUERIES
from tidelog.plans.sql import SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


def plain(v) -> str:
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", list(QUERIES))
def test_against_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = sorted(tuple(map(plain, r)) for r in got.select(*columns).collect())
    assert rows == sorted(tuple(map(plain, r)) for r in want.fetchall())
