"""Every query with an SQL twin gives the twin's rows."""

import os

import duckdb
import numpy as np
import pytest

from heatwise import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
    return con


def plain(v):
    if v is None or isinstance(v, bool | np.bool_):
        return None if v is None else bool(v)
    if isinstance(v, float | np.floating):
        return None if v != v else float(f"{v:.12g}") + 0.0
    if isinstance(v, int | np.integer):
        return int(v)
    if isinstance(v, list | tuple | np.ndarray):
        return tuple(plain(x) for x in v)
    return str(v)


def order(row):
    return [(x is None, str(type(x)), str(x) if isinstance(x, tuple) or x is None else x) for x in row]


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_rows(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=order)
    twin = duck.sql(plans.SQL[name])
    assert sorted(twin.columns) == columns
    at = [twin.columns.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in twin.fetchall()), key=order)
    assert len(rows) == len(want)
    assert rows == want
