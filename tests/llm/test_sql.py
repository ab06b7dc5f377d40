"""The opN queries that SQL can express give their twins' rows."""

import os

import duckdb
import numpy as np
import pytest

from heatwise.llm.oracle import SQL
from heatwise.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
    return con


def plain(v):
    if v is None or v is np.nan:
        return None
    return f"{v:.12g}" if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    twin = duck.sql(SQL[name])
    assert sorted(twin.columns) == sorted(df.columns)
    at = [twin.columns.index(c) for c in df.columns]
    want = sorted(tuple(plain(r[i]) for i in at) for r in twin.fetchall())
    rows = sorted(tuple(plain(v) for v in r) for r in df.collect())
    assert len(rows) == len(want) > 0
    wrong = [(a, b) for a, b in zip(rows, want, strict=True) if a != b]
    assert not wrong, (len(wrong), wrong[:2])
