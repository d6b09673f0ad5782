"""Every registered query of the library against its SQL twin in DuckDB."""

import datetime as dt
import glob
import os

import duckdb
import pytest

from archivolt.plans.catalogue import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, dt.datetime) and v.time() == dt.time():
        return str(v.date())
    if isinstance(v, dt.date):
        return str(v)
    return round(v, 6) if isinstance(v, float) else int(v) if isinstance(v, int) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str)
    if name not in ORACLES:
        assert rows
        return
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = [dict(zip(names, r)) for r in result.fetchall()]
    assert rows == sorted((tuple(plain(r[c]) for c in columns) for r in want), key=str)
