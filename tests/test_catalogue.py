"""Every query of the catalogue against its SQL in DuckDB, on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from lakeloom.plans.catalogue import CATALOGUE
from lakeloom.sources.tables import NAMES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in NAMES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    return str(v)


@pytest.mark.parametrize("name", sorted(CATALOGUE))
def test_query(spark, duck, name):
    run, sql = CATALOGUE[name]
    df = run(spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got
    if sql:
        rel = duck.sql(sql)
        assert sorted(rel.columns) == columns
        at = [rel.columns.index(c) for c in columns]
        assert got == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
