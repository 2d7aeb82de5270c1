"""Every query against its SQL on the smallest tables; those without SQL must run."""

import math
import os

import duckdb
import pytest

from sokhan import catalogue

D = "/root/testdata/sf0.001"


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(D):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{D}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    df = catalogue.QUERIES[name](spark, D)
    columns = sorted(df.columns)
    got = sorted(tuple(map(_cell, r)) for r in df.select(*columns).collect())
    if name not in catalogue.SQL:
        return
    rel = db.execute(catalogue.SQL[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted(tuple(_cell(r[i]) for i in order) for r in rel.fetchall())


def test_every_sql_has_a_query():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES)
