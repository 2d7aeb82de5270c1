"""The training-data queries against their SQL on the smallest tables; those without SQL must run and have unique rows."""

import os

import duckdb
import pytest

from sokhan.llm.queries import QUERIES, SQL
from tests.test_queries import D, _cell


#: Shares can't come within two points where a source has a handful of documents; the next larger tables are for that.
LARGER = {"p9_sound": D.replace("0.001", "0.01")}


def views(d):
    con = duckdb.connect()
    for f in os.listdir(d):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{d}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    d = LARGER.get(name, D)
    df = QUERIES[name](spark, d)
    columns = sorted(df.columns)
    got = sorted(tuple(map(_cell, r)) for r in df.select(*columns).collect())
    assert len(got) == len(set(got))
    if name not in SQL:
        assert got
        return
    rel = views(d).execute(SQL[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted(tuple(_cell(r[i]) for i in order) for r in rel.fetchall())
