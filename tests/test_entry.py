"""The driver's contract: names, columns, and the SQL of the core queries at the smallest scale."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from sightline.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def canon(v):
    if v is None:
        return "N"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return "[" + ",".join(map(canon, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    df = entry.queries()[name](spark, DATA)
    result = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted("|".join(canon(r[c]) for c in sorted(names)) for r in df.collect())
    want = sorted("|".join(canon(r[names.index(c)]) for c in sorted(names)) for r in result.fetchall())
    assert got == want
