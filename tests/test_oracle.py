"""Every core query against its SQL twin, and two runs against each other."""

import math
import os

import duckdb
import pytest
from mnemospark.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
Q, SQL = registry.queries(), registry.oracle_sql()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    return f"{v:.6f}" if isinstance(v, float) else str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in sorted(os.listdir(DATA)):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    df = Q[name](spark, DATA)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(SQL[name])
    assert got == rows([c[0] for c in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(Q) - set(SQL)))
def test_runs(spark, name):
    df = Q[name](spark, DATA)
    assert df.columns and df.count() >= 0
