import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
from docweft.plans import registry

SF = "/root/testdata/sf0.001"
OWN = sorted(registry.QUERIES)


def cell(v):
    if v is None or v != v:
        return "NULL"
    if isinstance(v, float):
        return str(int(v)) if v == int(v) else repr(round(v, 6))
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in values)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", OWN)
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = df.collect()
    if name in registry.ORACLES:
        found = duck.execute(registry.ORACLES[name])
        names = [c[0] for c in found.description]
        assert sorted(names) == sorted(df.columns)
        assert rows(df.columns, got) == rows(names, found.fetchall())


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0
