"""Every registered query of the library against its SQL twin on the smallest tables."""

import os

import duckdb
import pytest

from tessera.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return c


def rows(found, names):
    order = [names.index(n) for n in sorted(names)]
    clean = lambda v: round(float(v), 6) if isinstance(v, float) or hasattr(v, "quantize") else v
    return sorted((tuple(clean(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, con, name):
    df, want = registry.QUERIES[name](spark, SF), con.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(want.fetchall(), want.columns)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
