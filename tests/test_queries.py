"""Every registered query of the engine against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from marlstone.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows(found):
    same = lambda v: v if not isinstance(v, float) else int(v) if v.is_integer() else round(v, 6)
    return sorted((tuple(same(float(v)) if type(v).__name__ == "Decimal" else same(v) for v in r) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    found = registry.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    if name in registry.ORACLE_SQL:
        expected = con.sql(registry.ORACLE_SQL[name])
        assert columns == sorted(expected.columns)
        assert rows(found.select(columns).collect()) == rows(expected.select(*columns).fetchall())
    else:
        assert found.count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
