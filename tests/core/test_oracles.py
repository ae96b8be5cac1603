"""Every registered query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from punchlist import registry

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(plain(x) for x in r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    if name not in registry.oracle_sql():
        assert got
        return
    result = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_flagship(spark):
    assert registry.flagship(spark, SF).count() > 0
