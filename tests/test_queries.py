"""Every query of the core with SQL against DuckDB on the smallest tables, and the driver's entry."""

import math
import os

import pytest

import __spark_entry__ as entry_module
from quire.plans import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.8g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(canon, v))
    return v if v is None or isinstance(v, (bool, int, str)) else str(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def compare(spark, duck, fn, sql):
    df = fn(spark, FOLDER)
    columns = sorted(df.columns)
    ours = sorted((tuple(canon(r[c]) for c in columns) for r in df.collect()), key=repr)
    got = duck.execute(sql)
    names = [d[0] for d in got.description]
    theirs = sorted((tuple(canon(r[names.index(c)]) for c in columns) for r in got.fetchall()), key=repr)
    assert columns == sorted(names) and ours == theirs


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    compare(spark, duck, registry.queries()[name], registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
