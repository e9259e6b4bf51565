"""Registered queries against their SQL on the small tables."""

import datetime
import glob
import os

import pytest

from visitprep.plans import registry

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{TABLES}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, datetime.datetime | datetime.date):
        return str(value)
    return round(value, 9) if isinstance(value, float) else value


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(([plain(v[i]) for i in order] for v in values), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    df = registry.queries()[name](spark, TABLES)
    cursor = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, cursor.fetchall())


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_no_python_in_any_plan(spark, name):
    plan = registry.queries()[name](spark, TABLES)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct"))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.queries()) <= set(__spark_entry__.queries())


def test_inpatient_pull_is_whole(spark):
    want = spark.read.parquet(f"{TABLES}/lineitem.parquet").filter("l_returnflag in ('R', 'A')").count()
    assert registry._pulls(spark, TABLES)[1].count() == want
