"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from corvane.plans import registry

NAMES = sorted(registry.ORACLE_SQL)


def norm(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 9) + 0.0)
    if isinstance(v, decimal.Decimal):
        return str(v.normalize())
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for name in os.listdir(data):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{data}/{name}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, data, duck, name):
    df = registry.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(tuple(map(norm, r)) for r in df.select(*cols).collect())
    cur = duck.execute(registry.ORACLE_SQL[name])
    found = [c[0] for c in cur.description]
    assert sorted(found) == cols
    order = [found.index(c) for c in cols]
    assert got == sorted(tuple(norm(r[i]) for i in order) for r in cur.fetchall())


def test_the_flagship_query(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0 and set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark, data):
    plan = registry.QUERIES["canonical_page"](spark, data)._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "FileScan parquet" in x)
    assert "value" not in scan.split("ReadSchema")[1]
    plan = registry.QUERIES["vector_topk_nonunit"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
