"""Every registered query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from attesta.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def plain(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted([tuple(str(r[i]) for i in order) for r in rows])


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cursor = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert plain(df.collect(), df.columns) == plain(cursor.fetchall(), names)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_current_value_plan_is_one_scan_and_one_shuffle(spark):
    plan = catalog.QUERIES["current_value"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("FileScan") == 1 and "props" not in plan
