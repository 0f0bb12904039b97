"""The registered queries that have SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from attesta.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels", "conversations"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    cursor = duck.execute(queries.ORACLES[name])
    names = sorted(d[0] for d in cursor.description)
    at = [[d[0] for d in cursor.description].index(n) for n in names]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == names
    assert sorted(str(tuple(r)) for r in df.select(*names).collect()) == sorted(str(tuple(r[i] for i in at)) for r in cursor.fetchall())
