import os

import pytest

import __spark_entry__ as entry
from maskwright.plans import oracles
from maskwright.plans import queries as plans

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(oracles.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    ours = plans.QUERIES[name](spark, DATA).toPandas()
    theirs = connection.execute(oracles.ORACLE_SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    a, b = ([tuple(map(str, r)) for r in x[columns].itertuples(index=False)] for x in (ours, theirs))
    assert sorted(a) == sorted(b)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_entry_runs(spark):
    assert entry.entry(spark).count() == 200
    assert set(plans.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
