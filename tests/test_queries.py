import duckdb
import pytest

import __spark_entry__ as entry
from checks.run_queries import TABLES, compare
from ebbtide.plans.catalog import QUERIES


@pytest.fixture(scope="module")
def tables(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, folder, tables, name):
    df = entry.queries()[name](spark, folder)
    rows = [tuple(r) for r in df.collect()]
    cursor = tables.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert compare((df.columns, rows), (names, cursor.fetchall())) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
