"""Every registered query against its SQL check on the smallest tables."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check import TABLES, canonical

BASE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{BASE}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    df = queries()[name](spark, BASE)
    columns, rows = canonical(df.columns, df.collect())
    sql = oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    got = con.execute(sql)
    assert (columns, rows) == canonical([d[0] for d in got.description], got.fetchall())


def test_entry(spark):
    assert entry(spark).count() > 0


def test_keys_match():
    assert set(oracle_sql()) <= set(queries())
