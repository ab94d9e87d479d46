"""Every ledger query against its DuckDB SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tallywren.plans import catalog

TABLES = [f[:-8] for f in os.listdir("/root/testdata/sf0.001") if f.endswith(".parquet")]


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def as_rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple("NULL" if pd.isna(v) else repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in df[cols].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, sf, name):
    assert as_rows(catalog.QUERIES[name](spark, sf).toPandas()) == as_rows(duck.sql(catalog.ORACLE_SQL[name]).df())


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0 and set(catalog.QUERIES) <= set(__spark_entry__.queries())
