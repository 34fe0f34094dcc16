"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from callscope.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{name}')")
    return con


def shown(v):
    """A value as text, null and numbers alike whatever column type holds them."""
    if v is None or v is pd.NA or v != v:
        return "null"
    return str(round(float(v), 6)) if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v)


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(map(shown, r)) for r in df[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, tables, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    assert rows(got) == rows(tables.execute(registry.ORACLES[name]).df())


def test_all_queries_have_a_name_and_callable():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
