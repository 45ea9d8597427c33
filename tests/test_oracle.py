"""Every query with SQL gives the rows that DuckDB gives."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tests.conftest import SF
from tidemark.plans import catalog

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


def rows(df):
    cols = sorted(df.columns)

    def cell(v):
        if v is None or v is pd.NA or v != v:
            return "~"
        # whole numbers beside nulls come as floats from one engine and as whole numbers from the other
        whole = isinstance(v, int | np.integer) and not isinstance(v, bool)
        return f"{float(v):.5f}" if isinstance(v, float | np.floating) or whole and abs(int(v)) < 1 << 53 else str(v)

    return sorted(tuple(cell(v) for v in r) for r in df[cols].astype(object).itertuples(index=False)), cols


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    assert rows(catalog.queries()[name](spark, SF).toPandas()) == rows(con.sql(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_query_gives_rows(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0
