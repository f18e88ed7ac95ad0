"""Every registered query that has SQL against DuckDB on the smallest driver tables."""

import glob
import numbers
import os

import duckdb
import pandas as pd
import pytest

from statefield.plans import catalog

SF = "/root/testdata/sf0.001"


def shown(v):
    if pd.isna(v):
        return "-"
    return f"{float(v):.5f}" if isinstance(v, numbers.Number) and not isinstance(v, bool) else str(v)


def rows(df):
    return sorted(tuple(map(shown, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    want = con.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_module_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
