"""Every base query against its DuckDB text."""

import os

import duckdb
import pandas as pd
import pytest

from trackloom.plans import oracle, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def plain(v):
    """A value without its column's type: a NULL in an integer column turns its numbers to floats in one frame only."""
    if pd.isna(v):
        return None
    if pd.api.types.is_bool(v):
        return bool(v)
    return float(v) if pd.api.types.is_number(v) else v


def rows(df: pd.DataFrame) -> list:
    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_duckdb(spark, duck, name):
    got, want = queries.queries()[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(SQL) - {"gbt_oof", "build_dataset"}))
def test_other_queries_run(spark, name):
    assert queries.queries()[name](spark, SF).count() >= 0
