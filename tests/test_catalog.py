"""Queries with SQL against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from tasklore import catalog

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(D).exists(), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    return con


def plain(df):
    df = df[sorted(df.columns)]
    show = lambda v: "" if pd.isna(v) else f"{float(v):.6f}" if isinstance(v, (bool, int, float, np.number, np.bool_)) else str(v)
    return sorted(tuple(show(v) for v in row) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, D).toPandas()
    want = duck.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry_imports():
    import __spark_entry__

    assert catalog.FLAGSHIP in __spark_entry__.queries()
