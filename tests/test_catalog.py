"""Every query runs, and gives DuckDB's rows where SQL expresses it, over the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from cairn.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents pages benchmark conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
        return None
    return float(v) if isinstance(v, int | float | np.integer | np.floating) and not isinstance(v, bool) else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted((tuple(map(plain, r)) for r in df.itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLES:
        assert len(got)
    else:
        assert rows(got) == rows(duck.execute(ORACLES[name]).df())
