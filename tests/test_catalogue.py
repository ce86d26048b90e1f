"""Every query with SQL gives the rows of that SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from earmark.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def tidy(df, cols):
    df = df[cols].copy()
    for x in cols:
        if df[x].dtype == object:
            df[x] = df[x].astype(str).replace({"<NA>": "None", "nan": "None", "NaT": "None"})
    return df.sort_values(cols).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_rows_equal_sql(spark, sf, duck, name):
    got, want = catalogue.QUERIES[name](spark, sf).toPandas(), duck.sql(catalogue.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(want.columns)
    for x in cols:
        if (got[x].dtype == object) != (want[x].dtype == object):
            got[x], want[x] = got[x].astype(object), want[x].astype(object)
    pd.testing.assert_frame_equal(tidy(got, cols), tidy(want, cols), check_dtype=False, rtol=0, atol=1e-9)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_runs(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0
