"""Every query with SQL against DuckDB, on the smallest tables."""

import duckdb
import numpy as np
import pytest

from helpers import SMALL
from stridefold.plans.catalogue import QUERIES, flagship
from stridefold.plans.catalogue_sql import SQL

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def ordered(df):
    df = df[sorted(df.columns)].copy()
    return df.sort_values(list(df.columns), key=lambda x: x.astype(str)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    a, b = ordered(QUERIES[name](spark, SMALL).toPandas()), ordered(duck.execute(SQL[name]).df())
    assert list(a.columns) == list(b.columns) and len(a) == len(b) and len(a)
    for c in a.columns:
        if a[c].dtype.kind == "f":
            np.testing.assert_allclose(a[c].to_numpy(float), b[c].to_numpy(float), rtol=1e-6, atol=1e-8, err_msg=c)
        else:
            assert a[c].astype(str).tolist() == b[c].astype(str).tolist(), c


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_flagship(spark):
    assert flagship(spark, SMALL).count() == 6
