"""Every registered query with SQL, run by both engines over the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from reelquarry import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _rows(df):
    def value(x):
        if x is None or x is pd.NA or x != x:
            return None
        return round(float(x), 6) + 0.0 if isinstance(x, float) else x

    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(value(x) for x in r) for r in df.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    want = duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = _rows(got), _rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(u == v or abs(u - v) <= 2e-6 * max(1, abs(u)) for u, v in zip(x, y, strict=True) if not (u is None and v is None)), (x, y)
