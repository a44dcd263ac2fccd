"""Every registered library query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from paperloom.plans import QUERIES, SQL

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def comparable(df):
    def cell(v):
        if isinstance(v, (list, tuple)):
            return str(list(v))
        if v is None or pd.isna(v):
            return "null"
        return str(pd.Timestamp(v)) if hasattr(v, "year") else repr(float(v)) if isinstance(v, float) else str(v)

    df = df[sorted(df.columns)].map(cell)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    got, want = comparable(QUERIES[name](spark, SF).toPandas()), comparable(duck.execute(SQL[name]).df())
    pd.testing.assert_frame_equal(got, want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["semantic_search"](spark, SF).count() <= 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
