"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from evidar import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def rows(df):
    cols = sorted(df.columns)
    cell = lambda v: None if pd.isna(v) else round(float(v), 5) if isinstance(v, float) else str(v)
    return sorted((tuple(cell(v) for v in r) for r in df[cols].itertuples(index=False)), key=str), cols


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, db, name):
    got = plans.QUERIES[name](spark, DIR).toPandas()
    if name in plans.SQL:
        assert rows(got) == rows(db.sql(plans.SQL[name]).df())
    else:
        assert len(got)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(plans.QUERIES) <= set(e.queries()) and set(plans.SQL) <= set(e.oracle_sql())
    assert e.entry(spark).count() > 0
