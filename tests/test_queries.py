"""Each registered query with SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from dissona.plans import detector_queries, queries, round_trips  # noqa: F401

DATA = "/root/testdata"
SF = f"{DATA}/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(df):
    clean = lambda v: None if v is None or v is pd.NA or v != v else round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(map(clean, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    if name in queries.SQL:
        assert plain(got) == plain(duck.sql(queries.SQL[name]).df())
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
