"""Every query with SQL against DuckDB on the smallest tables; contract of the entry module."""

import glob
import os

import pytest

from pactum.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple("" if v is None or v != v else str(v) for v in r) for r in df[cols].values.tolist())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(ORACLE_SQL[name]).df())


def test_ranked_keywords(spark):
    from pactum.functions.scalar import ratio

    got = QUERIES["keyword_ranked"](spark, SF).collect()
    assert got and [r.score for r in got] == sorted((r.score for r in got), reverse=True)
    assert all(r.score == ratio(r.title.lower(), "brand#2") for r in got)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["kind", "key", "statement_1", "statement_2", "reason"]
    assert set(e.oracle_sql()) <= set(e.queries())
