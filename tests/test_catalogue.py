"""Every registered query with SQL agrees with DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from vecprep.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p if p.is_file() else f'{p}/*.parquet'}')")
    return c


def key(row):
    return tuple("" if v is None or isinstance(v, float) and math.isnan(v) else repr(v) for v in row)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    ours = sorted((tuple(r) for r in df.select(*columns).collect()), key=key)
    sql = catalogue.oracle_sql()[name]
    theirs = sorted(duck.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({sql})").fetchall(), key=key)
    assert ours == theirs


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["query_id", "rank", "base_id"] and df.count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
