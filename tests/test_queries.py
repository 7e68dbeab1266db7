"""Every registered query of the library against DuckDB on the smallest sample tables."""

import os

import duckdb
import pandas as pd
import pytest

from tidemark.plans.queries import ORACLE, QUERIES


def normal(df: pd.DataFrame) -> list[tuple]:
    plain = lambda x: None if x is None or x is pd.NA or x != x else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) if not isinstance(x, (bool,)) else x
    rows = [tuple(plain(x.item() if hasattr(x, "item") else x) for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)]
    return sorted(rows, key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(sf_dir):
        c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{sf_dir}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert len(got) or name in ()
    if name in ORACLE:
        want = duck.execute(ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert normal(got) == normal(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
