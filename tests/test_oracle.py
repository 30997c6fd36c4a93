"""Every query with SQL gives the same rows in both engines; the others give rows."""

import os

import pytest
from tidemark import oracle, queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
SQL, ALL = oracle.oracle_sql(), queries.queries()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    return con


def normal(rows):
    value = lambda v: round(float(v), 9) if isinstance(v, (float, int)) and not isinstance(v, bool) else v
    return sorted((tuple(map(value, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    got = ALL[name](spark, DATA)
    columns = sorted(got.columns)
    ask = ", ".join(f'"{c}"' for c in columns)
    expected = duck.execute(f"SELECT {ask} FROM ({SQL[name]})").fetchall()
    assert normal(map(tuple, got.select(*columns).collect())) == normal(expected)


def test_names_match():
    assert set(SQL) <= set(ALL)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert {"review_summary", "task_check"} <= set(entry.queries())
