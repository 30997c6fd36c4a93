"""Queries with SQL give the same rows in both engines, on the tables and on rows at the edges of the contracts."""

import os

import pytest
from pyspark.sql import SparkSession
from tidemark.llm import queries

DATA = os.environ.get("TIDEMARK_TEST_TABLES", "/root/testdata/sf0.001")
SQL, ALL = queries.oracle_sql(), queries.queries()

LONG = " ".join(f"w{i}" for i in range(120))
DOCUMENTS = [
    (1, LONG, "a"), (2, f"own start {LONG} own end", "a"), (3, None, None), (4, "", "b"), (5, " \t\r\n\v\f ", "b"), (6, "One", "a"), (7, "oNE", "c"),
    (8, "É é x   y", "a"), (9, "é É X   Y", "a"), (10, LONG.upper(), "d"), (11, f"{LONG} {LONG}", "a"), (12, "x " * 300, "b"),
    (13, " ".join(LONG.split()[:49]), "b"), (14, " ".join(LONG.split()[:50]), "b"), (15, "a b", "c"), (16, "a  b", "c"), (17, LONG, "c"),
]
PAGES = [(5, "u", "<p>é</p>"), (3, "v", "<p>é</p>"), (9, None, None), (1, "w", ""), (2, "x", "y"), (8, "u", "<p>é</p>"), (4, "z", "long " * 50_000)]


ITEMS = [(1, "x"), (2, "one x y É"), (3, None), (4, ""), (5, "w1 w2 w3 W1"), (5, "w7"), (6, "nothing-like-it")]
VECTORS = [(i, [((i * 37 + k * 11) % 101) / 50 - 1 for k in range(32)], i % 3 if i % 5 else None) for i in range(90)]
VECTORS += [(91, None, 1), (92, [None] * 32, 1), (93, [float("nan")] * 32, 2), (94, [float("-inf")] * 32, 2), (95, [], 0), (-1, [0.5] * 32, 1), (7, [0.25] * 32, 1), (None, [0.125] * 32, None)]


@pytest.fixture(scope="module")
def edges(spark: SparkSession, tmp_path_factory) -> str:
    at = str(tmp_path_factory.mktemp("edges"))
    spark.createDataFrame(DOCUMENTS, "doc_id long, text string, source string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    return at


def same(spark: SparkSession, name: str, data: str) -> None:
    import duckdb

    con = duckdb.connect()
    for file in os.listdir(data):
        path = f"{data}/{file}/*.parquet" if os.path.isdir(f"{data}/{file}") else f"{data}/{file}"
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    found = ALL[name](spark, data)
    columns = sorted(found.columns)
    ask = ", ".join(f'"{c}"' for c in columns)
    wanted = con.execute(f"SELECT {ask} FROM ({SQL[name]})").fetchall()
    normal = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert normal(map(tuple, found.select(*columns).collect())) == normal(wanted)


@pytest.mark.parametrize("name", sorted(SQL))
def test_edges(spark, edges, name):
    same(spark, name, edges)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_tables(spark, name):
    same(spark, name, DATA)
