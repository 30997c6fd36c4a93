import random

import pytest

LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(30_000))
EXTRA = ("id", "key", "n", "rn", "range", "rid", "label", "size", "host", "keys", "gone", "h", "s", "w", "words", "kept")


@pytest.fixture(scope="session")
def edge_rows():
    """(doc_id, text): nulls, blanks, a very long text, repeated rows and repeated ids."""
    rng = random.Random(11)
    base = [f"v{rng.randrange(400)}" for _ in range(90)]
    rows = [(1, None), (2, ""), (3, " \t\n\r\x0b\x0c "), (4, "a"), (5, "A"), (6, "one two"), (7, LONG), (8, LONG), (9, " ".join(base)), (10, " ".join(base[:60] + ["x"] * 70)), (11, "spam " * 120), (12, "spam " * 119), (13, "a b " * 70), (14, "b a " * 70)]
    return rows + [(15, "same row here"), (15, "same row here"), (16, "été  ퟿ \U0001f600 \x00 end"), (None, " ".join(base)), (17, " ".join(base[20:] + ["tail"] * 5))]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    """The rows with null and clashing extra columns."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(edge_rows, "doc_id long, text string").repartition(3)
    docs = docs.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.concat(F.lit("s"), F.col("doc_id") % 3))).withColumn("n_chars", F.length("text").cast("long"))
    for name in EXTRA:
        docs = docs.withColumn(name, F.lit("clash"))
    return docs


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where("false")
