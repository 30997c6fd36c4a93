"""The pipeline's stages on the smallest tables, each against its own definition; the queries' SQL."""

import collections
import os
import random

import pytest

DATA = "/root/testdata/sf0.001"
no_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def edge_dir(spark, edge_rows, tmp_path_factory):
    """A folder of tables with nulls, ties, repeated rows, a very long text and clashing columns."""
    from pyspark.sql import functions as F

    base = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(41)
    plain = [(100 + i, " ".join(f"n{rng.randrange(200)}" for _ in range(60))) for i in range(120)]
    bad = [(300 + i, " ".join(rng.choice(["vile", "nasty", f"n{rng.randrange(200)}"]) for _ in range(60))) for i in range(60)]
    docs = spark.createDataFrame([*edge_rows, *plain, *bad], "doc_id long, text string")
    docs = docs.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.when(F.col("doc_id") % 3 == 0, None).otherwise("s")).withColumn("n_chars", F.length("text").cast("long"))
    for name in ("gone", "id", "key", "kept", "c1", "mean", "place", "words"):
        docs = docs.withColumn(name, F.lit("clash"))
    docs.write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 300)) for i, _ in [*plain, *bad]] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, plain[5][1]), (2, None), (2, ""), (None, "x y z")], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base


def test_stages_of_edge_tables(spark, edge_dir):
    """Each stage on the same rows: nulls, repeated rows, clashing columns; what it says of them holds."""
    import corpus_pipeline
    from tidemark.llm import common

    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    count = lambda df: collections.Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())
    before = count(docs)
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        got = common.written(stage(spark, docs, edge_dir))
        if name != "source_mix":
            assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            after[name] = count(got)
        else:
            assert collections.Counter(r["doc_id"] for r in got.collect()) == collections.Counter(i for i, n in before.items() for i in [i[0]] * n)
        assert stage(spark, docs.where("false"), edge_dir).count() == 0
    odd = {x: n for x, n in before.items() if not (x[1] or "").split()}
    assert all(after[name][x] == n for name in after for x, n in odd.items())
    assert {i for i, _ in before - after["toxicity"]} <= {300 + i for i in range(60)} and len(before - after["toxicity"]) > 50
    assert before - after["near_dedup"] == collections.Counter({x: n for x, n in before.items() if x[0] in (5, 8, 12, 14)})  # copies, and texts of the same shingles
    assert after["near_dedup"][15, "same row here"] == 2
    assert (8, before_text(before, 8)) in before - after["substring_dedup"] and (None, before_text(before, None)) in after["substring_dedup"]
    assert before - after["decontamination"] == collections.Counter({(105, before_text(before, 105)): 1})
    assert corpus_pipeline.run(spark, edge_dir).columns == ["doc_id", "source", "size", "source_size", "target", "taken"]


def before_text(rows, doc_id):
    return next(t for i, t in rows if i == doc_id)


@no_tables
def test_stages_take_effect(spark):
    import corpus_pipeline
    from tidemark.llm import common, decontam, neardup, substrings, toxicity

    read = lambda name: spark.read.parquet(f"{DATA}/{name}.parquet")
    docs, seen = read("documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = common.written(stage(spark, docs, DATA))
        seen.append((name, docs, after))
        if name != "source_mix":
            assert after.columns == docs.columns
        docs = after
    by = {name: (before, after) for name, before, after in seen}
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    before, after = by["toxicity"]
    assert ids(after) == {r["doc_id"] for r in toxicity.score(before, read("labels")).where("predicted = 0").collect()}
    before, after = by["near_dedup"]
    assert ids(after) == {r["doc_id"] for r in neardup.near_duplicates(before).where("kept").collect()}
    before, after = by["substring_dedup"]
    marks = {r["doc_id"]: r for r in substrings.remove_repeats(before).collect()}
    assert ids(after) == {i for i, r in marks.items() if r["n_removed"] == 0 or r["n_removed"] < r["n_words"]}
    assert all(len(r["text"].split()) == marks[r["doc_id"]]["n_words"] - marks[r["doc_id"]]["n_removed"] for r in after.collect())
    before, after = by["decontamination"]
    assert ids(before) - ids(after) == {r["doc_id"] for r in decontam.contaminated(before, read("benchmark")).collect()}
    before, after = by["source_mix"]
    assert ids(after) == ids(before)
    assert corpus_pipeline.run(spark, DATA).count() == after.count()


@no_tables
def test_mix_equals_its_sql(spark):
    import duckdb
    from tidemark.llm import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    expected = con.execute(f"SELECT doc_id, source, size, source_size, target, taken FROM ({queries.OP9_SQL}) ORDER BY doc_id").fetchall()
    got = queries.op9_source_mix(spark, DATA).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == expected


def test_ten_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
