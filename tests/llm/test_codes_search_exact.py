"""Vector codes, ranked search and exact duplicates against plain Python."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidemark.llm import codes, common, exactdup, lexical

# -- vector codes


@pytest.mark.parametrize("kind", [np.int64, object])
def test_tree_finds_the_lower_of_equally_near_entries(kind):
    rng = np.random.default_rng(5)
    for width in (1, 2, 4, 7):
        entries = rng.integers(-3, 4, (64, width)).astype(kind)  # many equal entries and many equal distances
        queries = rng.integers(-5, 6, (300, width)).astype(kind)
        away = ((queries[:, None, :] - entries[None]) ** 2).sum(axis=2)
        for leaf in (1, 3, 8, 100):
            index, distance = codes.Tree(entries, leaf).nearest(queries)
            assert index.tolist() == [min(range(64), key=lambda e: (row[e], e)) for row in away.tolist()]
            assert distance.tolist() == away.min(axis=1).tolist()


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """(id, code, error, label_error, sha) by the contract's own words, in Python's integers."""
    good = [(i, v, la) for i, v, la in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    good = [r for r in good if len(r[1]) == len(good[0][1])]
    width = len(good[0][1]) if good else 0
    cuts = [i * (width // parts) + min(i, width % parts) for i in range(parts + 1)]
    ints = [[max(-codes.MOST, min(codes.MOST, math.floor(256 * x))) for x in v] for _, v, _ in good]
    books = [[v[a:b] for v in ints[:entries]] for a, b in zip(cuts, cuts[1:], strict=False)]

    def nearest(p, v):
        return min((sum((x - y) ** 2 for x, y in zip(v[cuts[p] : cuts[p + 1]], e, strict=True)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            held = collections.defaultdict(list)
            for v in ints:
                held[nearest(p, v)[1]].append(v[cuts[p] : cuts[p + 1]])
            for e, vs in held.items():
                books[p][e] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, sums = [], collections.Counter()
    for (i, _, la), v in zip(good, ints, strict=True):
        found = [nearest(p, v) for p in range(parts)]
        error = min(sum(d for d, _ in found), codes.LONGEST)
        sums[la] += error
        out.append((i, "".join(f"{e:02x}" for _, e in found), error, la))
    return sorted(((i, c, e, min(sums[la], codes.LONGEST), sha) for i, c, e, la in out), key=repr)


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    for name in ("id", "vector", "n", "code", "part", "total", "of_label", "no_label"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def vector_rows(width=32, n=150, large=1.0):
    rng = random.Random(3)
    rows = [(i, [rng.choice((-0.5, 0.0, 0.25, 0.3, rng.random())) * large for _ in range(width)], rng.choice((1, 2, None))) for i in range(n)]
    bad = [[None] * width, [float("nan")] * width, [0.1] * (width - 1) + [float("inf")], None, []]
    rows += [(-5 - k, v, 1) for k, v in enumerate(bad)]
    return [*rows, (7, rows[7][1], 2), rows[8], rows[8], (None, rows[9][1], None), (n + 9, [0.5] * (width - 1), 1)]


@pytest.mark.parametrize(("width", "n", "large"), [(32, 150, 1.0), (16, 40, 1.0), (20, 70, 1e9), (5, 30, 1e300)])
def test_codes_match_plain_python(spark, width, n, large):
    rows = vector_rows(width, n, large)
    got = [tuple(r) for r in codes.compress(vectors(spark, rows)).collect()]
    assert sorted(got, key=repr) == plain_codes(rows)


def test_codes_of_empty_and_useless_tables(spark):
    assert codes.compress(vectors(spark, vector_rows()).where("false")).count() == 0
    assert codes.compress(vectors(spark, [(1, None, 1), (2, [None], 2)])).count() == 0
    (one,) = codes.compress(vectors(spark, [(4, [0.1] * 16, None)])).collect()
    assert (one["code"], one["error"], one["label_error"]) == ("00" * 16, 0, 0)


# -- ranked search


def plain_search(docs, items, most=10):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    held = [(i, collections.Counter(find(t))) for i, t in docs]
    held = [(i, c, c.total()) for i, c in held if c]
    n_docs, words = len(held), sum(n for *_, n in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in held:
            m = 25 + (75 * n * n_docs) // words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in find(text) if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, r[3], -r[0]) for rank, r in enumerate(sorted(scored)[:most], 1)]
    return sorted(out, key=repr)


def search_rows():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)] + ["Été", "x-y", "A1", "\U0001f600"]
    docs = [(i, " ".join(rng.choice(words[: rng.choice((5, 20, 64))]) for _ in range(rng.choice((1, 5, 40, 200))))) for i in range(300)]
    docs += [(i, docs[i % 7][1]) for i in range(300, 340)] + [(5, docs[5][1]), (None, docs[3][1]), (900, None), (901, ""), (902, " .,; \x00 "), (903, " ".join(words * 900))]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice((1, 3, 30))))) for i in range(25)]
    return docs, [*items, (3, items[3][1]), (40, None), (41, ""), (42, "unknown words"), (43, "w1 w1 W1 w2"), (44, " ".join(words * 40))]


def tables(spark, docs, items):
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    for name in ("id", "n", "item", "score", "rank", "number", "terms", "group", "task"):
        d, b = d.withColumn(name, F.lit("clash")), b.withColumn(name, F.lit("clash"))
    return d, b


@pytest.mark.parametrize("options", [lexical.Options(), lexical.Options(item_bytes=1_500), lexical.Options(shard_docs=7), lexical.Options(shard_postings=20, most=3)])
def test_search_matches_plain_python(spark, options):
    docs, items = search_rows()
    got = [(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in lexical.ranked_search(*tables(spark, docs, items), options=options).collect()]
    assert sorted(got, key=repr) == plain_search(docs, items, options.most)


def test_search_of_empty_tables(spark):
    docs, items = tables(spark, *search_rows())
    for d, b in ((docs.where("false"), items), (docs, items.where("false")), (docs.where("text = ''"), items)):
        assert lexical.ranked_search(d, b).count() == 0


def test_search_stops_before_low_impacts():
    """The bound is worth having: a few documents hold a rare term, all hold a frequent one, and few postings are read."""
    n = 5_000
    weights = np.array([9_000, 30], np.int64)
    terms = [np.array([0, 1] if i < 12 else [1], np.int32) for i in range(n)]
    shard = lexical.Shard(list(range(n)), [50] * n, terms, [np.ones(len(t), np.int64) for t in terms], weights, n, 50 * n)
    found = shard.search({0: 1, 1: 1}, 10, [(10**12, -1)] * 9 + [(10**11, -2)])
    assert found[0][0] == 10**12 and shard.read < 100
    assert [d for _, d in shard.search({0: 1, 1: 1}, 10, [])] == list(range(10))


# -- exact duplicates


def plain_groups(rows):
    held = collections.defaultdict(list)
    for i, t in rows:
        held[t or ""].append(i)
    out = []
    for text, ids in held.items():
        ids.sort(key=lambda i: (i is not None, i or 0), reverse=True)
        out += [(i, ids[0], len(ids), k == 0, hashlib.sha256(text.encode()).hexdigest()) for k, i in enumerate(ids)]
    return sorted(out, key=repr)


def groups(df):
    return sorted(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def test_exact_duplicates_of_edge_rows(edge_docs, edge_rows, no_docs):
    rows = [r for r in edge_rows if r[0] != 16]  # lone surrogates aside, texts are what Python encodes
    assert groups(exactdup.exact_duplicates(edge_docs.where("doc_id IS NULL OR doc_id <> 16"))) == plain_groups(rows)
    assert exactdup.exact_duplicates(edge_docs).count() == len(edge_rows)
    assert exactdup.exact_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("block", [1, 4, 256])
def test_texts_alike_but_for_a_little_stay_apart(spark, block):
    rng = random.Random(2)
    base = "".join(rng.choice("ab") for _ in range(900))
    texts = [base, base[:-1] + "c", base[:450] + "c" + base[451:], base + "a", "ab" * 20, "ba" * 20, "é" * 7, "e" * 14, "a\x00", "a", "", None]
    rows = [(i, texts[i % len(texts)]) for i in range(60)] + [(None, base), (3, texts[3]), (3, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("name", F.lit(1)).withColumn("head", F.lit(2)).withColumn("rid", F.lit(3))
    assert groups(exactdup.exact_duplicates(docs, block=block)) == plain_groups(rows)


def test_a_third_of_all_rows_in_one_group(spark):
    docs = spark.range(6_000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN repeat('hot text ', 60) WHEN id % 3 = 1 THEN concat(repeat('hot text ', 60), id) ELSE concat(id, ' cold') END AS text")
    got = exactdup.exact_duplicates(docs)
    assert got.where("group_size = 2000 AND keep_id = 5997").count() == 2_000 and got.where("kept").count() == 4_001


def test_names_are_ranks_whatever_the_partitions(spark):
    scratch = common.Scratch()
    found = spark.range(1_000).selectExpr("cast(hex(id * 7919 % 1000) as string) AS word")
    for parts in (1, 5):
        rows = exactdup.ranked(found.repartition(parts), ["word"], scratch).orderBy("word").collect()
        assert [r["name"] for r in rows] == list(range(1_000)) and [r["word"] for r in rows] == sorted(r["word"] for r in rows)
    scratch.clear()
