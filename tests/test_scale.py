"""Operators that spread large groups: places over ranges, greedy renames, line differences, large files in git."""

import random
import subprocess
import time
import tracemalloc

import pytest
from helpers import dicts, items_frame
from pyspark.sql import functions as F
from tidemark.operators import group, moves, numbering, rank, symbols, views
from tidemark.sources import git, linediff, tables


def many_items(spark, n=3_000):
    rng = random.Random(4)
    rows = [{"id": f"i{k}", "title": f"t{rng.randrange(50)}", "severity": rng.choice(("Low", "High", "Critical")), "priority": rng.randrange(5), "category": rng.choice(("Mechanical", "Test", "Behavior")) if k < 2_900 else "Test", "changeset_id": "hot" if k % 3 else f"c{k % 9}"} for k in range(n)]
    return items_frame(spark, rows)


@pytest.mark.parametrize("order", [rank.review_order, rank.visible, rank.next_meaningful])
def test_places_are_the_same_in_one_task_and_over_ranges(spark, order):
    items = many_items(spark)
    columns = ["changeset_id", "id", *{"review_order": ["pos"], "visible": ["shown_pos"], "next_meaningful": ["pos", "next_pos"]}[order.__name__]]
    one = sorted(map(tuple, order(items).select(*columns).collect()), key=repr)
    assert sorted(map(tuple, order(items, most=100).select(*columns).collect()), key=repr) == one


def test_a_large_group_is_spread_over_all_tasks(spark):
    rows = spark.range(200_000).select(F.lit(None).cast("string").alias("c"), F.xxhash64("id").alias("h"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small tables stay in as many partitions as large ones
    try:
        got = numbering.numbered(rows, ["c"], [F.col("h")], "pos", most=1_000)
        counts = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(counts) >= 3 and max(counts) < 120_000
    assert got.agg(F.count_distinct("pos"), F.min("pos"), F.max("pos")).first()[:] == (200_000, 1, 200_000)
    assert got.join(got.select((F.col("pos") - 1).alias("pos"), F.col("h").alias("after")), "pos").where("after < h").count() == 0


def test_diff_rows_over_ranges(spark):
    hunk = F.expr("array(named_struct('header', '@@', 'lines', transform(sequence(1, 40), k -> named_struct('kind', 'Addition', 'text', string(k)))))")
    files = spark.range(60).select(F.lit("c").alias("changeset_id"), F.col("id").alias("file_idx"), F.concat(F.lit("f"), "id").alias("path"), hunk.alias("hunks"))
    assert dicts(views.diff_rows(files, most=50), "row") == dicts(views.diff_rows(files), "row")


def bucket_files(spark, n):
    """Generated files, formatting-only ones and test files with symbols of two kinds, in two change sets."""
    k = F.col("id")
    files = spark.range(n).select(
        F.concat(F.lit("c"), k % 2).alias("changeset_id"), k.alias("file_idx"), F.concat(F.when(k % 3 == 2, "tests/").otherwise("src/"), F.lit("f"), k, F.lit(".rs")).alias("path"), F.lit("Modified").alias("status"),
        F.lit("Rust").alias("language"), (k % 3 == 0).alias("is_generated"), F.lit(False).alias("is_binary"), (k % 3 == 2).alias("is_test_file"), (k % 3 == 1).alias("formatting_only"), F.lit(1).cast("long").alias("added_lines"), F.lit(2).cast("long").alias("deleted_lines"),
        F.array(F.lit("x")).alias("added"), F.array(F.lit("y")).alias("deleted"),
    )
    one = lambda name, change: files.where("is_test_file").select("changeset_id", F.col("path").alias("file"), F.concat(F.lit(name), "file_idx").alias("name"), F.lit("Function").alias("kind"), F.lit(change).alias("change"), F.lit(0.9).cast("float").alias("confidence"), F.lit(None).cast("string").alias("old_signature"), F.lit(None).cast("string").alias("new_signature"), *[F.lit(1).alias(c) for c in ("old_start", "old_end", "new_start", "new_end")], F.array(F.lit("e")).alias("evidence"), F.lit(None).cast("string").alias("moved_from"))
    return files, one("a", "Added").unionByName(one("m", "Modified"))


def test_buckets_without_their_files(spark):
    """Headers do not grow with a change set; the members' table has the same files in the same order."""
    files, changes = bucket_files(spark, 300)
    whole, bare = group.group_items(files, changes), group.group_items(files, changes, listed=False)
    assert {r["id"] for r in whole.collect()} == {"mechanical", "tests"} and bare.where(F.size("files") > 0).count() == 0
    assert dicts(bare.drop("files"), "changeset_id", "id") == dicts(whole.drop("files"), "changeset_id", "id")
    for most in (10, 1_000):
        members = group.bucket_members(files, changes, most=most)
        assert dicts(group.with_members(bare, members), "changeset_id", "id") == dicts(whole, "changeset_id", "id")
    assert [len(r["files"]) for r in dicts(group.with_members(bare, members, first=10))] == [10] * 4
    shown = lambda df, **how: sorted((r["changeset_id"], r["id"]) for r in dicts(rank.visible(df, search="F12.", show_mechanical=True, **how)))
    assert shown(bare, members=members) == shown(whole) != shown(bare)


def plain_matches(olds, news):
    used, found = set(), []
    for n, new in enumerate(news):
        best, at = (0, 1), None
        for o, old in enumerate(olds):
            hits, total = symbols.similarity(old, new)
            if o not in used and 10 * hits > 6 * total and hits * best[1] > best[0] * total:
                best, at = (hits, total), o
        if at is not None:
            used.add(at)
            found.append((at, n))
    return found


def test_greedy_matches_are_those_of_the_loop():
    for seed in range(60):
        rng = random.Random(seed)
        word = lambda: "".join(rng.choice("abAB_1") for _ in range(rng.randrange(1, 9)))  # noqa: B023, E731
        olds, news = sorted(word() for _ in range(25)), sorted(word() for _ in range(25))
        assert symbols.greedy_matches(olds, news) == plain_matches(olds, news)


def test_renames_among_many_symbols_of_a_file(spark):
    """20,000 symbols of one file in under a minute."""
    n = 10_000
    rows = spark.range(2 * n).select(
        F.lit("c").alias("changeset_id"), F.lit("f.rs").alias("file"), F.when(F.col("id") < n, "old").otherwise("new").alias("side"), F.col("id").cast("int").alias("sym_idx"),
        F.concat(F.when(F.col("id") < n, "load_row_").otherwise("fetch_row_"), F.col("id") % n).alias("name"), F.lit("Function").alias("kind"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"),
        F.lit("s").alias("signature"), F.lit(False).alias("is_test"), F.lit(True).alias("is_public"), F.lit("b").alias("body"),
    )
    began = time.time()
    found = symbols.renamed(symbols.paired(rows)).groupBy("change").count().collect()
    assert time.time() - began < 60
    assert {r["change"]: r["count"] for r in found}["Renamed"] > n // 2


def test_line_differences_of_long_unlike_files():
    rng = random.Random(1)
    a, b = ([str(rng.randrange(2_000)) for _ in range(20_000)] for _ in range(2))
    began = time.time()
    steps = linediff.shortest_edit(a, b)
    assert time.time() - began < 10
    assert sum(k == "Context" for k, *_ in steps) == linediff.common_length(a, b)
    assert [a[i] for k, i, _ in steps if k != "Addition"] == a and [b[j] for k, _, j in steps if k != "Deletion"] == b


@pytest.mark.parametrize("few", [0, 2, 64])
def test_shortest_whatever_the_search(monkeypatch, few):
    monkeypatch.setattr(linediff, "FEW_EDITS", few)
    for seed in range(120):
        rng = random.Random(seed)
        k = rng.choice((2, 3, 30))
        a, b = ([str(rng.randrange(k)) for _ in range(rng.randrange(40))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        steps = linediff.shortest_edit(a, b)
        assert sum(s[0] == "Context" for s in steps) == row[-1] == linediff.common_length(a, b)
        assert [a[i] for s, i, _ in steps if s != "Addition"] == a and [b[j] for s, _, j in steps if s != "Deletion"] == b


def test_unlike_bodies_are_refused_at_once():
    a, b = "".join(f"x{k}\n" for k in range(12_000)), "".join(f"y{k}\n" for k in range(12_000))
    began = time.time()
    assert moves.line_ratio(a, b) == 0.0 and moves.line_ratio(a, a[:100]) < 0.8
    assert time.time() - began < 0.5
    lines = a.splitlines(keepends=True)
    assert moves.line_ratio(a, "".join(reversed(lines))) < 0.001 and moves.line_ratio(a, "".join(lines[1_000:])) == pytest.approx(22 / 23)


@pytest.fixture
def repo(tmp_path):
    run = lambda *args: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *args], check=True, capture_output=True)
    run("init", "-qb", "main")
    (tmp_path / "a.rs").write_text("fn a() {}\n" * 30)
    run("add", "-A")
    run("commit", "-qm", "one")
    return tmp_path, run


def test_large_binaries_are_not_held(repo):
    at, run = repo
    for k in range(4):
        (at / f"pic{k}.bin").write_bytes(b"\0" + bytes([k]) * (30 << 20))
    (at / "large.txt").write_text("line of text\n" * 100_000)
    (at / "a.rs").write_text("fn b() {}\n" + "fn a() {}\n" * 29)
    run("add", "-A")
    run("commit", "-qm", "two")
    reader = git._Reader({"path": str(at), "mode": "commit", "commit": "HEAD"})
    parts = reader.partitions()
    assert len(parts) >= 4  # dealt by bytes
    tracemalloc.start()
    rows = {r[3]: r for p in parts for r in reader.read(p) if r[3] != "large.txt"}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20 and all(rows[f"pic{k}.bin"][5] and not rows[f"pic{k}.bin"][8] for k in range(4))
    assert (rows["a.rs"][6], rows["a.rs"][7]) == (1, 1)
    large = next(r for p in parts for r in reader.read(p) if r[3] == "large.txt")
    assert (large[5], large[6], large[10]) == (False, 100_000, None)  # text over the limit has lines but no content


def test_conditions_on_path_and_status_are_pushed_down(spark, repo):
    at, run = repo
    for k in range(5):
        (at / f"n{k}.rs").write_text("fn n() {}\n")
    (at / "a.rs").unlink()
    run("add", "-A")
    git.register(spark)
    load = lambda: spark.read.format("git_changes").option("path", str(at)).option("mode", "staged").load()
    assert [r["path"] for r in dicts(load().where("path = 'n3.rs'"))] == ["n3.rs"]
    assert sorted(r["path"] for r in dicts(load().where("status IN ('Deleted', 'Renamed') OR path = 'n1.rs'"))) == ["a.rs", "n1.rs"]
    reader = git._Reader({"path": str(at), "mode": "staged"})
    left = list(reader.pushFilters([git.EqualTo(("status",), "Added"), git.In(("path",), ("n1.rs", "n2.rs", "a.rs")), git.EqualTo(("file_idx",), 1)]))
    assert [f.attribute for f in left] == [("file_idx",)] and [f.new for p in reader.partitions() for f in p.rows] == ["n1.rs", "n2.rs"]


def test_copies_and_renames_far_from_their_origins(spark, repo):
    """The origin lies in another partition, and a file became a folder."""
    at, run = repo
    (at / "b.rs").write_text("".join(f"fn b{k}() {{}}\n" for k in range(40)))
    (at / "x").write_text("old\n")
    run("add", "-A")
    run("commit", "-qm", "two")
    (at / "b.rs").write_text("".join(f"fn b{k}() {{}}\n" for k in range(41)))
    (at / "y.rs").write_text("".join(f"fn b{k}() {{}}\n" for k in range(39)))
    (at / "x").unlink()
    (at / "x").mkdir()
    (at / "x" / "deep.rs").write_text("fn deep() {}\n")
    run("mv", "a.rs", "z.rs")
    run("add", "-A")
    run("commit", "-qm", "three")
    git.register(spark)
    for batch in ("1", "64"):
        got = {r["path"]: r for r in dicts(spark.read.format("git_changes").option("path", str(at)).option("mode", "commit").option("commit", "HEAD").option("batch", batch).load())}
        assert {p: (r["status"], r["old_path"], r["added_lines"], r["deleted_lines"]) for p, r in got.items()} == {
            "b.rs": ("Modified", "b.rs", 1, 0), "y.rs": ("Copied", "b.rs", 0, 1), "z.rs": ("Renamed", "a.rs", 0, 0), "x": ("Deleted", "x", 0, 1), "x/deep.rs": ("Added", "x/deep.rs", 1, 0),
        }


def test_texts_of_one_language_and_source_are_spread_over_tasks(spark, tmp_path):
    rows = spark.range(2_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.when(F.col("id") != 7, F.col("id"))).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    rows.repartition(8).write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small tables stay in as many partitions as large ones
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        counts = [r["count"] for r in tables.doc_changes(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()]
        got = {r["file_idx"]: (r["status"], r["old_content"], r["new_content"]) for r in tables.doc_changes(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(counts) >= 3 and max(counts) < 1_000
    assert len(got) == 2_000 and got[0] == ("Added", None, "text 0") and got[9] == ("Modified", "text 8", "text 9")
    assert got[7] == ("Modified", "text 6", None) and got[8] == ("Added", None, "text 8")
