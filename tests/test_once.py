"""Steps whose cost has to grow with the input alone: their plans, beside the results that other tests hold."""

import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from helpers import dicts, items_frame
from tidemark import queries as catalogue
from tidemark.functions import text
from tidemark.operators import context, group, moves, rank, render, symbols, task
from tidemark.sources import tables

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@needs_data
@pytest.mark.parametrize("name", ["gate_top", "judged_top25", "junit_cases", "overview", "escalation_summary", "github_annotations", "file_items", "next_meaningful"])
def test_filters_of_items_do_not_score_files_again(spark, name):
    assert "array_except" not in plan_of(catalogue.queries()[name](spark, DATA))


def test_next_place_is_found_in_one_pass(spark):
    items = items_frame(spark, [{"id": str(i), "priority": 50 - i, "category": c} for i, c in enumerate(["Test", "Docs", "Test", "Test", "Docs", "Test"])])
    for most in (2, 100):
        found = rank.next_meaningful(items, most=most)
        assert "unboundedfollowing" not in plan_of(found).lower()
        assert [r["next_pos"] for r in dicts(found, "pos")] == [2, 5, 5, 5, None, None]


@needs_data
def test_reordered_words_are_compared_within_their_row(spark):
    assert "Exchange" not in catalogue.reorder_moves(spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_reordered_pairs_occurrences(spark):
    rows = [("c", f, s, i, n, "Function") for f, olds, news in (("a", "xyxz", "xxyz"), ("b", "xy", "xx"), ("c", "xy", "xyz"), ("d", "x", "")) for s, names in (("old", olds), ("new", news)) for i, n in enumerate(names)]
    frame = spark.createDataFrame(rows, "changeset_id string, file string, side string, sym_idx int, name string, kind string")
    frame = frame.withColumn("start_line", F.col("sym_idx")).withColumn("end_line", F.col("sym_idx")).withColumn("signature", F.col("name"))
    got = [(r["file"], r["name"], r["old_start"], r["new_start"]) for r in dicts(moves.reordered(frame), "file", "old_start")]
    assert got == [("a", "y", 1, 2), ("a", "x", 2, 1)]


def test_many_files_share_a_call_of_the_rename_match(spark):
    rows = [("c", f"f{k}", s, i, n, "Function") for k in range(3) for s, names in (("old", ["load_wheat", "load_oats", "gone"]), ("new", ["load_wheats", "load_oat"])) for i, n in enumerate(names)]
    frame = spark.createDataFrame(rows, "changeset_id string, file string, side string, sym_idx int, name string, kind string")
    frame = frame.select("*", F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.col("name").alias("signature"), F.lit(False).alias("is_test"), F.lit(True).alias("is_public"), F.col("name").alias("body"))
    found = symbols.renamed(symbols.paired(frame))
    assert "FlatMapGroups" not in plan_of(found)
    got = sorted((r["file"], r["change"], r["name"]) for r in found.collect())
    want = [("Removed", "gone"), ("Renamed", "load_oats → load_oat"), ("Renamed", "load_wheat → load_wheats")]
    assert got == sorted((f"f{k}", *w) for k in range(3) for w in want)


@needs_data
def test_sources_of_an_item_never_meet_in_a_row(spark):
    assert "collect_set" not in plan_of(catalogue.blast_radius(spark, DATA))


def test_digests_of_sources_that_pass_by(spark):
    paths = [f"src/{k}.rs" for k in range(25)]
    frame = spark.createDataFrame([("c", i, p) for i, n in (("a", 25), ("b", 1)) for p in reversed(paths[:n])], "changeset_id string, id string, path string")
    want = {i: hashlib.md5("|".join(sorted(paths[:n])).encode()).hexdigest() for i, n in (("a", 25), ("b", 1))}
    assert {r["id"]: r["md5"] for r in context.blast_digests(frame).collect()} == want
    assert {r["id"]: (r["n"], r["first"]) for r in context.blast_counts(frame).collect()} == {"a": (25, sorted(paths)[:8]), "b": (1, paths[:1])}


def test_documents_meet_the_ones_before_them_with_one_shuffle_of_texts(spark, tmp_path):
    ids = [1, 2, 5, 4095, 4096, 4097, 9000, 50_000, 50_001, 1 << 40]
    rows = [(i, None if i == 5 else f"text {i}", lang, source, 6) for k, i in enumerate(ids) for lang, source in [("en" if k % 2 else "fr", "a" if k % 3 else None)]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    made = tables.doc_changes(spark, str(tmp_path))
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    last, want = {}, {}
    for i, text, lang, source, _ in sorted(rows):
        old = last.get((lang, source))
        last[lang, source] = text
        want[i] = ("Added" if old is None else "Modified", old, text)
    assert {r["file_idx"]: (r["status"], r["old_content"], r["new_content"]) for r in made.collect()} == want and made.count() == len(ids)


def test_json_of_a_change_set_is_joined_from_blocks(spark, monkeypatch):
    monkeypatch.setattr(render, "IN_BLOCK", 3)
    items = items_frame(spark, [{"id": str(i), "priority": i % 5, "changeset_id": c, "evidence": [("k", 'a "b"\n')]} for c, n in (("c", 11), ("d", 1)) for i in range(n)])
    files = spark.createDataFrame([("c", i, f"f{i}", None) for i in range(8)], "changeset_id string, file_idx long, path string, language string")
    changes = spark.createDataFrame([], symbols.CHANGE)
    stats = spark.createDataFrame([("c", 1), ("d", 2), ("e", 3)], "changeset_id string, files_changed long")
    tasks = spark.createDataFrame([("c", "t", "Covered", 1.0, ["x"], [])], "changeset_id string, task_text string, verdict string, coverage double, matched_terms array<string>, unmatched array<string>")
    for checks in (None, tasks):
        flat = render.changeset_json(files, changes, items, stats, pretty=False, tasks=checks)
        pretty = {r["changeset_id"]: json.loads(r["json"]) for r in render.changeset_json(files, changes, items, stats, tasks=checks).collect()}
        got = {r["changeset_id"]: r["json"] for r in flat.collect()}
        assert {k: json.dumps(v, separators=(",", ":")) for k, v in pretty.items()} == got and set(got) == set("cde")
        assert "to_json(items" not in plan_of(flat) and "array_join" in plan_of(flat)


def test_items_with_the_same_keys_share_a_list_of_tests(spark):
    files = [f"src/f{k}.rs" for k in range(6)]
    items = items_frame(spark, [{"id": f"file:{f}", "files": [f], "symbols": ["Box::open"] if k < 4 else ["Box::open", "lost"] if k == 4 else ["lost"]} for k, f in enumerate(files)])
    changed = spark.createDataFrame([("c", f, n, "Function", False) for f in files for n in ("Box::open", "lost")], "changeset_id string, file string, name string, kind string, is_test_file boolean")
    tests = spark.createDataFrame([("c", f"t{k}", f"tests/{k}.rs", ["open"]) for k in range(5)] + [("c", "test_open", "tests/a.rs", ["z"])], "changeset_id string, name string, file string, calls array<string>")
    marked, covers = context.mark_coverage(items, changed, tests)
    assert covers.count() == 1 and max(len(e["summary"]) for r in marked.collect() for e in r["evidence"] if e["kind"] == context.COVERING) == len("covered by ")
    want = dicts(context.apply_coverage(items, context.coverage_links(changed, tests), tests), "id")
    got = context.with_covers(marked, covers)
    assert dicts(got, "id") == [{k: r[k] for k in got.columns} for r in want] and set(got.columns) == set(items.columns)
    assert want[0]["evidence"][0]["summary"] == "covered by " + ", ".join(f"t{k} (tests/{k}.rs)" for k in range(5)) + ", test_open (tests/a.rs)"


def test_names_that_many_sources_call_meet_those_that_import_them(spark):
    names = ["A::open", "B::open", "B::shut", "lone"]
    targets = spark.createDataFrame([("c", f"i{k}", [f"s{k}"], n) for k, n in enumerate(names)], "changeset_id string, id string, files array<string>, name string")
    words = ["open", "A::open", "shut", "B::shut", "lone"]
    sources = [(f"s{i}", [w for b, w in enumerate(words) if i >> b & 1], [w for b, w in enumerate(words) if i >> (b + 5) & 1]) for i in range(1024)]
    defined = [("B::shut", "x"), ("lone", "x"), ("lone", "y")]
    want = set()
    for k, n in enumerate(names):
        keys = {n, n.split("::")[-1]}
        want |= {(f"i{k}", p) for p, calls, imports in sources if keys & set(calls) and (n == "B::shut" or keys & set(imports)) and p != f"s{k}"}
    found = context.blast_radius(targets, spark.createDataFrame(sources, "path string, calls array<string>, imports array<string>"), spark.createDataFrame(defined, "name string, file string"))
    assert sorted((r["id"], r["path"]) for r in found.collect()) == sorted(want)


def test_review_names_each_test_of_a_group_once(spark, tmp_path):
    spark.range(1, 241).withColumnRenamed("id", "p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    rows = catalogue.review_of_code(spark, str(tmp_path)).collect()
    groups = {}
    for r in rows:
        if r["tests"] is not None:
            groups.setdefault(r["tests"], set()).add(r["proof"])
    items = {r["id"]: r["proof"] for r in rows if r["tests"] is None}
    assert len(groups["tests calling open"]) > 25 and max(len(p) for p in items.values()) < 1_500
    assert sum(r["tests"] is not None for r in rows) == sum(map(len, groups.values()))

    def whole(proof):
        """With the names of the tests in place of their groups."""
        parts = [p.split("covered by ", 1) for p in proof.split("|")]
        return "|".join(p[0] if len(p) == 1 else p[0] + "covered by " + ", ".join(sorted(set().union(*(groups[g] for g in p[1].split(", "))))) for p in parts)

    want = catalogue._code_review(spark, str(tmp_path), False).items.select("id", catalogue._evidence().alias("proof"))
    assert {k: whole(p) for k, p in items.items()} == {r["id"]: r["proof"] for r in want.collect()}


@needs_data
@pytest.mark.parametrize("name,most", [("exact_moves", 2), ("similar_moves", 2), ("move_pairs", 3), ("file_items", 1)])
def test_symbols_of_documents_are_paired_where_their_texts_meet(spark, name, most):
    df = catalogue.queries()[name](spark, DATA) if name != "file_items" else catalogue._with_symbols(spark, DATA)
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= most


def test_partners_within_a_row_are_those_of_a_join(spark):
    rng = random.Random(3)
    line = lambda: rng.choice(("ab c. x", "ab c. y", "ab d. x", "abc", "é f", "_g h", " ", "zz"))
    body = lambda: None if rng.random() < 0.1 else "\n".join(line() for _ in range(rng.randrange(9)))
    rows = [("c", f"f{k}", body(), body()) for k in range(120)] + [("c", "none", None, None), ("c", "empty", "", "")]
    files = spark.createDataFrame(rows, "changeset_id string, path string, old_content string, new_content string").repartition(3)
    met = symbols.with_partners(tables.with_line_symbols(files))
    listed = tables.line_symbols(files)
    changes = symbols.diff_symbols(listed, renames=False)
    want = {r["path"]: r["all_symbols"] for r in group.symbols_by_file(changes).collect()}
    got = {r["path"]: r["s"] for r in met.select("path", group.bare_symbols(symbols.change_lists()).alias("s")).collect()}
    assert {k: v for k, v in got.items() if v is not None} == want and len(got) == len(rows)
    columns = ["file", "name", "kind", "change", "old_signature", "new_signature", "old_start", "old_end", "new_start", "new_end", "body"]
    rows_of = lambda df: sorted(map(repr, df.select(*columns).collect()))
    assert rows_of(symbols.lone_rows(met)) == rows_of(moves.candidates(symbols.added_removed(symbols.paired(listed)), listed))


def test_items_of_tasks_against_every_pair(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randrange(2, 8)))
    monkeypatch.setattr(task, "MOST_FILES", 3)
    monkeypatch.setattr(task, "ITEMS_IN_BLOCK", 4)
    monkeypatch.setattr(task, "TASKS_IN_BLOCK", 2)
    files = [(c, f"f{k}", [f"{word()} {word()}" for _ in range(3)]) for c in "cd" for k in range(30)]
    own = [{"changeset_id": c, "id": f"file:f{k}", "title": f"t{k % 3}", "files": [f"f{k}"], "why": word()} for c in "cd" for k in range(20)]
    own += [{"changeset_id": "c", "id": "mechanical", "title": "m", "files": [f"f{k}" for k in range(18, 30)], "why": ""}]
    asked = [(t, " ".join(word() for _ in range(6)) + " \U00020000") for t in range(5)]
    frame = spark.createDataFrame(files, "changeset_id string, path string, added array<string>")
    tasks = spark.createDataFrame([(c, *a) for c in "cd" for a in asked], "changeset_id string, task_id int, task_text string")
    terms = tasks.select("changeset_id", "task_id", F.posexplode(text.task_terms(F.col("task_text"))).alias("term_idx", "term"))
    items = items_frame(spark, own)
    got = {(r["changeset_id"], r["task_id"], r["rank"]): (r["id"], r["matched_terms"], round(r["score"], 9)) for r in task.item_hits(tasks, terms, items, frame).collect()}

    pairs = items.select("changeset_id", "id", "title", F.explode("files").alias("path")).join(frame, ["changeset_id", "path"]).select("changeset_id", "id", "title", F.explode("added").alias("line"))
    said = items.select("changeset_id", "id", "title", F.explode(F.concat(F.array("title", "why"), F.col("files"), F.col("symbols"))).alias("line"))
    tokens = pairs.unionByName(said).select("changeset_id", "id", "title", F.explode(text.split_ident(F.col("line"))).alias("token"))
    hits = tokens.join(terms, "changeset_id").where(text.match_score(F.col("term"), F.col("token")) > 0).select("changeset_id", "task_id", "id", "title", "term_idx", "term").distinct()
    found = {}
    for r in hits.collect():
        found.setdefault((r["changeset_id"], r["task_id"]), {}).setdefault((r["title"], r["id"]), []).append((r["term_idx"], r["term"]))
    count = {(r["changeset_id"], r["task_id"]): r["n"] for r in terms.groupBy("changeset_id", "task_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    want = {}
    for (c, t), of in found.items():
        for rank, ((_, i), held) in enumerate(sorted(of.items(), key=lambda x: (-len(x[1]), x[0]))[:5], 1):
            want[c, t, rank] = (i, [term for _, term in sorted(held)], round(len(held) / count[c, t], 9))
    assert got == want and any(v[0] == "mechanical" for v in got.values())


def test_terms_near_tokens_are_those_with_a_score(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abä\U00020000") for _ in range(rng.randrange(1, 9)))
    terms, tokens = sorted({word() for _ in range(60)}), sorted({word() for _ in range(200)})
    every = spark.createDataFrame([(a, b) for a in terms for b in tokens], "term string, token string").where(text.match_score(F.col("term"), F.col("token")) > 0)
    known = task.Terms(terms)
    for near in (known.near(tokens), known.remembered(tokens), known.remembered(tokens)):
        assert sorted((terms[i], b) for b, of in zip(tokens, near, strict=True) for i in of) == sorted((r["term"], r["token"]) for r in every.collect())
