import random
import subprocess

import pytest
from helpers import dicts
from pyspark.sql import functions as F
from tidemark.plans.review import review_changes
from tidemark.sources import git, linediff, repository
from tidemark.streaming import progress

GATE_1 = "const MAX_TRIES: u32 = 3;\n\npub fn open_gate(pin: &str) -> bool {\n    if pin.len() != 4 {\n        return false;\n    }\n    opens(pin)\n}\n"
GATE_2 = "const MAX_TRIES: u32 = 30;\n\npub fn open_gate(pin: &str) -> bool {\n    opens(pin)\n}\n"
LIB_1 = "pub fn weigh_crate(id: u64) -> f64 {\n    0.0\n}\n"
LIB_2 = LIB_1.replace("weigh_crate", "weigh_crate_once")


@pytest.fixture
def repo(tmp_path):
    def run(*args):
        subprocess.run(["git", *args], cwd=tmp_path, check=True, capture_output=True)

    def write(**files):
        for name, content in files.items():
            path = tmp_path / name.replace("__", "/").replace("_rs", ".rs")
            path.parent.mkdir(exist_ok=True)
            path.write_text(content)

    run("init", "-q", "-b", "main")
    run("config", "user.email", "a@b")
    run("config", "user.name", "n")
    write(src__crypto_rs=GATE_1, src__lib_rs=LIB_1)
    run("add", "-A")
    run("commit", "-qm", "one")
    write(src__crypto_rs=GATE_2, src__lib_rs=LIB_2)
    run("add", "-A")
    run("commit", "-qm", "two")
    return tmp_path


def load(spark, repo, **options):
    git.register(spark)
    reader = spark.read.format("git_changes").option("path", str(repo))
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def test_shortest_edits():
    rng = random.Random(2)

    def common(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    for _ in range(1500):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(9))] for _ in range(2))
        steps = linediff.shortest_edit(a, b)
        assert [a[i] for k, i, _ in steps if k != "Addition"] == a and [b[j] for k, _, j in steps if k != "Deletion"] == b
        assert sum(k == "Context" for k, *_ in steps) == common(a, b)


def test_hunks_have_the_known_shape():
    (one,) = linediff.hunks(GATE_1, GATE_2)
    assert one["header"] == "@@ -1,8 +1,5 @@\n" and len(one["lines"]) == 9
    assert linediff.hunks("a\n", "a\n") == [] and linediff.hunks(None, "x\ny")[0]["header"] == "@@ -0,0 +1,2 @@\n"
    assert len(linediff.hunks("\n".join("abcdefghijklmnop"), "\n".join("Abcdefghijklmnop".replace("p", "P")))) == 2


def test_review_of_a_range_is_the_golden_one(spark, repo):
    rows = load(spark, repo, mode="range", base="HEAD~1", head="HEAD", changeset="x")
    files = dicts(rows, "path")
    assert [(r["path"], r["status"], r["added_lines"], r["deleted_lines"], r["hunks"][0]["header"], len(r["hunks"][0]["lines"])) for r in files] == [
        ("src/crypto.rs", "Modified", 1, 4, "@@ -1,8 +1,5 @@\n", 9), ("src/lib.rs", "Modified", 1, 1, "@@ -1,3 +1,3 @@\n", 4),
    ]
    made = review_changes(rows)
    assert [(r["file"], r["name"], r["change"], round(r["confidence"], 2), r["old_start"], r["old_end"], r["new_start"], r["new_end"]) for r in dicts(made.changes, "file", "name")] == [
        ("src/crypto.rs", "MAX_TRIES", "Modified", 0.9, 1, 1, 1, 1), ("src/crypto.rs", "open_gate", "Modified", 0.9, 3, 8, 3, 5), ("src/lib.rs", "weigh_crate → weigh_crate_once", "Renamed", 0.7, 1, 3, 1, 3),
    ]
    assert [(r["id"], r["category"], r["severity"], r["priority"], [e["kind"] for e in r["evidence"]]) for r in dicts(made.items, "pos")] == [
        ("file:src/crypto.rs", "Auth", "Critical", 89, ["auth-surface"]), ("file:src/lib.rs", "Refactor", "Low", 25, ["rename-move"]),
    ]
    (stats,) = dicts(made.stats)
    assert (stats["files_changed"], stats["added_lines"], stats["deleted_lines"], stats["meaningful_changes"], stats["symbols_modified"]) == (2, 2, 5, 2, 3)
    assert [r["id"] for r in dicts(made.gate("High"))] == ["file:src/crypto.rs"]


def test_worktree_staged_and_commit(spark, repo):
    (repo / "new.py").write_text("def a():\n    pass\n")
    (repo / "blob.bin").write_bytes(b"\0\1")
    (repo / "src" / "lib.rs").unlink()
    got = {r["path"]: r for r in dicts(load(spark, repo))}
    assert {p: r["status"] for p, r in got.items()} == {"new.py": "Untracked", "blob.bin": "Untracked", "src/lib.rs": "Deleted"}
    assert got["new.py"]["hunks"][0]["header"] == "untracked file" and got["blob.bin"]["is_binary"] and got["src/lib.rs"]["new_content"] is None
    subprocess.run(["git", "add", "new.py"], cwd=repo, check=True)
    assert [(r["path"], r["status"]) for r in dicts(load(spark, repo, mode="staged"))] == [("new.py", "Added")]
    assert {r["path"] for r in dicts(load(spark, repo, mode="commit", commit="HEAD"))} == {"src/crypto.rs", "src/lib.rs"}
    first = dicts(load(spark, repo, mode="commit", commit="HEAD~1", batch="1"), "path")
    assert [(r["path"], r["status"]) for r in first] == [("src/crypto.rs", "Added"), ("src/lib.rs", "Added")]
    assert git.discover(str(repo / "src")) == str(repo) and git.head_short(str(repo)) == "main"


def test_renames_keep_both_paths(spark, repo):
    subprocess.run(["git", "mv", "src/lib.rs", "src/user.rs"], cwd=repo, check=True)
    (row,) = dicts(load(spark, repo, mode="staged"))
    assert (row["status"], row["old_path"], row["path"]) == ("Renamed", "src/lib.rs", "src/user.rs")


def test_copies_modes_and_binaries(spark, repo):
    """A copy has its own lines only, although its origin changed too; a mode alone has no lines; binaries have none either."""
    body = "".join(f"fn row_{k}() {{}}\n" for k in range(30))
    (repo / "src" / "rows.rs").write_text(body)
    (repo / "src" / "odd name [1].rs").write_text("fn a() {}\n")
    (repo / "tool.sh").write_text("echo\n")
    subprocess.run(["git", "add", "-A"], cwd=repo, check=True)
    subprocess.run(["git", "commit", "-qm", "three"], cwd=repo, check=True)
    (repo / "src" / "copy.rs").write_text(body + "fn more() {}\n")
    (repo / "src" / "rows.rs").write_text(body.replace("row_3()", "row_three()"))
    (repo / "src" / "odd name [1].rs").write_text("fn b() {}\n")
    (repo / "pic.bin").write_bytes(b"\0\1\2")
    (repo / "tool.sh").chmod(0o755)
    subprocess.run(["git", "add", "-A"], cwd=repo, check=True)
    got = {r["path"]: r for r in dicts(load(spark, repo, mode="staged", batch="2"))}
    assert {p: (r["status"], r["old_path"], r["added_lines"], r["deleted_lines"]) for p, r in got.items()} == {
        "src/copy.rs": ("Copied", "src/rows.rs", 1, 0), "src/rows.rs": ("Modified", "src/rows.rs", 1, 1), "src/odd name [1].rs": ("Modified", "src/odd name [1].rs", 1, 1),
        "pic.bin": ("Added", "pic.bin", 0, 0), "tool.sh": ("Modified", "tool.sh", 0, 0),
    }
    assert [x["text"] for x in got["src/copy.rs"]["hunks"][0]["lines"] if x["kind"] == "Addition"] == ["fn more() {}"]
    assert got["pic.bin"]["is_binary"] and got["src/copy.rs"]["old_content"] == body and got["src/copy.rs"]["new_content"].endswith("more() {}\n")


def test_revisions():
    assert git.resolve_revisions(revs="a..b") == {"mode": "range", "base": "a", "head": "b"}
    assert git.resolve_revisions(revs="a..") == {"mode": "range", "base": "a", "head": "HEAD"}
    assert git.resolve_revisions(revs="a", rev2="b")["mode"] == "range" and git.resolve_revisions(staged=True) == {"mode": "staged"}
    assert git.resolve_revisions(revs="abc")["commit"] == "abc" and git.resolve_revisions() == {"mode": "worktree"}
    assert git.resolve_revisions(revs="a", commit="c", staged=True) == {"mode": "commit", "commit": "c"} and git.resolve_revisions(revs="a", staged=True) == {"mode": "staged"}
    assert git.resolve_revisions(revs=" a .. b ") == {"mode": "range", "base": "a", "head": "b"}
    with pytest.raises(ValueError, match="three dots"):
        git.resolve_revisions(revs="a...b")
    with pytest.raises(RuntimeError, match="git rev-parse failed"):
        git.discover("/")


def test_positionals(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "here").mkdir()
    of = git.place_and_revisions
    assert of(".", None, None) == (".", None, None) and of("here", None, None) == ("here", None, None)
    assert of("a..b", None, None) == (".", "a..b", None) and of("topic", None, None) == (".", "topic", None) and of("no/such", None, None) == ("no/such", None, None)
    assert of("main", "HEAD", None) == (".", "main", "HEAD") and of("here", "HEAD", None) == ("here", "HEAD", None) and of("x/y", "HEAD", None) == ("x/y", "HEAD", None)
    assert of("main", "a", "b") == ("main", "a", "b")


def test_repository_scan(spark, tmp_path):
    for path, content in {"src/wagon.rs": "use crate::barn::load;\nfn go() { load(1); }\n", "tests/barn_test.rs": "#[test]\nfn test_load() { load(2); }\n", "target/x.rs": "fn no() {}\n", ".git/y.rs": "fn no() {}\n", "src/changed.rs": "fn c() {}\n", "notes.txt": "x"}.items():
        file = tmp_path / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(content)
    files = repository.read_files(spark, str(tmp_path))
    changed = spark.createDataFrame([("src/changed.rs",)], "path string")
    tests, sources, definitions = repository.scan(files, changed)
    assert dicts(tests) == [{"name": "test_load", "file": "tests/barn_test.rs", "calls": ["load", "test_load"]}]
    assert {r["path"]: (r["calls"], r["imports"]) for r in dicts(sources)}["src/wagon.rs"] == (["go", "load"], ["barn", "load"])
    assert ("go", "src/wagon.rs") in {(r["name"], r["file"]) for r in dicts(definitions)}
    tests, sources, _ = repository.scan(files, None, most_tests=None, most_sources=1)
    assert tests.count() == 1 and sources.where("path NOT LIKE 'tests/%'").count() == 1 and sources.count() == 2


def test_snapshots(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, content string")
    new = spark.createDataFrame([("a", "1"), ("b", "22"), ("d", "4")], "path string, content string")
    assert [(r["path"], r["status"]) for r in dicts(linediff.snapshots(old, new), "path")] == [("b", "Modified"), ("c", "Deleted"), ("d", "Added")]


def test_stream_adds_up_to_the_batch(spark, tmp_path):
    rows = [("c", k, f"src/f{k}.rs", f"fn f{k}() {{}}\n", f"fn f{k}() {{ x }}\n") for k in range(9)]
    schema = "changeset_id string, file_idx long, path string, old_content string, new_content string"
    changes = spark.createDataFrame(rows, schema)
    changes.repartition(3).write.parquet(str(tmp_path / "in"))
    analyse = lambda df: linediff.with_hunks(df).select("path", "added_lines", "deleted_lines")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = progress.run_stream(stream, analyse, str(tmp_path / "out"), str(tmp_path / "checkpoint"), generation=7)
    assert query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.select("path", "added_lines", "deleted_lines").collect())) == sorted(map(tuple, analyse(changes).collect()))
    assert {r["generation"] for r in got.collect()} == {7} and got.select("batch").distinct().count() == 3


def test_stream_tells_of_every_file_and_of_its_end(spark, tmp_path):
    rows = [("c", k, f"src/f{k}.rs", f"fn f{k}() {{}}\n", f"fn f{k}() {{ x }}\n") for k in range(6)]
    schema = "changeset_id string, file_idx long, path string, old_content string, new_content string"
    spark.createDataFrame(rows, schema).repartition(2).write.parquet(str(tmp_path / "in"))
    ended = []
    for generation, fails in ((1, False), (2, True)):
        analyse = lambda df, fails=fails: df.select("path", F.when(F.lit(fails), F.raise_error(F.lit("broken"))).otherwise(F.lit("ok")).alias("state"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = progress.run_stream(stream, analyse, str(tmp_path / f"out{generation}"), str(tmp_path / f"cp{generation}"), generation=generation, messages=str(tmp_path / f"told{generation}"), tag=f"run-{generation}")
        assert progress.finish(query, spark, str(tmp_path / f"told{generation}"), generation, at_end=lambda g=generation: ended.append(g)) is not fails
    told = spark.read.parquet(str(tmp_path / "told1"))
    assert dicts(progress.drained(told, 1)) == [{"analysed": 6, "last_finished": 6, "done": True}]
    assert ended == [1] and not (tmp_path / "told2").exists()
    progress.cancel(query, spark, "run-2")


def test_stale_messages_are_dropped(spark):
    rows = [(1, 0, "Progress"), (1, 0, "Progress"), (1, 1, "Progress"), (2, 0, "Progress"), (2, 9, "Finished")]
    messages = spark.createDataFrame(rows, "generation long, index long, kind string")
    assert dicts(progress.analysed(messages), "generation") == [{"generation": 1, "analysed": 2, "finished": 0}, {"generation": 2, "analysed": 1, "finished": 1}]
    assert dicts(progress.drained(messages, 2)) == [{"analysed": 1, "last_finished": 9, "done": True}]
    assert dicts(progress.drained(messages.where(F.col("generation") == 1), 1))[0]["done"] is False
