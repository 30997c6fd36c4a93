"""Reviews that grow by micro-batches, commits as a stream, and the bounded drain of messages."""

import subprocess
import time

import pytest
from helpers import dicts
from tidemark.plans.barrier import Scope, settled
from tidemark.plans.review import review_changes
from tidemark.sources import git, linediff
from tidemark.streaming import accumulate, drain, progress

BODY = "\n".join(f"    let step_{k} = wagon_{k}(load);" for k in range(6))
SCHEMA = "changeset_id string, file_idx long, path string, status string, is_binary boolean, old_content string, new_content string"


def moved_rows():
    """A function leaves one file for another, one is renamed, a test and a generated file come along; two change sets."""
    barn, silo = f"fn keep() {{}}\nfn haul(load: u8) {{\n{BODY}\n}}\n", f"fn haul(load: u8) {{\n{BODY}\n}}\n"
    rows = []
    for n, c in enumerate(("one", "two")):
        rows += [
            (c, 10 * n, "src/barn.rs", "Modified", False, barn, "fn keep() {}\n"), (c, 10 * n + 1, "src/silo.rs", "Added", False, None, silo),
            (c, 10 * n + 2, "src/gate.rs", "Modified", False, "fn open_gate() {}\n", "fn open_gates() {}\n"), (c, 10 * n + 3, "tests/barn_test.rs", "Added", False, None, "#[test]\nfn hauls() {}\n"),
            (c, 10 * n + 4, "Cargo.lock", "Modified", False, "a\n", "b\n"), (c, 10 * n + 5, "src/plain.rs", "Modified", False, "fn p() { 1 }\n", "fn p() { 2 }\n"),
        ]
    return rows


def shown(items):
    return sorted((r["changeset_id"], r["id"], r["title"], r["category"], r["priority"], tuple(r["symbols"]), tuple(e["summary"] for e in r["evidence"]), r["why"]) for r in dicts(items))


@pytest.fixture(scope="module")
def whole(spark):
    return review_changes(linediff.with_hunks(spark.createDataFrame(moved_rows(), SCHEMA)))


def stream_of(spark, folder, parts):
    for k, rows in enumerate(parts):
        linediff.with_hunks(spark.createDataFrame(rows, SCHEMA)).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(0.02 * (k + 1))  # files are taken in the order of their times
    schema = spark.read.parquet(str(folder)).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


@pytest.mark.parametrize("review_each", [True, False])
def test_a_move_over_two_batches_is_one_item(spark, tmp_path, whole, review_each):
    rows = moved_rows()
    parts = [[r for r in rows if r[1] % 2 == k] for k in (0, 1)]  # the two ends of each move come apart
    query = accumulate.run_review(stream_of(spark, tmp_path / "in", parts), str(tmp_path / "state"), str(tmp_path / "cp"), 3, review_each=review_each, messages=str(tmp_path / "told"), tag="grow")
    assert query.awaitTermination(300) and spark.getTags() == set()
    state = accumulate.State(spark, str(tmp_path / "state"))
    assert len(state.batches()) == 2
    if not review_each:
        assert state.latest("items").count() == 0
        accumulate.finish(state)
    assert any(i[1].startswith("move:") for i in shown(whole.items))
    assert shown(state.latest("items")) == shown(whole.items)
    assert sorted(map(tuple, state.latest("stats").collect())) == sorted(map(tuple, whole.stats.collect()))
    assert {(r["generation"], r["index"]) for r in spark.read.parquet(str(tmp_path / "told")).collect()} == {(3, r[1]) for r in rows}


def test_a_batch_that_runs_again_and_a_file_that_comes_again(spark, tmp_path, whole):
    state, rows = accumulate.State(spark, str(tmp_path / "state")), moved_rows()
    frame = lambda rows: linediff.with_hunks(spark.createDataFrame(rows, SCHEMA))
    assert state.latest("items") is None and state.once("files") is None
    early = [(*r[:6], "fn other() {}\n") if r[2] == "src/plain.rs" else r for r in rows if r[0] == "one"]
    accumulate.add_batch(state, frame(early), 0)
    first = shown(state.latest("items"))
    state.put("items", 2, state.latest("items"))  # a batch that failed half way is not marked, so nothing of it shows
    assert shown(state.latest("items")) == first
    for _ in range(2):
        accumulate.add_batch(state, frame([r for r in rows if r[0] == "two" or r[2] == "src/plain.rs"]), 2)
    assert shown(state.latest("items")) == shown(whole.items)
    assert state.once("files").count() == len(rows)


def run(repo, *args):
    subprocess.run(["git", "-C", str(repo), "-c", "user.name=a", "-c", "user.email=a@b", *args], check=True, capture_output=True)


def test_commits_as_a_stream_are_read_once(spark, tmp_path):
    repo = tmp_path / "repo"
    repo.mkdir()
    run(repo, "init", "-qb", "main")
    git.register(spark)

    def commit(n):
        (repo / f"f{n}.rs").write_text(f"fn f{n}() {{}}\n")
        (repo / "all.txt").write_text("".join(f"{k}\n" for k in range(n + 1)))
        run(repo, "add", "-A")
        run(repo, "commit", "-qm", str(n))

    def drain_all():
        stream = spark.readStream.format("git_changes").option("path", str(repo)).option("branch", "main").option("commits", "2").load()
        query = accumulate.run_review(stream, str(tmp_path / "state"), str(tmp_path / "cp"))
        assert query.awaitTermination(300)

    for n in range(3):
        commit(n)
    drain_all()
    for n in range(3, 5):
        commit(n)
    drain_all()
    drain_all()  # nothing is left
    state = accumulate.State(spark, str(tmp_path / "state"))
    ids = subprocess.run(["git", "-C", str(repo), "rev-list", "--reverse", "main"], capture_output=True, text=True, check=True).stdout.split()
    got = sorted((ids.index(r["changeset_id"]), r["path"], r["status"], r["added_lines"]) for r in state.all("files").collect())
    assert got == sorted([(n, f"f{n}.rs", "Added", 1) for n in range(5)] + [(n, "all.txt", "Modified" if n else "Added", 1) for n in range(5)])
    assert {r["changeset_id"] for r in state.latest("items").collect()} == set(ids)


def test_drain_takes_64_messages_a_trigger(spark, tmp_path):
    rows = [("a", s, 7 if s % 5 else 6, s % 90, "Finished" if s == 131 else "Progress") for s in range(200)] + [("b", s, 7, s, "Progress") for s in range(10)]
    frame = spark.createDataFrame(rows, "viewer string, seq long, generation long, index long, kind string")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen: list[dict] = []
    stream = drain.drained_stream(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")), 7)
    query = stream.writeStream.outputMode("update").foreachBatch(lambda b, n: seen.extend(r.asDict() for r in b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="100 milliseconds").start()
    until = time.time() + 120
    while time.time() < until and not any(r["viewer"] == "a" and r["waiting"] == 0 for r in seen):
        time.sleep(0.2)
    query.stop()
    states = [r for r in seen if r["viewer"] == "a"]
    assert [r["waiting"] for r in states] == [136, 72, 8, 0]
    for k, state in enumerate(states, 1):
        (batch,) = progress.drained(frame.where(f"viewer = 'a' AND seq < {64 * k}"), 7).collect()
        assert (state["analysed"], state["last_finished"], state["done"]) == (batch["analysed"], batch["last_finished"], batch["done"])
    assert states[-1]["done"] and [(r["analysed"], r["done"]) for r in seen if r["viewer"] == "b"] == [(10, False)]


def test_scopes_delete_what_they_settled(spark):
    import os

    with Scope(spark) as outer:
        with Scope(spark) as inner:
            gone = settled(spark.range(3))
            kept = inner.keep(gone.where("id > 0"))
        assert len(inner.folders) == 1 and len(outer.folders) == 1 and kept.count() == 2
        assert not os.path.exists(inner.folders[0].removeprefix("file:"))
    assert not os.path.exists(outer.folders[0].removeprefix("file:"))
