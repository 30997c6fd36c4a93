import json
import random

import pytest
from helpers import dicts, items_frame, lit_array
from pyspark.sql import functions as F
from tidemark import queries
from tidemark.functions import text
from tidemark.operators import cache, context, escalate, extract, group, judge, moves, rank, render, scanners, score, symbols, task, views

SYMBOL = "changeset_id string, file string, side string, sym_idx int, name string, kind string, start_line int, end_line int, signature string, is_test boolean, is_public boolean, body string"


def syms(spark, rows):
    """Rows (side, name, body[, kind, signature, public, file])."""
    full = []
    for i, r in enumerate(rows, 1):
        side, name, body, kind, signature, public, file = (*r, *("Function", None, True, "a.rs")[len(r) - 3 :])
        full.append(("c", file, side, i, name, kind, i, i, signature or name, False, public, body))
    return spark.createDataFrame(full, SYMBOL)


def changes_of(df):
    return sorted((r["file"], r["name"], r["change"], round(r["confidence"], 2)) for r in df.collect())


def test_pairs_renames_and_leftovers(spark):
    rows = syms(spark, [("old", "fetch_user", "1"), ("old", "gone", "2"), ("old", "same", "3"), ("old", "edit", "4"), ("old", "vis", "5"), ("new", "fetch_user_by_id", "1"), ("new", "same", "3"), ("new", "edit", "44"), ("new", "vis", "5", "Function", None, False), ("new", "fresh", "9", "Const")])
    assert changes_of(symbols.diff_symbols(rows)) == [("a.rs", "edit", "Modified", 0.9), ("a.rs", "fetch_user → fetch_user_by_id", "Renamed", 0.7), ("a.rs", "fresh", "Added", 0.98), ("a.rs", "gone", "Removed", 0.95), ("a.rs", "vis", "VisibilityChanged", 0.95)]
    assert ("a.rs", "fetch_user", "Removed", 0.95) in changes_of(symbols.diff_symbols(rows, renames=False))


def test_a_rename_uses_an_old_symbol_once(spark):
    rows = syms(spark, [("old", "load_item", "1"), ("new", "load_items", "2"), ("new", "load_itemx", "3")])
    assert [c[2] for c in changes_of(symbols.diff_symbols(rows))].count("Renamed") == 1


def test_overloads_pair_by_place(spark):
    rows = syms(spark, [("old", "f", "1", "Function", "f(a)"), ("old", "f", "2", "Function", "f(b)"), ("new", "f", "1", "Function", "f(a)"), ("new", "f", "2", "Function", "f(c)")])
    assert changes_of(symbols.diff_symbols(rows)) == [("a.rs", "f", "SignatureChanged", 0.95)]


def linked(spark, rows, **how):
    df = syms(spark, rows)
    return {(r["name"], r["change"], round(r["confidence"], 2), r["moved_from"]) for r in moves.link_moves(symbols.diff_symbols(df, renames=False), df, **how).collect()}


def test_exact_move_and_rename_in_move(spark):
    body = "fn helper() {\n  work(1);\n  more(2);\n}"
    assert linked(spark, [("old", "helper", body, "Function", None, True, "a.rs"), ("new", "helper", body, "Function", None, True, "b.rs")]) == {("helper", "Moved", 0.95, "a.rs")}
    other = body.replace("helper", "helper2")
    assert linked(spark, [("old", "helper", body, "Function", None, True, "a.rs"), ("new", "helper2", other, "Function", None, True, "b.rs")]) == {("helper → helper2", "Moved", 0.7, "a.rs")}


def test_boilerplate_is_no_move(spark):
    body = "fn new() {\n  Self\n}"
    got = linked(spark, [("old", "a", body, "Function", None, True, "a.rs"), ("old", "b", body, "Function", None, True, "b.rs"), ("new", "c", body, "Function", None, True, "c.rs")])
    assert {c[1] for c in got} == {"Added", "Removed"}


def test_move_with_edits(spark):
    old = "\n".join(["fn big() {", *[f"  step({k});" for k in range(10)], "}"])
    new = old.replace("step(4)", "step(44)")
    rows = [("old", "big", old, "Function", None, True, "a.rs"), ("new", "big", new, "Function", None, True, "b.rs")]
    assert linked(spark, rows) == {("big", "Moved", 0.7, "a.rs")}
    assert {c[1] for c in linked(spark, rows, similar=False)} == {"Added", "Removed"}


def test_line_ratios_match_a_longest_common_subsequence():
    import random

    rng = random.Random(31)

    def common(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    for _ in range(500):
        a = [rng.choice("abcdef") for _ in range(rng.randrange(1, 14))]
        b = [x for x in a if rng.random() < 0.9] + [rng.choice("abg") for _ in range(rng.randrange(3))]
        expected = 2 * common([f"{x}\n" for x in a], [f"{x}\n" for x in b]) / (len(a) + len(b))
        got = moves.line_ratio("".join(f"{x}\n" for x in a), "".join(f"{x}\n" for x in b))
        assert got == pytest.approx(expected) if expected >= moves.LEAST_ALIKE else got < moves.LEAST_ALIKE


def test_reorder(spark):
    rows = [("old", "a", "1"), ("old", "b", "2"), ("new", "b", "2"), ("new", "a", "1")]
    assert linked(spark, rows) == {("a", "Moved", 0.85, None), ("b", "Moved", 0.85, None)}


FILE = "path string, added array<string>, deleted array<string>, symbols array<struct<name:string,kind:string,change:string,confidence:float,moved_from:string>>, is_generated boolean, formatting_only boolean"


def scored(spark, path, added="x", deleted="y", changes=(), generated=False):
    from tidemark.functions import paths

    row = [(path, [added], [deleted], [(f"s{i}", "Function", c, 0.9, None) for i, c in enumerate(changes)], generated, False)]
    df = spark.createDataFrame(row, FILE).withColumn("language", paths.language_of(F.col("path"))).withColumn("is_test_file", paths.is_test_path(F.col("path")))
    (got,) = dicts(score.score_files(df))
    return got["priority"], got["severity"], got["category"], [e["kind"] for e in got["evidence"]]


# one case for each rule: a word as a whole part of the path or not, tests and docs before other categories, secrets by path and
# text together, comments and literals that do not count
@pytest.mark.parametrize(
    ("path", "added", "deleted", "test"),
    [
        ("web/signin/flow.go", "a()", "b()", lambda p, s, c, e: p >= 55 and c == "Auth"), ("web/loginless.go", "a()", "b()", lambda p, s, c, e: c != "Auth"),
        ("pkg/test/oauth_flow.py", "a()", "b()", lambda p, s, c, e: c == "Test" and s == "High"), ("manual/permission.rst", "a", "b", lambda p, s, c, e: c == "Docs"),
        ("src/monkey_bars.rs", "read(password);", "read();", lambda p, s, c, e: c != "Security"), ("src/credential/store.rs", "read(password);", "read();", lambda p, s, c, e: c == "Security" and s == "Critical"),
        ("src/orchard.rs", "plant();", "// only a valid sapling", lambda p, s, c, e: "validation-removed" not in e), ("src/orchard.rs", "plant();", "is_valid(sapling);", lambda p, s, c, e: "validation-removed" in e),
        ("src/orchard.rs", "unsafe impl Send for Tree {}", "plant();", lambda p, s, c, e: c == "Security" and e == ["unsafe"]), ("src/orchard.rs", 'say("unsafe impl of nothing");', "plant();", lambda p, s, c, e: p < 55 and e == []),
    ],
)
def test_scores(spark, path, added, deleted, test):
    assert test(*scored(spark, path, added, deleted))


def test_symbol_signals(spark):
    assert scored(spark, "lib/barn.rs", changes=["VisibilityChanged"])[2] == "ApiBreak"
    assert scored(spark, "lib/oauth.rs", changes=["Modified", "Added"]) == (20 + 45 + 12 + 8, "Critical", "Auth", ["auth-surface"])
    assert scored(spark, "lib/barn.rs", changes=["Moved"]) == (25, "Low", "Refactor", ["rename-move"])
    assert scored(spark, "lib/barn.rs", changes=["Modified"] * 9)[0] == 20 + 25
    assert scored(spark, "yarn.lock", generated=True)[:3] == (2, "Low", "Mechanical")


def files_frame(spark, rows):
    """Rows (path, status, all_symbols as (name, change), added, deleted)."""
    from tidemark.functions import paths

    full = [("c", i, p, s, [(n, "Function", c, 0.9, None) for n, c in y], a, d, ["x"] * a, ["y"] * d) for i, (p, s, y, a, d) in enumerate(rows)]
    df = spark.createDataFrame(full, f"changeset_id string, file_idx long, path string, status string, all_symbols array<{group.SYMBOL}>, added_lines long, deleted_lines long, added array<string>, deleted array<string>")
    df = df.withColumn("language", paths.language_of(F.col("path"))).withColumn("is_test_file", paths.is_test_path(F.col("path"))).withColumn("is_generated", paths.generated_by_name(F.col("path")))
    return df.withColumn("formatting_only", F.lit(False))


def test_buckets_and_file_items(spark):
    df = files_frame(spark, [("Cargo.lock", "Added", [], 3, 0), ("tests/a_test.rs", "Added", [("t1", "Added"), ("t2", "Added"), ("t3", "Modified")], 9, 0), ("tests/b_test.rs", "Modified", [("t4", "Removed")], 0, 4), ("tests/c_test.rs", "Renamed", [("t5", "Added")], 1, 1), ("src/z.rs", "Modified", [], 0, 0), ("src/y.rs", "Modified", [], 2, 1), ("src/x.rs", "Deleted", [("f", "Removed")], 0, 8)])
    (mechanical,) = dicts(group.mechanical_bucket(df))
    assert mechanical["title"] == "Generated / mechanical changes — 1 file collapsed" and mechanical["files"] == ["Cargo.lock"]
    (tests,) = dicts(group.tests_bucket(df))
    assert tests["title"] == "Tests — 2 new test symbols, 1 modified across 1 file" and [e["kind"] for e in tests["evidence"]] == ["test-additions", "test-modified"]
    titles = {r["id"]: r["title"] for r in dicts(group.file_items(df))}
    assert titles == {"file:tests/b_test.rs": "tests/b_test.rs — t4 removed", "file:src/y.rs": "src/y.rs — +2 −1", "file:src/x.rs": "src/x.rs — f removed"}
    assert "file:tests/c_test.rs" in {r["id"] for r in dicts(group.file_items(df, keep_unbucketed_tests=True))}


def test_orders_and_gates(spark):
    items = items_frame(spark, [{"id": "docs", "severity": "Low", "category": "Docs"}, {"id": "auth", "severity": "High", "category": "Auth"}, {"id": "dep", "severity": "Critical", "category": "Dependency"}, {"id": "m", "severity": "Critical", "category": "Mechanical", "priority": 99}])
    assert [r["id"] for r in dicts(rank.review_order(items), "pos")] == ["m", "dep", "auth", "docs"]
    assert [r["id"] for r in dicts(rank.gate(items, "High"))] == ["dep"]
    assert dicts(rank.gate(items.where("id = 'm'"), "Low")) == []
    assert [r["id"] for r in dicts(rank.visible(items, search="TITLE d"), "shown_pos")] == ["dep", "docs"]
    assert [r["next_pos"] for r in dicts(rank.next_meaningful(items), "pos")] == [2, 3, 4, None]
    ties = items_frame(spark, [{"id": "a"}, {"id": "b"}])
    assert [r["id"] for r in dicts(rank.gate(ties, "High"))] == ["b"]
    assert [r["id"] for r in dicts(rank.selected(items, 1))] == ["auth"]


def test_escalation(spark):
    rows = [{"id": "crit", "severity": "Critical"}, {"id": "high"}, {"id": "med", "severity": "Medium"}, {"id": "mech", "severity": "Critical", "category": "Mechanical"}]
    items = items_frame(spark, rows)
    assert [r["id"] for r in dicts(rank.candidates(items, "High"), "pos")] == ["crit", "high"]
    many = items_frame(spark, [{"id": f"h{k:02d}"} for k in range(15)])
    stats = spark.createDataFrame([("c", 3, 5, 1)], "changeset_id string, files_changed long, added_lines long, deleted_lines long")
    (package,) = dicts(escalate.package(many, stats, most=5))
    assert len(package["items"]) == 5 and package["approx_tokens"] > sum(i["approx_tokens"] for i in package["items"])
    big = items_frame(spark, [{"id": "x", "title": "t" * 500, "why": "w" * 2000, "evidence": [("note", "e" * 500)] * 19 + [("secret-handling", "s")]}])
    (cut,) = dicts(escalate.compact(rank.candidates(big)))
    assert len(cut["title"]) == 201 and len(cut["why"]) == 501 and len(cut["evidence"]) == 8 and cut["evidence"][0] == "secret-handling: s"
    (said,) = dicts(escalate.summary(escalate.package(many, stats, most=2)))
    assert "2 item(s)" in said["summary"] and "title h00" in said["summary"]
    task_row = spark.createDataFrame([("c", "do it", "Partial", ["a", "b"])], "changeset_id string, task_text string, verdict string, unmatched array<string>")
    assert dicts(escalate.package(items, stats, task=task_row))[0]["task"] == {"text": "do it", "verdict": "Partial", "unmatched": ["a", "b"]}


def test_judges(spark):
    items = items_frame(spark, [{"id": "m", "category": "Mechanical"}] + [{"id": f"low{k:02d}", "severity": "Low"} for k in range(30)] + [{"id": "crit", "severity": "Critical", "category": "Auth", "evidence": [("untested-change", "u"), ("unsafe", "n")]}])
    found = dicts(judge.local_judgement(items), "pos")
    assert len(found) == 25 and found[0]["id"] == "crit" and found[0]["risk"] == 0.7 and found[0]["score"] == 2.0
    after = {r["id"]: [e["kind"] for e in r["evidence"]] for r in dicts(judge.LocalJudge().apply(items))}
    assert after["m"] == [] and after["crit"][-2:] == ["judge-risk", "judge-severity"]
    (request,) = dicts(judge.requests(items, "a", "b"))
    document = json.loads(request["request"])
    assert len(document["questions"]) == 50 and "crit::risk" in document["questions"] and document["state"]["items_under_review"] == 25
    answers = spark.createDataFrame([("c", "crit::risk", "noul", 0.5, None, None), ("c", "crit::severity", "score", None, 1.6, 0.25), ("c", "low01::risk", "text", 0.1, None, None)], "changeset_id string, question string, type string, noul double, score double, confidence double")
    told = {r["id"]: [e["summary"] for e in r["evidence"]] for r in dicts(judge.apply_answers(items, answers))}
    assert told["low01"] == [] and told["crit"][-2:] == ["Judge P(risky)=0.50", f"Judge severity 1.6 ({judge.LEVELS[2]}, confidence 0.25)"]


def test_judges_tell_how_they_fared(spark):
    class Broken:
        name = "broken"

        def apply(self, items):
            raise RuntimeError("no answer")

    items = items_frame(spark, [{"id": "a"}])
    status = lambda *a, **k: dicts(judge.enrich(*a, **k)[1])[0]
    assert status(judge.LocalJudge(), items)["status"] == "Applied" and status(judge.LocalJudge(), items, has_key=False)["status"] == "SkippedNoKey"
    assert status(judge.LocalJudge(), items.where("false"))["status"] == "SkippedNoItems"
    assert status(Broken(), items) == {"judge": "broken", "status": "Failed", "detail": "no answer"}
    assert dicts(judge.enrich(Broken(), items)[0]) == dicts(items)


def test_renderers(spark):
    items = items_frame(spark, [{"id": "b", "title": "a <b>, 50%", "why": "x\ny", "evidence": [("k", "s")]}, {"id": "a", "severity": "Low"}, {"id": "m", "category": "Mechanical", "severity": "Low"}])
    notes = [r["annotation"] for r in dicts(render.github_annotations(items), "pos")]
    assert notes == ["::error file=src/a.rs,title=High a <b>%2C 50%25::x y | evidence: s", "::notice file=src/a.rs,title=Low title a::w"]
    (suite,) = dicts(render.junit(items, "High"))
    assert 'tests="3" failures="1" skipped="1"' in suite["junit"] and "a &lt;b&gt;" in suite["junit"] and suite["junit"].index("title a") < suite["junit"].index("a &lt;b")
    stats = spark.createDataFrame([("c", 1, 2, 3, 0, 2)], "changeset_id string, files_changed long, added_lines long, deleted_lines long, mechanical_files long, meaningful_changes long")
    (whole,) = dicts(render.overview(items, stats))
    assert whole["overview"].startswith("HEAD → worktree\n1 files · +2 −3 · 2 meaningful · 0 mechanical\n\n1. [High] a <b>, 50% (priority 50, 80% confidence)\n    x\ny\n")
    assert whole["overview"].endswith("Mechanical (collapsed): 1 item(s)\n  - title m\n")
    with pytest.raises(ValueError, match="unknown format"):
        render.rendered(items, "pdf")


def test_coverage(spark):
    items = items_frame(spark, [{"id": "file:lib/silo.rs", "files": ["lib/silo.rs"], "symbols": ["Silo::fill"]}, {"id": "file:src/x.rs", "files": ["src/x.rs"], "symbols": ["lost"]}, {"id": "file:d.md", "files": ["d.md"], "symbols": ["q"], "category": "Docs"}])
    changed = spark.createDataFrame([("c", "lib/silo.rs", "Silo::fill", "Function", False), ("c", "src/x.rs", "lost", "Function", False), ("c", "t.rs", "test_fill", "Test", True)], "changeset_id string, file string, name string, kind string, is_test_file boolean")
    tests = spark.createDataFrame([("c", "test_fill", "tests/a.rs", []), ("c", "t2", "tests/b.rs", ["fill"]), ("c", "test_other", "tests/b.rs", ["z"])], "changeset_id string, name string, file string, calls array<string>")
    got = {r["id"]: r for r in dicts(context.apply_coverage(items, context.coverage_links(changed, tests), tests))}
    assert got["file:lib/silo.rs"]["evidence"][0]["summary"] == "covered by t2 (tests/b.rs), test_fill (tests/a.rs)"
    assert got["file:src/x.rs"]["evidence"][0]["kind"] == "untested-change" and got["file:src/x.rs"]["why"].endswith("No covering tests reference these symbols.")
    assert got["file:d.md"]["evidence"] == []
    none = tests.where("false")
    assert all(r["evidence"] == [] for r in dicts(context.apply_coverage(items, context.coverage_links(changed, none), none)))


def test_blast_radius(spark):
    items = items_frame(spark, [{"id": "file:lib/silo.rs", "files": ["lib/silo.rs"], "symbols": ["fill", "helper"]}])
    sources = spark.createDataFrame([("lib/wagon.rs", ["fill"], ["fill"]), ("src/other.rs", ["helper"], []), ("lib/importer.rs", ["helper"], ["helper"]), ("tests/t.rs", ["fill"], ["fill"]), ("lib/silo.rs", ["fill"], ["fill"])], "path string, calls array<string>, imports array<string>")
    definitions = spark.createDataFrame([("fill", "lib/silo.rs"), ("fill", "lib/silo.rs"), ("helper", "lib/silo.rs"), ("helper", "src/util.rs")], "name string, file string")
    (got,) = dicts(context.apply_blast_radius(items, sources, definitions))
    assert [e["summary"] for e in got["evidence"]] == ["referenced by 2 files: lib/importer.rs, lib/wagon.rs"]


def test_task_checks(spark):
    changes = spark.createDataFrame([("c", "lib/barn/silo.rs", "silo_capacity", "fn silo_capacity()", None)], "changeset_id string, file string, name string, new_signature string, old_signature string")
    files = spark.createDataFrame([("c", "lib/barn/silo.rs", ['let s = "zebra";', "load_wagon(x); // giraffe"])], "changeset_id string, path string, added array<string>")
    items = items_frame(spark, [{"id": "silo-1", "title": "silo capacity", "files": ["lib/barn/silo.rs"], "why": ""}])
    corpus = task.change_corpus(changes, files, items)
    texts = ["extend silo capacity", "rebuild tractor zebra", "silo capacity giraffe", "the and a", "silos capcity", "load wagon"]
    tasks = spark.createDataFrame([("c", i, t) for i, t in enumerate(texts)], "changeset_id string, task_id int, task_text string")
    got = dicts(task.check_tasks(tasks, corpus, ("changeset_id",)), "task_id")
    assert [r["verdict"] for r in got] == ["Partial", "Uncovered", "Partial", "Uncovered", "Covered", "Covered"]
    assert got[2]["unmatched"] == ["giraffe"] and got[3]["terms"] == 0 and got[0]["matched_terms"][0]["via"] == "symbol silo_capacity"
    matched = task.check_tasks(tasks, corpus, ("changeset_id",)).select("changeset_id", "task_id", F.explode("matched_terms").alias("m")).select("changeset_id", "task_id", "m.term_idx", "m.term")
    hits = dicts(task.item_hits(tasks.drop("changeset_id"), matched, items, files), "task_id", "rank")
    assert {(h["task_id"], h["id"]) for h in hits} == {(0, "silo-1"), (2, "silo-1"), (4, "silo-1"), (5, "silo-1")}
    section = dicts(task.task_section(task.check_tasks(tasks, corpus, ("changeset_id",))), "task_id")[2]["task_section"]
    assert section.startswith("\nTask check [Partial] — 67% (2 of 3 terms)\n  task: silo capacity giraffe\n") and "missing: giraffe" in section


PY = "MAX_CRATES = 12\nrows = 3\n\nclass Orchard:\n    def prune(self, tree):\n        tree.cut()\n        return tree\n\n    def _count(self):\n        return MAX_CRATES\n\ndef water(rows):\n    pass\n"
GO = "package barn\n\ntype Silo struct {\n    Level int\n}\n\nfunc fill(amount int) int {\n    return amount + 1\n}\n\nfunc (b *Barn[K]) open() {\n}\n\nfunc TestFill(t *testing.T) {}\n"
CS = "public class Silo {\n    private int _level;\n    public double Volume { get; set; }\n    public Silo(int level) { _level = level; }\n    public void Fill(int amount) {\n        _level += amount;\n    }\n    [Theory]\n    public void Fill_adds() { }\n}\n"
TS = "export const mix = (a: number) => { return a * 2; }\nexport abstract class Silo {\n  fill() { return 1; }\n}\ntype Grain = number;\nnamespace Farm {\n  export function sow() { return 0; }\n}\n"
RS = "const ROWS: usize = 4;\n\npub fn harvest(field: &Field) -> Crop {\n    field.cut()\n}\nimpl Barn<T> {\n    fn open(&self) {}\n}\n#[cfg(test)]\nmod checks {\n    #[test]\n    fn opens() {}\n}\ntype Bale =\n    u16;\n"


def test_scanners():
    names = lambda lang, s: {r[0]: r[1:4] for r in scanners.scan(lang, s)}
    assert names("Python", PY) == {"MAX_CRATES": ("Const", 1, 1), "rows": ("Const", 2, 2), "Orchard": ("Class", 4, 10), "Orchard::prune": ("Method", 5, 7), "Orchard::_count": ("Method", 9, 10), "water": ("Function", 12, 13)}
    assert names("Go", GO) == {"Silo": ("Struct", 3, 5), "fill": ("Function", 7, 9), "Barn::open": ("Method", 11, 12), "TestFill": ("Test", 14, 14)}
    assert {k: v[0] for k, v in names("CSharp", CS).items()} == {"Silo": "Class", "Silo::_level": "Field", "Silo::Volume": "Field", "Silo::new": "Method", "Silo::Fill": "Method", "Silo::Fill_adds": "Test"}
    assert {k: v[0] for k, v in names("TypeScript", TS).items()} == {"mix": "Const", "Silo": "Class", "Silo::fill": "Method", "Grain": "TypeAlias", "Farm": "Module", "sow": "Function"}
    rust = {r[0]: r for r in scanners.scan("Rust", RS)}
    assert rust["harvest"][1:7] == ("Function", 3, 5, "fn harvest(field : & Field) -> Crop", False, True) and rust["opens"][1] == "Test" and rust["Bale"][4] == "type Bale = u16" and "Barn<T>::open" in rust
    assert scanners.scan("Python", "def (") == [] and scanners.scan("Rust", "fn a() {") is None


def test_extraction_falls_back_and_parses_once(spark):
    rows = [("a.py", PY), ("copy.py", PY), ("bad.py", "def broken(\nasync def fetch():\n"), ("x.txt", "public int f(int a) {\nusing (x) {\nlock (y) {\n"), ("a_test.go", "package a\n\nfunc setup() {}\n")]
    got = dicts(extract.extract_symbols(spark.createDataFrame(rows, "file string, content string")), "file", "sym_idx")
    by = {}
    for r in got:
        by.setdefault(r["file"], []).append(r["name"])
    assert by["a.py"] == by["copy.py"] and by["bad.py"] == ["broken", "fetch"] and by["x.txt"] == ["f"]
    assert next(r for r in got if r["file"] == "a_test.go")["is_test"]


def test_cache(spark, tmp_path, monkeypatch):
    sources = cache.keyed(spark.createDataFrame([("rust", "a"), ("rust", "b"), ("go", "a")], "language string, content string"))
    entries = sources.limit(3).select(F.lit(cache.VERSION).alias("version"), "content_key", F.array().cast(f"array<{cache.SYMBOL_STRUCT}>").alias("symbols"))
    path = str(tmp_path / "cache")
    assert cache.load(spark, path).count() == 0 and cache.load(spark, None).count() == 0
    cache.save(entries, path)
    assert cache.load(spark, path).count() == 3 and cache.load(spark, path, most=2).count() == 2
    held = cache.load(spark, path)
    cache.save(entries.limit(1), path)
    assert cache.load(spark, path).count() == 1 and held.count() == 3  # who reads the table before it still can
    cache.save(entries.limit(2), path)
    assert len([p for p in (tmp_path / "cache").iterdir() if p.is_dir()]) == 2
    (tmp_path / "cache" / "current").write_text("table-gone")
    assert cache.load(spark, path).count() == 0
    cache.save(entries.limit(1), path)
    assert dicts(cache.metrics(sources, cache.load(spark, path)))[0]["hits"] == 1
    assert cache.evict(spark.range(16).select(F.col("id").cast("string").alias("content_key")), 16).count() == 14
    monkeypatch.setenv("XDG_CACHE_HOME", "/x")
    assert cache.default_path() == "/x/tidemark/symbols"
    monkeypatch.delenv("XDG_CACHE_HOME")
    monkeypatch.setenv("HOME", "/home/u")
    assert cache.default_path() == "/home/u/.cache/tidemark/symbols"
    monkeypatch.delenv("HOME")
    assert cache.default_path() is None


def test_cached_extraction_parses_misses_only(spark, monkeypatch):
    rows = [("a.py", PY), ("copy.py", PY), ("b.go", GO), ("b_test.go", GO), ("c.rs", RS), ("none.rs", "// nothing\n"), ("bad.py", "def broken(\n")]
    sources = spark.createDataFrame(rows, "file string, content string")
    plain = dicts(extract.extract_symbols(sources), "file", "sym_idx")
    found, entries = extract.extract_cached(sources.where("file IN ('copy.py', 'none.rs', 'bad.py')"), cache.load(spark, None))
    entries = spark.createDataFrame(entries.collect(), entries.schema)
    assert entries.count() == 3
    parsed = []
    monkeypatch.setattr(extract, "_parsed", lambda distinct, of=extract._parsed: parsed.extend(r["content"] for r in distinct.collect()) or of(distinct))
    again, every = extract.extract_cached(sources, entries)
    assert dicts(again, "file", "sym_idx") == plain
    assert sorted(parsed) == sorted([GO, RS]) and every.count() == 5


def test_views(spark):
    line = "struct<kind:string,text:string>"
    df = spark.createDataFrame([("c", 0, "a.rs", [("@@", [("Context", "x"), ("Addition", "y")])]), ("c", 1, "b.rs", [])], f"changeset_id string, file_idx long, path string, hunks array<struct<header:string,lines:array<{line}>>>")
    rows = dicts(views.diff_rows(df), "row")
    assert [(r["level"], r["text"]) for r in rows] == [("file", "a.rs"), ("hunk", "@@"), ("line", "x"), ("line", "y"), ("file", "b.rs")]
    detail = dicts(views.item_detail(items_frame(spark, [{"id": "i", "files": ["a.rs"]}]), df))
    assert [(r["kind"], r["text"]) for r in detail] == [("Addition", "y")]
    assert rank.in_range(views.diff_rows(df), "row", 2, 3).count() == 2


def test_literal_arrays(spark):
    assert dicts(spark.range(1).select(lit_array([]).alias("x"))) == [{"x": []}]


def test_reviews_with_a_cache_are_the_same(spark, tmp_path):
    from tidemark.plans.review import review_changes
    from tidemark.sources import linediff

    rows = [("c", 0, "src/barn.rs", "Modified", False, RS, RS.replace("field.cut()", "field.mow()")), ("c", 1, "lib/silo.py", "Modified", False, PY, PY.replace("prune", "trim")), ("c", 2, "lib/copy.py", "Added", False, None, PY)]
    changes = linediff.with_hunks(spark.createDataFrame(rows, "changeset_id string, file_idx long, path string, status string, is_binary boolean, old_content string, new_content string"))
    shown = lambda made: [dicts(made.changes, "file", "name", "change"), dicts(made.items, "pos"), dicts(made.stats)]
    plain, path = shown(review_changes(changes)), str(tmp_path / "cache")
    assert shown(review_changes(changes, cache_path=path)) == plain
    assert cache.load(spark, path).count() == 4
    assert shown(review_changes(changes, cache_path=path)) == plain


def test_changeset_json_with_a_task(spark):
    items = items_frame(spark, [{"id": "a"}])
    stats = spark.createDataFrame([("c", 1, 2, 3), ("d", 0, 0, 0)], "changeset_id string, files_changed long, added_lines long, deleted_lines long")
    files = spark.createDataFrame([("c", 0, "x.rs")], "changeset_id string, file_idx long, path string")
    from tidemark.operators import symbols as sym

    tasks = spark.createDataFrame([("c", "do", "Partial", 0.5, ["a"], ["b"])], "changeset_id string, task_text string, verdict string, coverage double, matched_terms array<string>, unmatched array<string>")
    made = {r["changeset_id"]: json.loads(r["json"]) for r in render.changeset_json(files, spark.createDataFrame([], sym.CHANGE), items, stats, tasks=tasks).collect()}
    assert made["c"]["task_check"]["verdict"] == "Partial" and "task_check" not in made["d"]
    assert made["d"]["review_items"] == [] and made["c"]["files"] == [{"file_idx": 0, "path": "x.rs"}]
    assert [i["id"] for i in made["c"]["review_items"]] == ["a"] and made["c"]["review_items"][0]["evidence"] == []


def test_fuzzy_matches_against_plain_python(spark):
    """Terms against tokens by brute force; of equal scores the first in the corpus counts."""
    import random

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randrange(2, 11)))
    tokens, terms = [(word(), k) for k in range(400)], sorted({word() for _ in range(120)})
    first = {}
    for t, k in tokens:
        first.setdefault(t, k)

    def score(a, b):
        grams = lambda s: [s[i : i + 2] for i in range(len(s) - 1)] or [s]
        x, y, left, hits = grams(a), grams(b), grams(b), 0
        for g in x:
            if g in left:
                left.remove(g)
                hits += 1
        if a == b:
            return 1.0
        if (a in b or b in a) and min(len(a), len(b)) >= 4:
            return 0.8
        return 2 * hits / (len(x) + len(y)) if 10 * 2 * hits >= 6 * (len(x) + len(y)) else 0.0

    expected = {}
    for t in terms:
        best = (1.0, -first[t], t) if t in first else max(((score(t, x), -k, x) for x, k in first.items()), key=lambda s: s[:2])
        if best[0] > 0:
            expected[t] = (round(best[0], 9), f"v{-best[1]}")
    corpus = spark.createDataFrame([(t, f"v{k}", k) for t, k in first.items()], "token string, via string, ord int")
    got = {r["term"]: (round(r["score"], 9), r["via"]) for r in task.match_terms(spark.createDataFrame([(t,) for t in terms], "term string"), corpus).collect() if r["score"] > 0}
    assert got == expected


def test_review_of_code_reads_every_part(spark, tmp_path, monkeypatch):
    spark.range(1, 31).withColumnRenamed("id", "p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    read, scan = [], queries.repository.scan
    monkeypatch.setattr(queries.repository, "scan", lambda files, **k: read.extend(r["path"] for r in files.select("path").collect()) or scan(files, **k))
    made = queries.review_of_code(spark, str(tmp_path))
    assert {int(p.split(".")[0][5:]) for p in read} == {k for k in range(1, 31) if k % 3}
    assert made.count() > 0


def test_task_item_hits_of_every_change_set(spark, tmp_path):
    docs = [(i, f"quarterly{i} ledger{i} text", lang, "s", 30) for i, lang in enumerate(["en", "es", "de", "fr"] * 3)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "quarterly ledger text src")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = {r["changeset_id"] for r in queries.task_item_hits(spark, str(tmp_path)).collect()}
    assert found == {"en", "es", "de", "fr"}


def test_matching_pairs_with_repeated_bigrams_against_all_pairs(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abä") for _ in range(rng.randrange(2, 14)))
    terms, tokens = {word() for _ in range(40)} | {"aaaaaa"}, {word() for _ in range(150)} | {"aaaaaaa", "aaaab"}
    wanted = spark.createDataFrame([(k, t) for k in "xy" for t in sorted(terms)], "changeset_id string, term string")
    corpus = spark.createDataFrame([("x", t) for t in sorted(tokens)], "changeset_id string, token string").withColumn("via", F.lit("v")).withColumn("ord", F.lit(1))
    every = wanted.join(corpus, "changeset_id").withColumn("score", text.match_score(F.col("term"), F.col("token"))).where("score > 0")
    keys = ["changeset_id", "term", "token"]
    assert sorted(map(tuple, task.matching_pairs(wanted, corpus, ("changeset_id",)).select(*keys).collect())) == sorted(map(tuple, every.select(*keys).collect()))
