import itertools
import random
import re

import pytest
from helpers import dicts, one_column
from pyspark.sql import functions as F
from tidemark.functions import paths, text
from tidemark.schemas import parse_severity, parse_verdict


def test_split_ident(spark):
    got = one_column(spark, ["siloCapacity", "SILO_CAPACITY", "hay-bale", "XMLReader x", "ÉtéLong ab1", ""], text.split_ident)
    assert got == [["silo", "capacity"], ["silo", "capacity"], ["hay", "bale"], ["xml", "reader"], ["été", "long", "ab1"], []]


def test_task_terms(spark):
    got = one_column(spark, ["enlarge silo capacity", "by from this", "Update the siloCapacity, update silo", "é ab abc"], text.task_terms)
    assert got == [["enlarge", "silo", "capacity"], [], ["silo", "capacity"], ["abc"]]


def test_match_scores(spark):
    pairs = [("harvester", "er", 0.0), ("capacity", "ca", 0.0), ("capacity", "capacity", 1.0), ("harvest", "harvests", 0.8)]
    rows = spark.createDataFrame([p[:2] for p in pairs], "a string, b string")
    assert [r[0] for r in rows.select(text.match_score(F.col("a"), F.col("b"))).collect()] == [p[2] for p in pairs]
    (typo,) = spark.createDataFrame([("capcity", "capacity")], "a string, b string").select(text.match_score(F.col("a"), F.col("b"))).collect()
    assert 0.6 <= typo[0] < 1


def test_dice_against_plain_python(spark):
    rng = random.Random(4)
    pairs = [("".join(rng.choice("abé") for _ in range(rng.randrange(9))), "".join(rng.choice("abé") for _ in range(rng.randrange(9)))) for _ in range(300)]

    def grams(s):
        return [s[i : i + 2] for i in range(len(s) - 1)] or [s]

    def shared(a, b):
        left = grams(b)
        hits = 0
        for g in grams(a):
            if g in left:
                left.remove(g)
                hits += 1
        return hits

    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = [r[0] for r in rows.orderBy("i").select(text.shared_bigrams(text.bigrams(F.col("a")), text.bigrams(F.col("b")))).collect()]
    assert got == [shared(a, b) for a, b in pairs]


def test_lines_like_text_lines(spark):
    values = ["", "a", "a\n", "a\r\nb", "a\n\n", "\n", "a\rb\n"]
    assert one_column(spark, values, text.lines) == [[], ["a"], ["a"], ["a", "b"], ["a", ""], [""], ["a\rb"]]


def test_strip_code(spark):
    values = ['let s = "a // b"; x', "call(); // note", 'r#"raw " text"# y', '"open', 'a "q\\"r" b', "http://x"]
    assert one_column(spark, values, text.strip_code) == ["let s = ; x", "call(); ", " y", "", "a  b", "http:"]
    assert one_column(spark, ["x" * 400, 'y"' + "z" * 400], lambda s: F.length(text.clean_line(s))) == [300, 1]


def test_called_names(spark):
    body = 'while (a) { mow(x); self.bind_all(y) } // gone()\nlet s = "no()"; hay"x"(1); _(2); print(3); démo(4)'
    assert one_column(spark, [body, ""], text.called_names) == [["bind_all", "démo", "mow"], []]


def test_imported_names(spark):
    samples = [
        ("Rust", "use crate::barn::{load, Wagon};\npub(crate) use super::hay::*;\nlet x = 1;"), ("Go", 'package a\nimport (\n  "io"\n  txt "bytes"\n)\nfunc f() {}\nimport "net"'),
        ("CSharp", "using Farm.Grain;\nusing (var x = y) {}\nclass A {}"), ("TypeScript", 'import { load as fill } from "./barn";\nconst silo = require("silo");\nlet y = 2;'),
        ("Python", "import json, math as numbers\nfrom barn import load\nx = 1"), ("Java", "import java.util.Map;"),
    ]

    got = {r["language"]: r["x"] for r in spark.createDataFrame(samples, "language string, content string").select("language", text.imported_names(F.col("language"), F.col("content")).alias("x")).collect()}
    assert got == {
        "Rust": ["Wagon", "barn", "hay", "load"], "Go": ["bytes", "io", "net", "txt"], "CSharp": ["Farm", "Grain"],
        "TypeScript": ["barn", "fill", "load", "silo"], "Python": ["barn", "json", "load", "math", "numbers"], "Java": [],
    }


@pytest.mark.parametrize(("test", "symbol", "hit"), [("test_fill", "fill", True), ("should_fill", "FILL", True), ("fill_test", "fill", True), ("testFill", "fill", True), ("TestFill", "Fill", True), ("FillTest", "fill", True), ("fill", "Fill", True), ("testfill", "fill", False), ("Test", "", False)])
def test_targets(spark, test, symbol, hit):
    assert one_column(spark, [test], lambda s: text.test_targets(s, F.lit(symbol))) == [hit]


def test_escapes_and_cuts(spark):
    assert one_column(spark, ["50% a:b,\n c"], text.escape_github_prop) == ["50%25 a%3Ab%2C c"]
    assert one_column(spark, ["<a & 'b' \"c\">"], text.escape_xml) == ["&lt;a &amp; &apos;b&apos; &quot;c&quot;&gt;"]
    assert one_column(spark, ["it's"], text.shell_quote) == ["'it'\\''s'"]
    assert one_column(spark, ["abcdef", "abc"], lambda s: text.truncate(s, 3)) == ["abc…", "abc"]
    assert one_column(spark, ["", "abcde"], text.approx_tokens) == [0, 2]
    assert one_column(spark, [" a  \t b\u00a0\n"], text.single_line) == ["a b"]


def test_names_and_bodies(spark):
    assert one_column(spark, ["A::b::c → D::e"], lambda s: text.short_name(text.new_name(s))) == ["e"]
    rows = F.array(F.lit("fn a() {"), F.lit("  x"), F.lit("}"))
    assert one_column(spark, ["x"], lambda s: text.body_slice(rows, F.lit(2), F.lit(9))) == ["  x\n}"]
    assert one_column(spark, ["fn a() {\n  x y\n}", "one"], text.nosig_key) == ["xy}", ""]


def test_paths(spark):
    yes = ["tests/barn.rs", "a/test/silo.rs", "Tests/unit/hay.py", "lib/silo_test.go", "lib/silo.test.ts", "lib/silo.spec.js", "test_silo.py", "test-silo.rs"]
    no = ["lib/testers/a.rs", "testbed/b.json", "lib/attest_all.rs", "lib/greatest_rows.rs", "lib/hightest/c.rs", "lib/detest.rs"]
    assert one_column(spark, yes + no, paths.is_test_path) == [True] * 8 + [False] * 6
    assert one_column(spark, ["a.RS", "b.tsx", "c.h", "d.cxx", "e.txt"], paths.language_of) == ["Rust", "TypeScript", "C", "Cpp", "Unknown"]
    assert one_column(spark, ["Cargo.lock", "target/x.rs", "a/target.rs", "x.pb.go", "src/a.rs"], paths.generated_by_name) == [True, True, False, True, False]
    assert one_column(spark, ["// @generated\nx", "1\n2\n3\n4\n5\n// auto-generated", "# Do not edit: generated"], lambda s: paths.generated_by_content(F.lit(None).cast("string"), s)) == [True, False, True]
    assert one_column(spark, ["R100", "A", "X"], paths.status_of) == ["Renamed", "Added", "Modified"]


def test_formatting_only(spark):
    cases = [("Rust", "a();\nb();", "b();\na();", False), ("Python", "if x:\n    y()", "if x:\ny()", False), ("Rust", 'f("a b")', 'f("ab")', False), ("Rust", "let bale", "letbale", False), ("Rust", "    mow();", "        mow();", True), ("Rust", None, "        mow();", False), ("Unknown", "    mow();", "        mow();", False), ("Go", "    mow();", "  mow();", False)]
    rows = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, l string, o string, n string")
    flag = paths.formatting_only(F.col("l"), F.lit("Modified"), F.lit(False), F.lit(1), F.col("o"), F.col("n"))
    assert [r[0] for r in rows.orderBy("i").select(flag).collect()] == [c[3] for c in cases]


def test_levels(spark):
    assert one_column(spark, ["MED", "crit", "Low", None], parse_severity) == ["Medium", "Critical", "Low", None]
    assert one_column(spark, ["cover", "UNCOVER"], parse_verdict) == ["Covered", "Uncovered"]
    with pytest.raises(Exception, match="invalid severity"):
        one_column(spark, ["grave"], parse_severity)


def test_content_key(spark):
    import hashlib

    got = dicts(spark.createDataFrame([("rust", "x\n")], "t string, c string").select(text.content_key(F.col("t"), F.col("c")).alias("k")))
    assert got == [{"k": hashlib.sha256(b"rust\0x\n").hexdigest()}]


def test_word_lists_are_plain():
    assert len(text.CALL_KEYWORDS) == 56 and len(text.STOPWORDS) == len(set(text.STOPWORDS))
    assert all(re.fullmatch(r"\w+", w) for w in text.CALL_KEYWORDS + text.STOPWORDS)


def test_lines_at_all_line_ends(spark):
    values = [*("".join(p) for n in range(5) for p in itertools.product("a\r\n", repeat=n)), "ä\nö\n", "x y\n", None]

    def plain(s):
        return None if s is None else [] if s == "" else re.split(r"\r?\n", re.sub(r"\r?\n\Z", "", s))

    assert one_column(spark, values, text.lines) == [plain(v) for v in values]
