"""Predicates and derived columns of changed files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import lines

# File name suffixes by language, in the order in which they are tried.
SUFFIXES = (
    ("Rust", (".rs",)),
    ("TypeScript", (".ts", ".tsx", ".mts", ".cts")),
    ("JavaScript", (".js", ".jsx", ".mjs", ".cjs")),
    ("Python", (".py", ".pyi")),
    ("CSharp", (".cs",)),
    ("Go", (".go",)),
    ("Java", (".java",)),
    ("C", (".c", ".h")),
    ("Cpp", (".cpp", ".cc", ".hpp", ".cxx")),
)
# Lock files, bundles, output folders and generated-code suffixes.
GENERATED_SUFFIXES = (
    "cargo.lock package-lock.json yarn.lock pnpm-lock.yaml poetry.lock pipfile.lock .min.js .min.css .map .bundle.js .pb.go .generated.ts .g.cs .designer.cs .lock"
).split()
GENERATED_DIRS = "target node_modules dist build .next vendor __pycache__ .git".split()

MAX_PARSE_BYTES = 512 * 1024


def ends_with_any(s: Column, suffixes) -> Column:
    found = F.lit(False)
    for x in suffixes:
        found = found | F.endswith(s, F.lit(x))
    return found


def contains_any(s: Column, parts) -> Column:
    found = F.lit(False)
    for x in parts:
        found = found | F.contains(s, F.lit(x))
    return found


def language_of(path: Column) -> Column:
    low, found = F.lower(path), None
    for name, suffixes in SUFFIXES:
        hit = ends_with_any(low, suffixes)
        found = F.when(hit, name) if found is None else found.when(hit, name)
    return found.otherwise("Unknown")


def supports_symbols(language: Column) -> Column:
    return language != "Unknown"


def display_path(old_path: Column, new_path: Column) -> Column:
    return F.coalesce(F.nullif(new_path, F.lit("")), old_path)


def status_of(delta: Column) -> Column:
    """Status of a one-letter git delta; letters without one mean Modified."""
    names = {"A": "Added", "D": "Deleted", "R": "Renamed", "C": "Copied", "T": "TypeChanged", "?": "Untracked"}
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.substring(delta, 1, 1)), F.lit("Modified"))


def is_test_path(path: Column) -> Column:
    parts = F.split(F.lower(path), "/")
    name = F.element_at(parts, -1)
    return F.arrays_overlap(parts, F.array(F.lit("test"), F.lit("tests"))) | name.rlike(r"^(test_|test-)|_test\.|\.test\.|\.spec\.")


def generated_by_name(path: Column) -> Column:
    low = F.lower(path)
    return ends_with_any(low, GENERATED_SUFFIXES) | F.arrays_overlap(F.split(low, "/"), F.array(*map(F.lit, GENERATED_DIRS)))


def generated_by_content(old: Column, new: Column) -> Column:
    """Whether one of the first five lines of either side says so."""

    def says(line: Column) -> Column:
        low = F.lower(line)
        return contains_any(low, ["auto-generated", "autogenerated", "@generated"]) | (F.contains(low, F.lit("do not edit")) & F.contains(low, F.lit("generat")))

    def one(side: Column) -> Column:
        head = F.substring_index(side, "\n", 5)
        named = F.contains(F.lower(head), F.lit("generat"))  # which all of these need; so few texts are split
        return F.coalesce(F.when(named, F.exists(lines(head), says)), F.lit(False))

    return one(old) | one(new)


def formatting_only(language: Column, status: Column, is_binary: Column, hunks: Column, old: Column, new: Column) -> Column:
    """Modified Rust text without quotes, slashes and backslashes whose lines differ in leading blanks only."""
    bare = lambda s: F.regexp_replace(s, r"(?md)^[ \t]+", "")
    plain = ~old.rlike(r"[\"'/\\]") & ~new.rlike(r"[\"'/\\]")
    test = (language == "Rust") & (status == "Modified") & ~is_binary & (hunks > 0) & (old != new) & plain & (bare(old) == bare(new))
    return F.coalesce(test, F.lit(False))


def skip_parse(is_binary: Column, is_generated: Column, old: Column, new: Column) -> Column:
    large = lambda s: F.coalesce(F.octet_length(s) > MAX_PARSE_BYTES, F.lit(False))
    return is_binary | is_generated | large(old) | large(new)


def path_parts(path: Column) -> Column:
    return F.split(F.lower(path), "[/._-]")


def has_part(path: Column, words) -> Column:
    """Whether a word is a whole part of the path; words with a hyphen or slash may stand anywhere."""
    whole = [w for w in words if "-" not in w and "/" not in w]
    anywhere = [w for w in words if w not in whole]
    return F.arrays_overlap(path_parts(path), F.array(*map(F.lit, whole))) | contains_any(F.lower(path), anywhere)
