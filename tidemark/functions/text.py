"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of a task description that carry no signal.
STOPWORDS = (
    "a an the and or but of to in on for with by at from as is are was were be been it its this that these those should would could must need needs "
    "add adds added adding fix fixes fixed fixing update updates updated updating make makes use uses used using new also just please implement"
).split()

# Names before a parenthesis that are not calls.
CALL_KEYWORDS = (
    "if else for while loop match return use mod fn struct enum impl trait const static let mut ref move where async await crate self Self super extern macro "
    "function class extends new typeof instanceof in of do switch case try catch finally throw def lambda import from with as assert sizeof true false print println"
).split()

# Kinds of evidence that an escalation names first.
EVIDENCE_PRIORITY = "secret-handling unsafe validation-removed untested-change blast-radius auth-surface symbol-removed schema".split()

IDENT = r"[\p{IsAlphabetic}\p{N}_]+"


def trim_all(s: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def single_line(s: Column) -> Column:
    return trim_all(F.regexp_replace(s, r"(?U)\s+", " "))


def truncate(s: Column, most: int) -> Column:
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most), F.lit("…"))).otherwise(s)


def approx_tokens(s: Column) -> Column:
    return F.ceil(F.length(s) / 4).cast("int")


def lines(s: Column) -> Column:
    """Lines of a text: one line end at its end is dropped, and so is a carriage return before a line end."""
    split = F.split(F.regexp_replace(s, r"\r?\n\z", ""), r"\r?\n", -1)
    # without a carriage return a single character splits, which takes no regular expression
    plain = F.split(F.when(F.endswith(s, F.lit("\n")), F.left(s, F.length(s) - 1)).otherwise(s), "\n", -1)
    return F.when(s == "", F.array().cast("array<string>")).when(F.contains(s, F.lit("\r")), split).otherwise(plain)


def split_ident(s: Column) -> Column:
    """Lower-cased parts of identifiers: at non-letters, at case changes, before the last capital of an acronym; parts of one byte are dropped."""
    spaced = F.regexp_replace(s, r"[^\p{IsAlphabetic}\p{N}]+", " ")
    spaced = F.regexp_replace(spaced, r"(?<=\p{IsLowercase})(?=\p{IsUppercase})|(?<=\p{IsUppercase})(?=\p{IsUppercase}\p{IsLowercase})", " ")
    return F.transform(F.filter(F.split(spaced, " "), lambda x: F.octet_length(x) >= 2), F.lower)


def task_terms(s: Column) -> Column:
    """Terms of a task: identifier parts of three bytes or more that are no stop words, each once, in order."""
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.array_distinct(F.filter(split_ident(s), lambda x: (F.octet_length(x) >= 3) & ~F.array_contains(stop, x)))


def bigrams(s: Column) -> Column:
    """Two-character pieces of a string; a shorter string is its own piece."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 1, F.lit(1))), lambda k: F.substr(s, k, F.lit(2)))


def shared_bigrams(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    count = lambda xs, g: F.size(F.filter(xs, lambda x: x == g))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda n, g: n + F.least(count(a, g), count(b, g)))


def gram_count(s: Column) -> Column:
    return F.greatest(F.length(s) - 1, F.lit(1))


def dice_possible(a: Column, b: Column) -> Column:
    """Whether two strings' lengths allow a Dice coefficient of 0.6 at all."""
    x, y = gram_count(a), gram_count(b)
    return 20 * F.least(x, y) >= 6 * (x + y)


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of two strings' bigram multisets."""
    return 2 * shared_bigrams(bigrams(a), bigrams(b)) / (gram_count(a) + gram_count(b))


def match_score(term: Column, token: Column) -> Column:
    """1 for equal strings, 0.8 for one within the other if both have four bytes, else their Dice coefficient from 0.6 up, else 0."""
    inside = (F.contains(token, term) | F.contains(term, token)) & (F.octet_length(term) >= 4) & (F.octet_length(token) >= 4)
    hits, total = shared_bigrams(bigrams(term), bigrams(token)), gram_count(term) + gram_count(token)
    fuzzy = F.when(20 * hits >= 6 * total, 2 * hits / total).otherwise(0.0)
    return F.when(term == token, 1.0).when(inside, 0.8).when(~dice_possible(term, token), 0.0).otherwise(fuzzy)


def name_similarity(a: Column, b: Column) -> Column:
    """Dice coefficient of two names without regard to case."""
    return F.when(a == b, 1.0).otherwise(dice(F.lower(a), F.lower(b)))


def strip_code(s: Column) -> Column:
    """One line of code without string literals, raw strings and a line comment."""
    bare = F.regexp_replace(s, r"""(?s)//.*$|r(#*)"(?:.*?"\1|.*$)|"(?:\\.|[^"\\])*(?:"|\\?$)""", "")
    return F.when(F.contains(s, F.lit('"')) | F.contains(s, F.lit("//")), bare).otherwise(s)


def clean_line(s: Column) -> Column:
    """A line for its words: at most 300 characters, and stripped, if it is long or may hold literals."""
    plain = (F.octet_length(s) <= 300) & ~F.contains(s, F.lit('"')) & ~F.contains(s, F.lit("//"))
    return F.when(plain, s).otherwise(strip_code(F.substring(s, 1, 300)))


def ident_list(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit(f"({IDENT})"), 1)


def called_names(body: Column) -> Column:
    """Names right before a parenthesis, outside strings and line comments, sorted, each once."""
    masked = F.regexp_replace(body, r"""(?s)"(?:\\.|[^"\\])*(?:"|\\?\z)|//[^\n]*""", "\x01")
    found = F.regexp_extract_all(masked, F.lit(rf"(?<![\p{{IsAlphabetic}}\p{{N}}_])([\p{{IsAlphabetic}}_][\p{{IsAlphabetic}}\p{{N}}_]*)(?=\()"), 1)
    return F.array_sort(F.array_except(found, F.array(*map(F.lit, [*CALL_KEYWORDS, "_"]))))


def imported_names(language: Column, content: Column) -> Column:
    """Identifiers of a source's import lines, sorted, each once.

    Go's import blocks last from a line that opens one to a closing parenthesis on its own, so lines are folded.
    """
    rows = F.transform(lines(content), trim_all)
    words = lambda xs, without: F.array_except(F.flatten(F.transform(xs, ident_list)), F.array(*map(F.lit, without)).cast("array<string>"))
    rust = F.filter(F.transform(rows, lambda t: F.regexp_extract(t, r"^(?:pub\s*(?:\([^)]*\)\s*)?)?use (.*)$", 1)), lambda t: t != "")
    script = F.filter(rows, lambda t: F.startswith(t, F.lit("import ")) | F.contains(t, F.lit("require(")))
    python = F.filter(rows, lambda t: F.startswith(t, F.lit("import ")) | F.startswith(t, F.lit("from ")))
    sharp = F.filter(F.transform(rows, lambda t: F.regexp_extract(t, r"^using ([^(].*)$", 1)), lambda t: t != "")
    start = F.struct(F.lit(False).alias("open"), F.array().cast("array<string>").alias("kept"))
    is_import = lambda t: F.startswith(t, F.lit("import ")) | F.startswith(t, F.lit("import("))
    opens = lambda t: F.startswith(t, F.lit("import (")) | (t == "import(")
    go = F.aggregate(
        rows,
        start,
        lambda acc, t: F.struct(
            F.when(is_import(t), acc["open"] | opens(t)).otherwise(acc["open"] & (t != ")")).alias("open"),
            F.when(is_import(t) | (acc["open"] & (t != ")")), F.array_append(acc["kept"], t)).otherwise(acc["kept"]).alias("kept"),
        ),
    )["kept"]
    found = (
        F.when(language == "Rust", words(rust, ["crate", "self", "super", "Self"]))
        .when(language == "Go", words(go, ["import"]))
        .when(language == "CSharp", words(sharp, ["using"]))
        .when(language.isin("JavaScript", "TypeScript"), words(script, ["import", "from", "export", "as", "default", "require", "const", "let", "var"]))
        .when(language == "Python", words(python, ["import", "from", "as"]))
        .otherwise(F.array().cast("array<string>"))
    )
    return F.array_sort(found)


def test_cores(name: Column) -> Column:
    """Lower-cased names that a test is about by its own name, itself included: an equi-join key for test_targets."""
    patterns = [r"^test_(.*)$", r"^should_(.*)$", r"^(.*)_test$", r"^[tT]est([A-Z].*)$", r"^(.+)Test$"]
    cores = F.filter(F.array(name, *[F.regexp_extract(name, p, 1) for p in patterns]), lambda x: x != "")
    return F.array_distinct(F.transform(cores, F.lower))


def test_targets(test: Column, symbol: Column) -> Column:
    return F.array_contains(test_cores(test), F.lower(symbol))


def short_name(name: Column) -> Column:
    return F.substring_index(name, "::", -1)


def new_name(name: Column) -> Column:
    """Right side of ``old → new``."""
    return F.substring_index(name, " → ", -1)


def body_slice(rows: Column, start: Column, end: Column) -> Column:
    """Lines start..end, counted from 1 and cut to what there is, joined; null without lines or span."""
    last = F.least(F.greatest(end, start), F.size(rows))
    ok = (F.size(rows) > 0) & (start >= 1) & (start <= last)
    return F.when(ok, F.array_join(F.slice(rows, F.greatest(start, F.lit(1)), F.greatest(last - start + 1, F.lit(0))), "\n"))


def body_key(body: Column) -> Column:
    return F.regexp_replace(body, r"(?U)\s+", "")


def nosig_key(body: Column) -> Column:
    """Body without its first line and without white space."""
    return F.regexp_replace(F.regexp_replace(body, r"^[^\n]*\n?", ""), r"(?U)\s+", "")


def escape_github(s: Column) -> Column:
    return F.replace(F.replace(F.replace(single_line(s), F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def escape_github_prop(s: Column) -> Column:
    return F.replace(F.replace(escape_github(s), F.lit(":"), F.lit("%3A")), F.lit(","), F.lit("%2C"))


def escape_xml(s: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        s = F.replace(s, F.lit(raw), F.lit(safe))
    return s


def shell_quote(s: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def content_key(tag: Column, content: Column) -> Column:
    """Hash of a source's language tag and content."""
    return F.sha2(F.concat(F.encode(tag, "utf-8"), F.lit(b"\x00"), F.encode(content, "utf-8")), 256)


def evidence_rank(kind: Column) -> Column:
    found = F.array_position(F.array(*map(F.lit, EVIDENCE_PRIORITY)), kind)
    return F.when(found > 0, found - 1).otherwise(len(EVIDENCE_PRIORITY)).cast("int")


#: Parts of the names of attributes and decorators that mark tests.
TEST_MARKS = ("Test", "Fact", "Theory")


def is_test_attr(s: Column) -> Column:
    return s.rlike("|".join(TEST_MARKS))
