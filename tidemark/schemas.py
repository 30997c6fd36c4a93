"""Record types, value lists and rank maps of the change model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA_VERSION = 1
ESCALATION_SCHEMA_VERSION = 1

LINE = "STRUCT<kind: STRING, text: STRING>"
HUNK = f"STRUCT<old_start: INT, old_lines: INT, new_start: INT, new_lines: INT, header: STRING, lines: ARRAY<{LINE}>>"
FILE_CHANGE = (
    "old_path STRING, new_path STRING, status STRING, language STRING, is_binary BOOLEAN, is_generated BOOLEAN, is_test_file BOOLEAN, "
    f"added_lines BIGINT, deleted_lines BIGINT, hunks ARRAY<{HUNK}>, old_content STRING, new_content STRING"
)
SPAN = "STRUCT<start: INT, end: INT>"
SYMBOL = "name STRING, kind STRING, file STRING, start_line INT, end_line INT, signature STRING, is_test BOOLEAN, is_public BOOLEAN"
SYMBOL_STRUCT = "STRUCT<name: STRING, kind: STRING, start_line: INT, end_line: INT, signature: STRING, is_test: BOOLEAN, is_public: BOOLEAN>"
SYMBOL_CHANGE = (
    f"file STRING, name STRING, kind STRING, change STRING, confidence FLOAT, old_signature STRING, new_signature STRING, old_lines {SPAN}, new_lines {SPAN}, evidence ARRAY<STRING>"
)
EVIDENCE = "STRUCT<kind: STRING, summary: STRING, file: STRING, old_value: STRING, new_value: STRING>"
REVIEW_ITEM = f"id STRING, title STRING, category STRING, severity STRING, priority INT, confidence FLOAT, files ARRAY<STRING>, symbols ARRAY<STRING>, evidence ARRAY<{EVIDENCE}>, why STRING"

LANGUAGES = ("Rust", "TypeScript", "JavaScript", "Python", "CSharp", "C", "Cpp", "Go", "Java", "Unknown")
STATUSES = ("Added", "Deleted", "Modified", "Renamed", "Copied", "TypeChanged", "Untracked", "Unmodified")
SYMBOL_KINDS = ("Function", "Method", "Class", "Struct", "Enum", "Trait", "Interface", "Const", "Static", "Module", "TypeAlias", "Field", "Test")
CHANGES = ("Added", "Removed", "Modified", "SignatureChanged", "VisibilityChanged", "Renamed", "Moved", "FormattingOnly")
SEVERITIES = ("Low", "Medium", "High", "Critical")
VERDICTS = ("Uncovered", "Partial", "Covered")


def rank_of(value: Column, names: tuple[str, ...]) -> Column:
    """Place of a name in an ordered list, null for others."""
    found = F.array_position(F.array(*map(F.lit, names)), value)
    return F.when(found > 0, (found - 1).cast("int"))


def name_of(rank: Column, names: tuple[str, ...]) -> Column:
    return F.get(F.array(*map(F.lit, names)), rank)


def severity_rank(severity: Column) -> Column:
    return rank_of(severity, SEVERITIES)


def parse_severity(text: Column) -> Column:
    """Severity of a level name in any case, ``med`` and ``crit`` included; others are an error."""
    return _parse(text, {"low": "Low", "med": "Medium", "medium": "Medium", "high": "High", "crit": "Critical", "critical": "Critical"}, "severity")


def parse_verdict(text: Column) -> Column:
    return _parse(text, {"covered": "Covered", "cover": "Covered", "partial": "Partial", "uncovered": "Uncovered", "uncover": "Uncovered"}, "verdict")


def _parse(text: Column, names: dict[str, str], what: str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    found = F.try_element_at(table, F.lower(text))
    return F.when(text.isNull() | found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit(f"invalid {what}: "), text)))


def evidence(kind: str, summary: Column | str, file: Column | str = "") -> Column:
    """One evidence record; old and new value are never set."""
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    none = F.lit(None).cast("string")
    return F.struct(F.lit(kind).alias("kind"), text(summary).alias("summary"), text(file).alias("file"), none.alias("old_value"), none.alias("new_value"))
