"""Review items from scored files and symbol changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import EVIDENCE, SEVERITIES, evidence, name_of
from ..plans.barrier import settled
from .numbering import MOST_IN_TASK, numbered
from .score import score_files

ITEM = ("changeset_id", "id", "title", "category", "severity", "severity_rank", "priority", "confidence", "files", "symbols", "evidence", "why")
ITEM_SCHEMA = (
    "changeset_id STRING, id STRING, title STRING, category STRING, severity STRING, severity_rank INT, priority INT, confidence FLOAT, files ARRAY<STRING>, "
    f"symbols ARRAY<STRING>, evidence ARRAY<{EVIDENCE}>, why STRING"
)
STATS_SCHEMA = (
    "changeset_id STRING, files_changed BIGINT, added_lines BIGINT, deleted_lines BIGINT, mechanical_files BIGINT, test_files BIGINT, symbols_added BIGINT, symbols_removed BIGINT, "
    "symbols_modified BIGINT, meaningful_changes BIGINT"
)
# fixed values: titles, reasons and verbs of items
MECHANICAL_WHY = "These files match generated-output or whitespace-only heuristics. Expand to verify, but they rarely need line-by-line review."
TESTS_WHY = "New tests document intended behavior. Modified tests changed what they assert — check the diffs if their targets are in the queue above."
EDITED_WHY = "Symbols relocated across files with small body edits. The move itself is safe; review the edits flagged on each symbol."
MOVE_WHY = "Pure relocation — bodies identical. Safe to skim; no behavior change."
VERBS = {"Added": "added", "Removed": "removed", "SignatureChanged": "signature changed", "VisibilityChanged": "visibility changed", "Renamed": "renamed", "Moved": "moved", "Modified": "modified", "FormattingOnly": "reformatted"}
SYMBOL = "STRUCT<name: STRING, kind: STRING, change: STRING, confidence: FLOAT, moved_from: STRING>"


def symbols_by_file(changes: DataFrame) -> DataFrame:
    """(changeset_id, path, all_symbols): a file's symbol changes in the order of name, kind and place."""
    row = F.struct("name", "kind", F.coalesce("new_start", "old_start").alias("at"), "change", F.col("confidence").cast("float").alias("confidence"), "moved_from", "evidence")
    return changes.groupBy("changeset_id", F.col("file").alias("path")).agg(bare_symbols(F.array_sort(F.collect_list(row))).alias("all_symbols"))


def bare_symbols(ordered: Column) -> Column:
    """The fields of a file's symbol changes that scoring reads."""
    return F.transform(ordered, lambda s: F.struct(s["name"].alias("name"), s["kind"].alias("kind"), s["change"].alias("change"), s["confidence"].alias("confidence"), s["moved_from"].alias("moved_from")))


def is_mechanical() -> Column:
    return F.col("is_generated") | F.col("formatting_only")


def _s(n: Column) -> Column:
    return F.when(n == 1, "").otherwise("s")


def _paths(listed: bool) -> Column:
    """Aggregate: the paths of a bucket in the order of files, or none."""
    return F.array_sort(F.collect_list(F.struct("file_idx", "path")))["path"] if listed else F.first(F.array().cast("array<string>"))


def mechanical_bucket(files: DataFrame, *, listed: bool = True) -> DataFrame:
    """One item for all generated and formatting-only files of a change set; without its files if not ``listed``."""
    rows = files.where(is_mechanical()).groupBy("changeset_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("added_lines") + F.col("deleted_lines")).alias("total"), _paths(listed).alias("files"))
    return rows.select(
        "changeset_id", F.lit("mechanical").alias("id"), F.concat(F.lit("Generated / mechanical changes — "), F.col("n"), F.lit(" file"), _s(F.col("n")), F.lit(" collapsed")).alias("title"),
        F.lit("Mechanical").alias("category"), F.lit("Low").alias("severity"), F.lit(0).alias("severity_rank"), F.lit(2).alias("priority"), F.lit(0.9).cast("float").alias("confidence"),
        "files", F.array().cast("array<string>").alias("symbols"),
        F.array(evidence("mechanical-bucket", F.concat(F.col("total"), F.lit(" changed lines across generated/formatting-only files")))).alias("evidence"), F.lit(MECHANICAL_WHY).alias("why"),
    )


def _additive(symbols: Column) -> Column:
    return (F.size(symbols) > 0) & F.forall(symbols, lambda s: s["change"].isin("Added", "Modified"))


def is_bucketed_test() -> Column:
    """Added, untracked or modified test files all of whose symbol changes are additions and modifications."""
    return F.coalesce(F.col("is_test_file") & ~is_mechanical() & F.col("status").isin("Added", "Untracked", "Modified") & _additive(F.col("all_symbols")), F.lit(False))


#: Modified test symbols that the tests' bucket names.
MOST_NAMED = 10


def tests_bucket(files: DataFrame, *, listed: bool = True) -> DataFrame:
    """One item for the additive test files of a change set; without its files if not ``listed``."""
    count = lambda what: F.size(F.filter("all_symbols", lambda s: s["change"] == what))
    tests = files.where(is_bucketed_test())
    rows = tests.groupBy("changeset_id").agg(F.count(F.lit(1)).alias("n"), F.sum(count("Added")).alias("added"), F.sum(count("Modified")).alias("modified"), _paths(listed).alias("files"))
    changed = F.filter("all_symbols", lambda s: s["change"] == "Modified")
    named = tests.where(F.size(changed) > 0).select("changeset_id", "file_idx", "path", F.posexplode(F.slice(changed, 1, MOST_NAMED)).alias("at", "s"))
    turn = F.row_number().over(Window.partitionBy("changeset_id").orderBy("file_idx", "path", "at"))  # each task drops its own others first
    named = named.withColumn("turn", turn).where(F.col("turn") <= MOST_NAMED)
    named = named.groupBy(F.col("changeset_id").alias("c")).agg(F.array_sort(F.collect_list(F.struct("turn", F.col("s.name").alias("name"), F.col("path").alias("file")))).alias("m"))
    rows = rows.join(named, F.col("changeset_id").eqNullSafe(F.col("c")), "left").withColumn("m", F.coalesce("m", F.array().cast(named.schema["m"].dataType)))
    head = F.when(F.col("added") > 0, F.concat(F.lit("Tests — "), F.col("added"), F.lit(" new test symbol"), _s(F.col("added")))).otherwise("Tests")
    middle = F.when(F.col("modified") > 0, F.concat(F.lit(", "), F.col("modified"), F.lit(" modified"))).otherwise("")
    first = evidence("test-additions", F.concat(F.col("added"), F.lit(" added test symbols")))
    more = F.transform("m", lambda m: F.struct(F.lit("test-modified").alias("kind"), m["name"].alias("summary"), m["file"].alias("file"), F.lit(None).cast("string").alias("old_value"), F.lit(None).cast("string").alias("new_value")))
    return rows.select(
        "changeset_id", F.lit("tests").alias("id"), F.concat(head, middle, F.lit(" across "), F.col("n"), F.lit(" file"), _s(F.col("n"))).alias("title"), F.lit("Test").alias("category"),
        F.lit("Low").alias("severity"), F.lit(0).alias("severity_rank"), F.lit(15).alias("priority"), F.lit(0.85).cast("float").alias("confidence"), "files",
        F.array().cast("array<string>").alias("symbols"), F.concat(F.array(first), more).alias("evidence"), F.lit(TESTS_WHY).alias("why"),
    )


def move_items(changes: DataFrame) -> DataFrame:
    """One item for the symbols that moved from one file to another."""
    at = F.coalesce("new_start", "old_start").alias("at")
    row = F.struct("name", "kind", at, F.col("confidence").cast("float").alias("confidence"), "evidence")
    rows = changes.where("change = 'Moved' AND moved_from IS NOT NULL").groupBy("changeset_id", F.col("moved_from").alias("origin"), F.col("file").alias("target"))
    # names are listed apart, so that the evidence is not shuffled where nobody reads it
    names = F.array_sort(F.collect_list(F.struct("name", "kind", at)))["name"].alias("names")
    rows = rows.agg(F.bool_or(F.col("confidence") < F.lit(0.8)).alias("edited"), F.min(F.col("confidence").cast("float")).alias("least"), names, F.array_sort(F.collect_list(row)).alias("m"))
    way = F.concat(F.lit(" moved "), F.col("origin"), F.lit(" → "), F.col("target"))
    proof = F.transform(
        "m",
        lambda s: F.struct(
            F.lit("symbol-move").alias("kind"),
            F.concat(s["name"], F.lit(" ("), s["kind"], F.lit(", "), F.format_string("%.0f", s["confidence"] * 100), F.lit("% confidence): "), F.array_join(F.slice(s["evidence"], 2, 100), "; ")).alias("summary"),
            F.col("target").alias("file"), F.lit(None).cast("string").alias("old_value"), F.lit(None).cast("string").alias("new_value"),
        ),
    )
    rank = F.when(F.col("edited"), 1).otherwise(0)
    return rows.select(
        "changeset_id", F.concat(F.lit("move:"), F.col("origin"), F.lit("→"), F.col("target")).alias("id"),
        F.when(F.size("names") == 1, F.concat(F.get("names", F.lit(0)), way)).otherwise(F.concat(F.size("names"), F.lit(" symbols"), way)).alias("title"), F.lit("Refactor").alias("category"),
        name_of(rank, SEVERITIES).alias("severity"), rank.alias("severity_rank"), F.when(F.col("edited"), 25).otherwise(8).alias("priority"), F.col("least").alias("confidence"),
        F.array("origin", "target").alias("files"), F.col("names").alias("symbols"), proof.alias("evidence"), F.when(F.col("edited"), EDITED_WHY).otherwise(MOVE_WHY).alias("why"),
    )


def file_title() -> Column:
    verb = F.try_element_at(F.create_map(*[F.lit(x) for pair in VERBS.items() for x in pair]), F.get("symbols", F.lit(0))["change"])
    n = F.size("symbols")
    plain = F.when(F.col("status").isin("Added", "Untracked"), F.concat("path", F.lit(" — new file"))).when(F.col("status") == "Deleted", F.concat("path", F.lit(" — deleted")))
    plain = plain.when(F.col("status") == "Renamed", F.concat(F.coalesce("old_path", F.lit("")), F.lit(" → "), F.col("path"), F.lit(" — renamed")))
    plain = plain.otherwise(F.concat("path", F.lit(" — +"), "added_lines", F.lit(" −"), "deleted_lines"))
    return F.when(n == 1, F.concat("path", F.lit(" — "), F.get("symbols", F.lit(0))["name"], F.lit(" "), verb)).when(n > 1, F.concat("path", F.lit(" — "), n, F.lit(" symbols changed"))).otherwise(plain)


def file_why() -> Column:
    n = F.size("symbols")
    parts = F.transform(F.slice("symbols", 1, 5), lambda s: F.concat(s["kind"], F.lit(" "), s["name"], F.lit(" ("), s["change"], F.lit(")")))
    listed = F.array_join(F.concat(parts, F.when(n > 5, F.array(F.concat(F.lit("…and "), n - 5, F.lit(" more")))).otherwise(F.array().cast("array<string>"))), "; ")
    return F.when(n == 0, F.concat(F.lit("No parseable symbols changed in this file ("), F.col("path"), F.lit("). Review the raw diff."))).otherwise(listed)


#: What items and stats are made from, once files are scored.
SCORED = (
    "changeset_id", "file_idx", "path", "old_path", "status", "language", "is_test_file", "is_generated", "formatting_only", "added_lines", "deleted_lines", "all_symbols", "symbols",
    "priority", "severity", "severity_rank", "category", "evidence",
)


def scored(files: DataFrame) -> DataFrame:
    """Files (with all_symbols) and their scores as a written table without contents and lines.

    Items are filtered by scores, and a filter that Spark pushes below them would compare and score the lines of a file anew for each
    of its conditions; so each file is scored once.
    """
    empty = F.array().cast(f"array<{SYMBOL}>")
    own = F.filter(F.coalesce("all_symbols", empty), lambda s: ~((s["change"] == "Moved") & s["moved_from"].isNotNull()))
    rows = files.withColumn("symbols", own)
    for c, kind in (("file_idx", "long"), ("old_path", "string")):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast(kind))
    return settled(score_files(rows).select(*SCORED))


def file_items(files: DataFrame, moves: DataFrame | None = None, *, keep_unbucketed_tests: bool = False) -> DataFrame:
    """One item for each other file that has something to review.

    ``files`` has all_symbols; ``moves`` (changeset_id, path) are the ends of moves.  Test files with additions and
    modifications only are left out whatever their status unless keep_unbucketed_tests is set.
    """
    return _file_items(scored(files), moves, keep_unbucketed_tests)


def _file_items(files: DataFrame, moves: DataFrame | None, keep_unbucketed_tests: bool = False) -> DataFrame:
    rows = files.where(~is_mechanical() & ~is_bucketed_test())
    if moves is not None:
        ends = moves.select("changeset_id", F.explode("files").alias("path")).distinct().withColumn("moved", F.lit(True))
        rows = rows.join(ends, ["changeset_id", "path"], "left")
    else:
        rows = rows.withColumn("moved", F.lit(False))
    bare = F.size("symbols") == 0
    if not keep_unbucketed_tests:
        rows = rows.where(~(F.col("is_test_file") & _additive(F.col("symbols"))))
    rows = rows.where(~(bare & F.coalesce("moved", F.lit(False)))).where(~(bare & (F.col("added_lines") + F.col("deleted_lines") == 0)))
    return rows.select(
        "changeset_id", F.concat(F.lit("file:"), F.col("path")).alias("id"), file_title().alias("title"), "category", "severity", "severity_rank", "priority", F.lit(0.8).cast("float").alias("confidence"),
        F.array("path").alias("files"), F.col("symbols.name").alias("symbols"), F.col("evidence").cast(f"array<{EVIDENCE}>").alias("evidence"), file_why().alias("why"),
    )


def with_all_symbols(files: DataFrame, changes: DataFrame | None) -> DataFrame:
    """Files with all_symbols, the changes of their symbols."""
    if changes is None:
        return files.withColumn("all_symbols", F.array().cast(f"array<{SYMBOL}>"))
    return files.join(symbols_by_file(changes), ["changeset_id", "path"], "left")


def group_items(files: DataFrame, changes: DataFrame | None = None, *, listed: bool = True) -> DataFrame:
    """All review items of change sets; nothing is ordered yet.

    If not ``listed``, the two buckets come without their files, which bucket_members() has: then no row grows with a change set.
    """
    return items_of(scored(with_all_symbols(files, changes)), changes, listed=listed)


def items_of(files: DataFrame, changes: DataFrame | None = None, *, listed: bool = True) -> DataFrame:
    """All review items of files that are ``scored``."""
    if changes is None:
        return mechanical_bucket(files, listed=listed).unionByName(_file_items(files, None))
    moves = move_items(changes)
    return mechanical_bucket(files, listed=listed).unionByName(tests_bucket(files, listed=listed)).unionByName(moves).unionByName(_file_items(files, moves))


def bucket_members(files: DataFrame, changes: DataFrame | None = None, *, most: int = MOST_IN_TASK) -> DataFrame:
    """(changeset_id, id, n, path): the files of the two buckets, a row each, numbered from 1 in their order.

    Buckets of more than ``most`` files are numbered by many tasks.
    """
    bucket = F.when(is_mechanical(), "mechanical").when(is_bucketed_test(), "tests")
    rows = with_all_symbols(files, changes).select("changeset_id", bucket.alias("id"), "file_idx", "path").where("id IS NOT NULL")
    return numbered(rows, ["changeset_id", "id"], [F.col("file_idx"), F.col("path")], "n", most=most).select("changeset_id", "id", "n", "path")


def with_members(items: DataFrame, members: DataFrame, *, first: int | None = None) -> DataFrame:
    """Items whose buckets have their files again, or the ``first`` of them, for renderers that show these."""
    rows = members if first is None else members.where(F.col("n") <= first)
    paths = rows.groupBy(F.col("changeset_id").alias("c"), F.col("id").alias("i")).agg(F.array_sort(F.collect_list(F.struct("n", "path")))["path"].alias("listed"))
    joined = items.join(paths, F.col("changeset_id").eqNullSafe(F.col("c")) & (F.col("id") == F.col("i")), "left")
    return joined.withColumn("files", F.coalesce("listed", "files")).select(*items.columns)


def change_stats(files: DataFrame, changes: DataFrame, items: DataFrame) -> DataFrame:
    """One row of counters per change set that has files."""
    count = lambda c: F.count_if(c)
    of_files = files.groupBy("changeset_id").agg(
        F.count(F.lit(1)).alias("files_changed"), F.sum("added_lines").alias("added_lines"), F.sum("deleted_lines").alias("deleted_lines"), count(is_mechanical()).alias("mechanical_files"), count(F.col("is_test_file")).alias("test_files")
    )
    of_symbols = changes.groupBy("changeset_id").agg(
        count(F.col("change") == "Added").alias("symbols_added"), count(F.col("change") == "Removed").alias("symbols_removed"), count(~F.col("change").isin("Added", "Removed")).alias("symbols_modified")
    )
    of_items = items.groupBy("changeset_id").agg(count(F.col("category") != "Mechanical").alias("meaningful_changes"))
    return of_files.join(of_symbols, "changeset_id", "left").join(of_items, "changeset_id", "left").na.fill(0)
