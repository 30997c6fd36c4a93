"""Whole reviews: from change records to ranked items.

Tables that later steps use many times (symbols, their changes, items) are settled at barriers; the rest is lazy.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import cache, context, escalate, extract, group, judge, moves, rank, symbols, task
from ..sources.linediff import line_lists
from ..sources.tables import prepared
from .barrier import settled


@dataclass(frozen=True)
class Review:
    """Tables of reviewed change sets."""

    files: DataFrame
    changes: DataFrame
    items: DataFrame
    stats: DataFrame
    tasks: DataFrame | None = None
    #: (changeset_id, tests, label): the tests of each group, where items name groups
    groups: DataFrame | None = None

    def escalation(self, **how) -> DataFrame:
        return escalate.package(self.items, self.stats, **how)

    def gate(self, threshold: str) -> DataFrame:
        return rank.gate(self.items, threshold)


def review(
    changes: DataFrame,
    symbol_rows: DataFrame,
    *,
    tests: DataFrame | None = None,
    sources: DataFrame | None = None,
    definitions: DataFrame | None = None,
    local_judge: bool = False,
    tasks: DataFrame | None = None,
    renames: bool = True,
    similar: bool = True,
) -> Review:
    """Review change records (changeset_id, file_idx, path, status, old_content, new_content) with their symbols.

    ``tests`` (changeset_id, name, file, calls) and ``sources`` (path, calls, imports) with ``definitions`` (name, file)
    add coverage and blast radius; ``tasks`` (changeset_id, task_id, task_text) are checked against the change.
    """
    files = prepared(changes)
    parsed = files.where(~F.col("is_generated") & ~F.col("is_binary")).select("changeset_id", F.col("path").alias("file"))
    symbol_rows = symbol_rows.join(parsed, ["changeset_id", "file"], "left_semi")
    symbol_rows = settled(symbol_rows)
    found = settled(moves.link_moves(settled(symbols.diff_symbols(symbol_rows, renames=renames)), symbol_rows, similar=similar))
    return finished(files, found, tests=tests, sources=sources, definitions=definitions, local_judge=local_judge, tasks=tasks)


def review_changes(changes: DataFrame, **how) -> Review:
    """Review change records that carry their hunks, as a git source or ``with_hunks`` gives them.

    ``cache_path`` names a cache of symbols that spares parsing and is saved anew; the review is the same with it and without.

    Symbols of both sides are extracted from the contents; binary, generated and very large files are not parsed.
    """
    files = settled(with_lines(changes))
    parsed = parsable(files)
    rows = settled(symbols_of(parsed, how.pop("cache_path", None)))
    compared = settled(with_file_changes(symbols.diff_symbols(rows, renames=how.pop("renames", True)), rows, parsed))
    found = settled(moves.link_moves(compared, rows, similar=how.pop("similar", True)))
    return finished(files, found, **how)


def parsable(files: DataFrame) -> DataFrame:
    """Files whose symbols are extracted."""
    return files.where(~paths.skip_parse(F.col("is_binary"), F.col("is_generated"), F.col("old_content"), F.col("new_content")))


def with_lines(changes: DataFrame) -> DataFrame:
    """Change records with hunks, and the derived columns that scoring reads."""
    rows = line_lists(changes).withColumn("language", paths.language_of(F.col("path"))).withColumn("is_test_file", paths.is_test_path(F.col("path")))
    rows = rows.withColumn("is_generated", paths.generated_by_name(F.col("path")) | paths.generated_by_content(F.col("old_content"), F.col("new_content")))
    return rows.withColumn("formatting_only", paths.formatting_only(F.col("language"), F.col("status"), F.col("is_binary"), F.size("hunks"), F.col("old_content"), F.col("new_content")))


def symbols_of(files: DataFrame, cache_path: str | None = None) -> DataFrame:
    """Symbols of both sides of change records, with their bodies.  Equal contents of either side are parsed once, and those of
    the cache at ``cache_path`` not at all; the cache is then saved with what is new."""
    sides = None
    for side, column in (("old", "old_content"), ("new", "new_content")):
        one = files.where(F.col(column).isNotNull()).select("changeset_id", "path", F.lit(side).alias("side"), F.col(column).alias("content"))
        sides = one if sides is None else sides.unionByName(one)
    sides = sides.withColumn("key", text.content_key(paths.language_of(F.col("path")), F.col("content")))
    sources = sides.select(F.col("path").alias("file"), "content")
    if cache_path is None:
        found = extract.extract_symbols(sources, with_key=True)
    else:
        found, entries = extract.extract_cached(sources, cache.load(files.sparkSession, cache_path), with_key=True)
        cache.save(cache.evict(settled(entries)), cache_path)
    keyed = sides.join(found.withColumnRenamed("file", "path"), ["path", "key"])
    body = text.body_slice(text.lines(F.col("content")), F.col("start_line"), F.col("end_line"))
    return keyed.select("changeset_id", F.col("path").alias("file"), "side", "sym_idx", "name", "kind", "start_line", "end_line", "signature", "is_test", "is_public", F.coalesce(body, F.lit("")).alias("body"))


def with_file_changes(changes: DataFrame, rows: DataFrame, files: DataFrame) -> DataFrame:
    """Symbol changes, with one for the whole file where an added or deleted file has lines but no symbols."""
    known = rows.select("changeset_id", F.col("file").alias("path")).distinct()
    bare = files.where(F.col("status").isin("Added", "Deleted", "Untracked") & (F.col("added_lines") + F.col("deleted_lines") > 0)).join(known, ["changeset_id", "path"], "left_anti")
    gone = F.col("status") == "Deleted"
    none = lambda kind: F.lit(None).cast(kind)
    whole = bare.select(
        "changeset_id", F.col("path").alias("file"), F.col("path").alias("name"), F.lit("Module").alias("kind"), F.when(gone, "Removed").otherwise("Added").alias("change"), F.lit(0.9).cast("float").alias("confidence"),
        none("string").alias("old_signature"), none("string").alias("new_signature"), none("int").alias("old_start"), none("int").alias("old_end"), none("int").alias("new_start"), none("int").alias("new_end"),
        F.array(F.when(gone, "file deleted").otherwise("new file")).alias("evidence"), none("string").alias("moved_from"),
    )
    return changes.unionByName(whole)


def finished(files: DataFrame, found: DataFrame, *, tests: DataFrame | None = None, sources: DataFrame | None = None, definitions: DataFrame | None = None, local_judge: bool = False, tasks: DataFrame | None = None, grouped: bool = False) -> Review:
    """Items, stats and task checks from files and their symbol changes.

    With ``grouped``, items name the groups of tests that cover them, and the tests of a group are rows of their own: the names of
    all tests of all items are as many as items times tests where very many tests call one name.
    """
    scored = group.scored(group.with_all_symbols(files, found))
    items = settled(group.items_of(scored, found))
    whole, groups = lambda rows: rows, None
    if tests is not None:
        of_files = files.select("changeset_id", F.col("path").alias("file"), "is_test_file")
        tests = settled(tests)
        of_symbols = found.join(of_files, ["changeset_id", "file"])
        if grouped:
            items, groups = context.mark_groups(items, of_symbols, tests)
        else:
            items, covers = context.mark_coverage(items, of_symbols, tests)
            whole = lambda rows: context.with_covers(rows, covers)
    if sources is not None and definitions is not None:
        items = context.apply_blast_radius(items, settled(sources), definitions, tests)
    if local_judge:
        items = judge.LocalJudge().apply(items)
    items = settled(items)
    stats = group.change_stats(scored, found, items)
    checks = None if tasks is None else task.check_tasks(tasks, task.change_corpus(found, files, whole(items)), ("changeset_id",))
    return Review(files, found, whole(rank.review_order(items)), stats, checks, groups)
