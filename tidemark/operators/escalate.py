"""Escalation packages: facts about the gravest items, cut to fixed sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import approx_tokens, evidence_rank, single_line, truncate
from ..schemas import ESCALATION_SCHEMA_VERSION
from .rank import candidates

# Sizes of a package.
MOST_TITLE, MOST_WHY, MOST_SUMMARY = 200, 500, 300
MOST_EVIDENCE, MOST_FILES, MOST_SYMBOLS, MOST_UNMATCHED = 8, 10, 15, 25
ITEM_CHARS = 32


def _chars(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0), lambda n, x: n + F.length(x))


def compact(items: DataFrame) -> DataFrame:
    """Items with the evidence of highest rank first, everything cut to size, and an estimate of tokens."""
    ranked = F.transform("evidence", lambda e, i: F.struct(evidence_rank(e["kind"]).alias("rank"), i.alias("i"), F.concat(e["kind"], F.lit(": "), e["summary"]).alias("t")))
    lines = F.transform(F.slice(F.array_sort(ranked), 1, MOST_EVIDENCE), lambda e: truncate(e["t"], MOST_SUMMARY))
    rows = items.select(
        "changeset_id", "pos", "id", truncate(F.col("title"), MOST_TITLE).alias("title"), "category", "severity", "priority", "confidence",
        F.slice("files", 1, MOST_FILES).alias("files"), F.slice("symbols", 1, MOST_SYMBOLS).alias("symbols"), lines.alias("evidence"), truncate(F.col("why"), MOST_WHY).alias("why"),
    )
    size = F.length("title") + F.length("why") + F.length("id") + ITEM_CHARS + _chars(F.col("evidence")) + _chars(F.col("files")) + _chars(F.col("symbols"))
    return rows.withColumn("approx_tokens", F.ceil(size / 4).cast("int"))


def package(items: DataFrame, stats: DataFrame, *, base_ref: str = "HEAD", head_ref: str = "worktree", floor: str = "High", most: int = 10, task: DataFrame | None = None) -> DataFrame:
    """One package per change set of ``stats``; ``task`` has (changeset_id, task_text, verdict, unmatched)."""
    chosen = compact(candidates(items, floor, most))
    row = F.struct("pos", "id", "title", "category", "severity", "priority", "confidence", "files", "symbols", "evidence", "why", "approx_tokens")
    bodies = chosen.groupBy("changeset_id").agg(F.array_sort(F.collect_list(row)).alias("items"), F.sum("approx_tokens").alias("body"))
    rows = stats.select("changeset_id", "files_changed", "added_lines", "deleted_lines").join(bodies, "changeset_id", "left")
    head = F.concat_ws(" ", F.lit(base_ref), F.lit(head_ref), F.lit(floor), "files_changed", "added_lines", "deleted_lines")
    envelope = approx_tokens(head)
    if task is not None:
        gaps = F.slice("unmatched", 1, MOST_UNMATCHED)
        cut = task.select("changeset_id", F.struct(truncate(F.col("task_text"), MOST_WHY).alias("text"), "verdict", gaps.alias("unmatched")).alias("task"))
        rows = rows.join(cut, "changeset_id", "left")
        gap_tokens = F.aggregate("task.unmatched", F.lit(0), lambda n, u: n + approx_tokens(u))
        envelope = envelope + F.coalesce(approx_tokens(F.col("task.text")) + gap_tokens, F.lit(0))
    else:
        rows = rows.withColumn("task", F.lit(None).cast("struct<text:string,verdict:string,unmatched:array<string>>"))
    empty = F.array().cast(bodies.schema["items"].dataType)
    return rows.select(
        "changeset_id", F.lit(ESCALATION_SCHEMA_VERSION).alias("schema_version"), F.lit(base_ref).alias("base_ref"), F.lit(head_ref).alias("head_ref"), F.lit(floor).alias("floor"),
        "files_changed", "added_lines", "deleted_lines", "task", F.coalesce("items", empty).alias("items"), (F.coalesce("body", F.lit(0)) + envelope).cast("long").alias("approx_tokens"),
    )


def summary(packages: DataFrame) -> DataFrame:
    """(changeset_id, summary): a package as text."""
    gaps = F.when(F.size("task.unmatched") == 0, "none").otherwise(F.array_join("task.unmatched", ", "))
    task = F.when(F.col("task").isNotNull(), F.concat(F.lit("  task ["), F.col("task.verdict"), F.lit("], gaps: "), gaps, F.lit("\n"))).otherwise("")
    item = F.transform(
        "items",
        lambda x, i: F.concat(
            (i + 1).cast("string"), F.lit(". ["), x["severity"], F.lit("] "), x["title"], F.lit(" (~"), x["approx_tokens"].cast("string"), F.lit(" tokens)\n"),
            F.when(x["why"] != "", F.concat(F.lit("    "), single_line(x["why"]), F.lit("\n"))).otherwise(""),
            F.when(F.size(x["files"]) > 0, F.concat(F.lit("    files: "), F.array_join(x["files"], ", "), F.lit("\n"))).otherwise(""),
        ),
    )
    body = F.when(F.size("items") == 0, "  no items at or above the floor — nothing to escalate.\n").otherwise(F.concat(F.array_join(item, ""), F.lit("  pipe the JSON package to your model\n")))
    head = F.concat(F.lit("\nEscalation package — "), F.size("items"), F.lit(" item(s), ~"), F.col("approx_tokens"), F.lit(" tokens, floor "), F.col("floor"), F.lit(" (schema v"), F.col("schema_version"), F.lit(")\n"))
    return packages.select("changeset_id", F.concat(head, task, body).alias("summary"))
