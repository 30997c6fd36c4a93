"""Rows that a viewer of changes shows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numbering import MOST_IN_TASK, numbered


def diff_rows(files: DataFrame, *, most: int = MOST_IN_TASK) -> DataFrame:
    """(changeset_id, row, level, path, hunk_idx, line_idx, kind, text): files, their hunks and lines, in reading order.

    ``files``: (changeset_id, file_idx, path, hunks).
    """
    hunks = files.select("changeset_id", "file_idx", "path", F.posexplode("hunks").alias("hunk_idx", "hunk"))
    lines = hunks.select("changeset_id", "file_idx", "path", "hunk_idx", F.posexplode("hunk.lines").alias("line_idx", "line"))
    none = F.lit(-1)
    rows = files.select("changeset_id", "file_idx", "path", none.alias("hunk_idx"), none.alias("line_idx"), F.lit("file").alias("level"), F.lit(None).cast("string").alias("kind"), F.col("path").alias("text"))
    rows = rows.unionByName(hunks.select("changeset_id", "file_idx", "path", "hunk_idx", none.alias("line_idx"), F.lit("hunk").alias("level"), F.lit(None).cast("string").alias("kind"), F.col("hunk.header").alias("text")))
    rows = rows.unionByName(lines.select("changeset_id", "file_idx", "path", "hunk_idx", "line_idx", F.lit("line").alias("level"), F.col("line.kind").alias("kind"), F.col("line.text").alias("text")))
    order = [F.col(c) for c in ("file_idx", "hunk_idx", "line_idx")]
    return numbered(rows, ["changeset_id"], order, "row", most=most).select("changeset_id", "row", "level", "path", "hunk_idx", "line_idx", "kind", "text")


def item_detail(items: DataFrame, files: DataFrame) -> DataFrame:
    """(changeset_id, id, path, hunk_idx, line_idx, kind, text): the changed lines of an item's files."""
    of_items = items.select("changeset_id", "id", F.posexplode("files").alias("n", "path"))
    lines = files.select("changeset_id", "path", F.posexplode("hunks").alias("hunk_idx", "hunk")).select("changeset_id", "path", "hunk_idx", F.posexplode("hunk.lines").alias("line_idx", "line"))
    lines = lines.select("changeset_id", "path", "hunk_idx", "line_idx", F.col("line.kind").alias("kind"), F.col("line.text").alias("text")).where("kind <> 'Context'")
    return of_items.join(lines, ["changeset_id", "path"]).drop("n")
