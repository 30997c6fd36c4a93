"""Task descriptions."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.text import trim_all


def task_text(spark: SparkSession, given: str) -> str:
    """The text itself, or that of a file named as ``@path``; blank ends go, and an empty task is an error."""
    if given.startswith("@"):
        rows = spark.read.text(given[1:], wholetext=True).select(trim_all(F.col("value")).alias("t")).collect()
        found = rows[0]["t"] if rows else ""
    else:
        found = given.strip()
    if not found:
        raise ValueError("the task description is empty")
    return found
