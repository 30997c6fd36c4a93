"""What a repository holds beside a change: its tests and sources, with the names they call, import and define."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.paths import is_test_path, language_of
from ..operators.extract import extract_symbols
from ..plans.barrier import settled

# Folders that a scan leaves out.
SKIPPED = "target node_modules dist build vendor __pycache__ venv env out".split()
MOST_BYTES = 256 * 1024
MOST_TESTS, MOST_SOURCES = 200, 400


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of the text files under a folder, without hidden and output folders and files over 256 KiB."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= MOST_BYTES)
    base = root.rstrip("/").removeprefix("file:").rstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + _quoted(base) + "/", "")
    rows = rows.select(path.alias("path"), "content")
    hidden = F.exists(F.split("path", "/"), lambda p: F.startswith(p, F.lit(".")) | p.isin(*SKIPPED))
    rows = rows.where(~hidden).withColumn("content", F.try_validate_utf8(F.col("content").cast("string"))).where("content IS NOT NULL")
    return rows.where(~F.contains("content", F.lit("\x00")))


def _quoted(s: str) -> str:
    return "\\Q" + s + "\\E"


def scan(files: DataFrame, changed: DataFrame | None = None, *, most_tests: int | None = MOST_TESTS, most_sources: int | None = MOST_SOURCES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tests (name, file, calls), sources (path, calls, imports) and definitions (name, file) of files (path, content).

    Files of the change (path) stay out.  Of test files and of other sources the first by path are taken, up to the
    caps; None takes all.
    """
    rows = files.withColumn("language", language_of(F.col("path"))).where("language <> 'Unknown'")
    if changed is not None:
        rows = rows.join(changed.select("path"), "path", "left_anti")
    rows = rows.withColumn("is_test", is_test_path(F.col("path")))
    for is_test, most in ((True, most_tests), (False, most_sources)):
        if most is not None:
            first = rows.where(F.col("is_test") == is_test).orderBy("path").limit(most)
            rows = rows.where(F.col("is_test") != is_test).unionByName(first)
    found = settled(extract_symbols(rows.select(F.col("path").alias("file"), "content")))
    placed = found.join(rows.select(F.col("path").alias("file"), F.col("is_test").alias("in_tests"), "content"), "file")
    body = text.body_slice(text.lines(F.col("content")), F.col("start_line"), F.col("end_line"))
    tests = placed.where("is_test OR in_tests").select("name", "file", text.called_names(F.coalesce(body, F.lit(""))).alias("calls"))
    sources = rows.select("path", text.called_names(F.col("content")).alias("calls"), text.imported_names(F.col("language"), F.col("content")).alias("imports"))
    return tests, sources, found.select("name", "file")
