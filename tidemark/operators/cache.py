"""A table of extracted symbols by content, so that equal sources are parsed once, over runs too.

A stored cache is a folder with one Parquet table per version and a file ``current`` that names the table in use.  Saving
writes a new table and then replaces that file in one step, so a reader or a crash never meets half a cache.
"""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_key
from ..schemas import SYMBOL_STRUCT

VERSION = 1
MOST_ENTRIES = 5000
SCHEMA = f"version INT, content_key STRING, symbols ARRAY<{SYMBOL_STRUCT}>"


def default_path() -> str | None:
    """Where a user's cache lies: below XDG_CACHE_HOME, or else ~/.cache; None where neither is known."""
    base = os.environ.get("XDG_CACHE_HOME") or (os.path.join(os.environ["HOME"], ".cache") if os.environ.get("HOME") else None)
    return os.path.join(base, "tidemark", "symbols") if base else None


def keyed(sources: DataFrame) -> DataFrame:
    """``sources`` (…, language, content) with the key of their content."""
    return sources.withColumn("content_key", content_key(F.lower("language"), F.col("content")))


def _system(spark: SparkSession, path: str):
    fs = spark._jvm.org.apache.hadoop.fs
    folder = fs.Path(path)
    return fs, folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def _current(spark: SparkSession, path: str) -> str | None:
    """Name of the table in use; None without one that can be read."""
    fs, folder, system = _system(spark, path)
    pointer = fs.Path(folder, "current")
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(system.open(pointer), "UTF-8").strip() if system.exists(pointer) else None
    except Py4JJavaError:
        return None


def load(spark: SparkSession, path: str | None, most: int = MOST_ENTRIES) -> DataFrame:
    """Entries of a stored cache, the largest keys if there are more than ``most``; a missing, unreadable or older one is empty."""
    from pyspark.errors import PySparkException

    empty = spark.createDataFrame([], SCHEMA)
    name = _current(spark, path) if path else None
    if not name:
        return empty
    try:
        rows = spark.read.schema(SCHEMA).parquet(f"{path}/{name}").where(F.col("version") == VERSION)
        return rows if rows.count() <= most else rows.orderBy(F.desc("content_key")).limit(most)
    except PySparkException:
        return empty


def evict(entries: DataFrame, most: int = MOST_ENTRIES) -> DataFrame:
    """Entries without the smallest eighth of the keys that a full cache holds, while it is over its size.

    Every task keeps its largest keys only, so no task sorts all of them.
    """
    n = entries.count()
    if n < most:
        return entries
    keep = max(n - max(most // 8, n - most + most // 8), 0)
    return entries.orderBy(F.desc("content_key")).limit(keep)


def save(entries: DataFrame, path: str) -> None:
    """Write a cache as a new table, then make it the one in use; older tables but the last are deleted."""
    spark = entries.sparkSession
    before = _current(spark, path)
    name = f"table-{uuid.uuid4().hex}"
    entries.write.parquet(f"{path}/{name}")
    fs, folder, system = _system(spark, path)
    draft = fs.Path(folder, f"current.{name}")
    out = system.create(draft, True)
    out.write(bytearray(name.encode()))
    out.close()
    how = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    how[0] = fs.Options.Rename.OVERWRITE
    files = fs.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration())
    files.rename(system.makeQualified(draft), system.makeQualified(fs.Path(folder, "current")), how)
    for status in system.listStatus(folder):
        other = status.getPath().getName()
        if other.startswith("table-") and other not in (name, before):
            system.delete(status.getPath(), True)


def metrics(wanted: DataFrame, entries: DataFrame) -> DataFrame:
    """One row: lookups, hits, misses and hit rate of keyed sources against a cache."""
    known = entries.select("content_key", F.lit(True).alias("hit")).distinct()
    rows = wanted.select("content_key").join(known, "content_key", "left")
    hits = F.count_if(F.coalesce("hit", F.lit(False)))
    n = F.count(F.lit(1))
    return rows.agg(n.alias("lookups"), hits.alias("hits"), (n - hits).alias("misses"), F.when(n > 0, hits / n).otherwise(0.0).alias("hit_rate"))
