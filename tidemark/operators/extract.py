"""Symbols of sources: content to rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.paths import language_of
from ..plans.barrier import settled
from . import cache, scanners

# Words before a parenthesis that do not name a function.
NOT_FUNCTIONS = "if else elif for foreach while do switch catch try finally throw return using lock fixed checked unchecked unless until".split()
ROW = "file STRING, sym_idx INT, name STRING, kind STRING, start_line INT, end_line INT, signature STRING, is_test BOOLEAN, is_public BOOLEAN"


def generic_symbols(sources: DataFrame) -> DataFrame:
    """Symbols by the look of single lines, for sources (file, content) of any language."""
    rows = sources.select("file", F.posexplode(text.lines(F.col("content"))).alias("pos", "line")).withColumn("whole", text.trim_all(F.col("line")))
    rows = rows.where("whole <> ''").where(~F.col("whole").rlike(r"^(//|#|\*)"))
    rows = rows.withColumn("t", F.regexp_replace("whole", r"^async ", ""))
    t = F.col("t")
    def_name = text.trim_all(F.regexp_extract(t, r"(?s)^def ([^(:]*)", 1))
    class_name = F.regexp_extract(t, r"(?Us)^class ([^(:\s]*)", 1)
    called = F.regexp_replace(F.regexp_extract(text.trim_all(F.regexp_extract(t, r"(?s)^([^(]*)\(", 1)), r"(?Us)(\S*)$", 1), r"^[*&]+|[*&]+$", "")
    marked = t.rlike(r"public |private |func |void |\{$")
    called = F.when(F.contains(t, F.lit("(")) & F.contains(t, F.lit(")")) & marked & called.rlike(rf"^{text.IDENT}$") & ~called.isin(*NOT_FUNCTIONS), called)
    rows = rows.withColumn("d", F.nullif(def_name, F.lit(""))).withColumn("c", F.nullif(class_name, F.lit(""))).withColumn("f", called)
    is_def, is_class = F.col("d").isNotNull(), F.col("d").isNull() & F.col("c").isNotNull()
    name = F.coalesce("d", "c", "f")
    looks_test = F.contains(name, F.lit("test")) | F.contains("whole", F.lit("[Test")) | F.contains("whole", F.lit("@Test"))
    test = F.when(is_def, F.startswith(name, F.lit("test_"))).otherwise(looks_test)
    kind = F.when(is_def & F.startswith(name, F.lit("test_")), "Test").when(is_class, "Class").otherwise("Function")
    signature = F.when(is_def, F.concat(F.lit("def "), name, F.lit("(…)"))).when(is_class, F.concat(F.lit("class "), name)).otherwise(t)
    public = F.when(is_def, ~F.startswith(name, F.lit("_"))).otherwise(F.contains("whole", F.lit("pub ")) | F.contains("whole", F.lit("public ")))
    number = (F.col("pos") + 1).cast("int")
    return rows.where(name.isNotNull()).select("file", number.alias("sym_idx"), name.alias("name"), kind.alias("kind"), number.alias("start_line"), number.alias("end_line"), signature.alias("signature"), test.alias("is_test"), public.alias("is_public"))


def _keyed(sources: DataFrame) -> DataFrame:
    """``sources`` (file, content) with language and key, the hash of language and content."""
    return sources.withColumn("language", language_of(F.col("file"))).withColumn("key", text.content_key(F.col("language"), F.col("content")))


def _parsed(distinct: DataFrame) -> DataFrame:
    """(key, sym_idx, name, …) of distinct sources (key, language, content).

    Languages with a scanner go through one Arrow pass; the rest, and sources that a scanner cannot read, take the
    line rules, which stay in the JVM.
    """
    known = F.col("language").isin(*scanners.LANGUAGES)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, language, content in zip(batch["key"], batch["language"], batch["content"], strict=True):
                found = scanners.scan(language, content)
                out += [(key, -1, "", "", 0, 0, "", False, False)] if found is None else [(key, i, *s) for i, s in enumerate(found, 1)]
            yield pd.DataFrame(out, columns=["file", "sym_idx", "name", "kind", "start_line", "end_line", "signature", "is_test", "is_public"])

    dealt = distinct.where(known).repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # sources are few bytes and much work
    scanned = settled(dealt.mapInPandas(scan, ROW))
    failed = scanned.where("sym_idx = -1").select(F.col("file").alias("key"))
    by_lines = distinct.where(~known).unionByName(distinct.join(failed, "key", "left_semi"))
    lines = generic_symbols(by_lines.select(F.col("key").alias("file"), "content"))
    return scanned.where("sym_idx > 0").unionByName(lines).withColumnRenamed("file", "key")


def _of_files(keyed: DataFrame, found: DataFrame, with_key: bool) -> DataFrame:
    """Symbols by key as symbols of the files that have the content."""
    rows = keyed.select("file", "key").distinct().join(found, "key")
    helper = F.endswith("file", F.lit("_test.go")) & F.col("kind").isin("Function", "Method")  # functions of Go's test files are tests
    rows = rows.withColumn("is_test", F.col("is_test") | helper).withColumn("kind", F.when(F.col("is_test") & F.col("kind").isin("Function", "Method") & F.endswith("file", F.lit("_test.go")), "Test").otherwise(F.col("kind")))
    return rows if with_key else rows.drop("key")


def extract_symbols(sources: DataFrame, *, with_key: bool = False) -> DataFrame:
    """Symbols of sources (file, content), by the language of the path; equal contents of a language are parsed once.

    ``with_key`` adds key, the hash of language and content, for files that come with several contents.
    """
    keyed = _keyed(sources)
    return _of_files(keyed, _parsed(keyed.select("key", "language", "content").dropDuplicates(["key"])), with_key)


def extract_cached(sources: DataFrame, entries: DataFrame, *, with_key: bool = False) -> tuple[DataFrame, DataFrame]:
    """The same symbols as extract_symbols, and all entries of the cache after it.

    Contents that ``entries`` (version, content_key, symbols) have are not parsed; their symbols are of the file that asks.
    """
    keyed = _keyed(sources)
    distinct = keyed.select("key", "language", "content").dropDuplicates(["key"])
    known = entries.select(F.col("content_key").alias("key"), "symbols").dropDuplicates(["key"])
    misses = distinct.join(known, "key", "left_anti")
    fresh = settled(_parsed(misses))
    fields = [c for c in fresh.columns if c not in ("key", "sym_idx")]
    lists = fresh.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("sym_idx", F.struct(*fields).alias("s"))))["s"].alias("symbols"))
    empty = F.array().cast(lists.schema["symbols"].dataType)
    added = misses.select("key").join(lists, "key", "left").select(F.lit(cache.VERSION).alias("version"), F.col("key").alias("content_key"), F.coalesce("symbols", empty).alias("symbols"))
    hits = distinct.select("key").join(known, "key").select("key", F.posexplode("symbols").alias("i", "s")).select("key", (F.col("i") + 1).alias("sym_idx"), "s.*")
    every = entries.unionByName(added.withColumn("symbols", F.col("symbols").cast(entries.schema["symbols"].dataType)))
    return _of_files(keyed, fresh.unionByName(hits.select(*fresh.columns)), with_key), every
