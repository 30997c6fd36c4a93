"""What a change touches beyond itself: tests that cover it and sources that depend on it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.paths import is_test_path
from ..plans.barrier import settled
from ..schemas import EVIDENCE, evidence

COVERED_CATEGORIES = ("Behavior", "Security", "ApiBreak", "Auth", "Schema", "Migration")
MOST_LISTED = 8
COVERING = "covering-tests"
#: Bytes of lists of tests that are broadcast at most.
MOST_COVERS = 64 << 20
MOST_TESTS, MOST_SOURCES = 200, 400


def definition_index(definitions: DataFrame) -> DataFrame:
    """(name, files): in how many files a name is defined, from (name, file)."""
    return definitions.groupBy("name").agg(F.count_distinct("file").alias("files"))


def _symbol_keys(symbols: DataFrame, tests: DataFrame) -> DataFrame:
    """(changeset_id, file, name, way, key): what tests may know a changed symbol by, tests themselves left out."""
    names = symbols.where("kind <> 'Module' AND NOT is_test_file").select("changeset_id", "file", text.new_name(F.col("name")).alias("name")).distinct()
    names = names.withColumn("short", text.short_name(F.col("name")))
    own = tests.select("changeset_id", F.col("name").alias("t")).distinct()
    names = names.withColumn("key", F.explode(F.array_distinct(F.array("name", "short"))))
    themselves = names.join(own, (names["changeset_id"] == own["changeset_id"]) & (names["key"] == own["t"]), "left_semi").select("changeset_id", "file", "name").distinct()
    names = names.join(themselves, ["changeset_id", "file", "name"], "left_anti")
    way = lambda kind, key: F.struct(F.lit(kind).alias("way"), key.alias("key"))
    return names.select("changeset_id", "file", "name", F.inline(F.array(way("calls", F.col("key")), way("about", F.lower("key")))))


def _test_keys(tests: DataFrame) -> DataFrame:
    """(changeset_id, way, key, label): the names that a test calls, and those it is about by its own name."""
    label = F.concat("name", F.lit(" ("), "file", F.lit(")"))
    called = tests.select("changeset_id", F.lit("calls").alias("way"), F.explode("calls").alias("key"), label.alias("label"))
    return called.unionByName(tests.select("changeset_id", F.lit("about").alias("way"), F.explode(text.test_cores(F.col("name"))).alias("key"), label.alias("label")))


def coverage_links(symbols: DataFrame, tests: DataFrame) -> DataFrame:
    """(changeset_id, file, name, label): tests that call a changed symbol or are named after it.

    ``symbols``: (changeset_id, file, name, kind, is_test_file); ``tests``: (changeset_id, name, file, calls).  The three
    ways of matching are equi-joins: over called names, over the names a test is about, by full and by short name.
    """
    return _symbol_keys(symbols, tests).join(_test_keys(tests), ["changeset_id", "way", "key"]).select("changeset_id", "file", "name", "label").distinct()


def _targets(items: DataFrame) -> DataFrame:
    rows = items.where(F.startswith("id", F.lit("file:")) | F.startswith("id", F.lit("move:")))
    return rows.select("changeset_id", "id", "files", F.explode("symbols").alias("symbol")).withColumn("name", text.new_name(F.col("symbol")))


def _append(items: DataFrame, proof: Column) -> Column:
    return F.when(proof.isNotNull(), F.concat("evidence", F.array(proof))).otherwise(F.col("evidence")).cast(f"array<{EVIDENCE}>")


def _remarked(items: DataFrame, found: DataFrame, tests: DataFrame) -> DataFrame:
    """Items with the evidence of ``found`` (changeset_id, id, covered, …), or with the remark that there is none; change sets without any test stay as they are."""
    some = tests.select("changeset_id").distinct().withColumn("has_tests", F.lit(True))
    rows = items.join(found, ["changeset_id", "id"], "left").join(some, "changeset_id", "left")
    file = F.get("files", F.lit(0))
    mine = F.coalesce("has_tests", F.lit(False)) & (F.startswith("id", F.lit("file:")) | F.startswith("id", F.lit("move:")))
    untested = mine & F.col("covered").isNull() & F.col("category").isin(*COVERED_CATEGORIES)
    proof = F.when(mine & F.col("covered").isNotNull(), evidence(COVERING, F.concat(F.lit("covered by "), "covered"), file))
    proof = proof.when(untested, evidence("untested-change", "no test references these symbols", file))
    rows = rows.withColumn("evidence", _append(rows, proof))
    return rows.withColumn("why", F.when(untested, F.concat("why", F.lit(" No covering tests reference these symbols."))).otherwise(F.col("why"))).drop("covered", "has_tests")


def _listed() -> Column:
    """Aggregate: the labels of tests in order."""
    return F.array_join(F.array_sort(F.collect_set("label")), ", ").alias("covered")


def apply_coverage(items: DataFrame, links: DataFrame, tests: DataFrame) -> DataFrame:
    """Items with covering tests, or with the remark that there are none; change sets without any test stay as they are."""
    targets = _targets(items).select("changeset_id", "id", "name", F.explode("files").alias("file"))
    return _remarked(items, targets.join(links, ["changeset_id", "file", "name"]).groupBy("changeset_id", "id").agg(_listed()), tests)


def _key_sets(items: DataFrame, symbols: DataFrame, tests: DataFrame, known: DataFrame) -> DataFrame:
    """(changeset_id, id, keys): the keys (way, key) of an item's symbols that some test knows."""
    met = _symbol_keys(symbols, tests).join(known.select("changeset_id", "way", "key").distinct(), ["changeset_id", "way", "key"], "left_semi")
    targets = _targets(items).select("changeset_id", "id", "name", F.explode("files").alias("file"))
    return targets.join(met, ["changeset_id", "file", "name"]).groupBy("changeset_id", "id").agg(F.array_sort(F.collect_set(F.struct("way", "key"))).alias("keys"))


def mark_coverage(items: DataFrame, symbols: DataFrame, tests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items as apply_coverage() has them but for the tests' names, with ``cover``, and (changeset_id, cover, covered), which with_covers() puts in.

    Items whose symbols tests know by the same keys are covered by the same tests.  So tests are listed once for each set
    of keys, and no step between holds items times tests.
    """
    known = settled(_test_keys(tests))
    sets = settled(_key_sets(items, symbols, tests, known).withColumn("cover", F.sha2(F.to_json("keys"), 256)))
    wanted = sets.groupBy("changeset_id", "cover").agg(F.first("keys").alias("keys")).select("changeset_id", "cover", F.inline("keys"))
    covers = settled(wanted.join(known, ["changeset_id", "way", "key"]).groupBy("changeset_id", "cover").agg(_listed()))
    return _remarked(items, sets.select("changeset_id", "id", "cover", F.lit("").alias("covered")), tests), covers


def _group() -> Column:
    """Name of the tests that know a symbol by a key."""
    return F.concat(F.lit("tests "), F.when(F.col("way") == "calls", "calling ").otherwise("named after "), "key")


def mark_groups(items: DataFrame, symbols: DataFrame, tests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items as apply_coverage() has them but with the groups of tests that cover them in place of the tests' names, and the groups
    (changeset_id, tests, label), a row for each test of a group.

    A group is the tests that know symbols by one key; an item's tests are those of its groups together.  So both
    tables grow with items and tests, where the tests' names in each item grow with items times tests.
    """
    known = settled(_test_keys(tests))
    sets = settled(_key_sets(items, symbols, tests, known))
    met = sets.select("changeset_id", F.inline("keys")).distinct()
    groups = known.join(met, ["changeset_id", "way", "key"], "left_semi").select("changeset_id", _group().alias("tests"), "label").distinct()
    named = sets.select("changeset_id", "id", F.inline("keys")).groupBy("changeset_id", "id").agg(F.array_join(F.array_sort(F.collect_list(_group())), ", ").alias("covered"))
    return _remarked(items, named, tests), groups


def with_covers(items: DataFrame, covers: DataFrame) -> DataFrame:
    """Marked items with the names of their tests.  Nothing is shuffled after this by itself; lists are broadcast up to MOST_COVERS bytes."""
    size = covers.agg(F.sum(F.octet_length("covered"))).first()[0] or 0
    rows = items.repartition(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), "changeset_id", "id")
    rows = rows.join(F.broadcast(covers) if size <= MOST_COVERS else covers, ["changeset_id", "cover"], "left")
    named = F.transform("evidence", lambda e: F.when(e["kind"] == COVERING, e.withField("summary", F.concat(e["summary"], F.col("covered")))).otherwise(e))
    return rows.withColumn("evidence", F.when(F.col("covered").isNotNull(), named).otherwise(F.col("evidence"))).select(*[c for c in items.columns if c != "cover"])


def blast_radius(targets: DataFrame, sources: DataFrame, definitions: DataFrame, tests: DataFrame | None = None) -> DataFrame:
    """(changeset_id, id, path): sources outside an item that call its symbols and import them, or could mean no others; a row each.

    ``targets``: (changeset_id, id, files, name); ``sources``: (path, calls, imports); ``definitions``: (name, file).
    """
    unique = definition_index(definitions).where("files = 1").select("name", F.lit(True).alias("unique"))
    names = targets.withColumn("short", text.short_name(F.col("name")))
    if tests is not None:
        names = names.join(tests.select("name").distinct(), "name", "left_anti")
    names = names.join(unique, "name", "left")
    keyed = names.withColumn("key", F.explode(F.array_distinct(F.array("name", "short"))))
    outside = sources.where(~is_test_path(F.col("path")))
    calls = outside.select("path", F.explode("calls").alias("key")).distinct()
    imports = outside.select("path", F.explode("imports").alias("key")).distinct()
    # a name that very many items have and sources call meets only the sources that import it too
    same = keyed.join(calls.join(imports, ["path", "key"], "left_semi"), "key")
    sure = keyed.where("unique").join(calls, "key")
    full, short = names.where("name <> short"), lambda df: df.withColumnRenamed("key", "short")
    mixed = [full.join(a, F.col("name") == F.col("key")).join(short(b), ["path", "short"], "left_semi") for a, b in ((calls, imports), (imports, calls))]
    found = [df.where(~F.array_contains("files", F.col("path"))).select("changeset_id", "id", "path") for df in (same, sure, *mixed)]
    return reduce(DataFrame.unionByName, found).distinct()


def blast_counts(affected: DataFrame) -> DataFrame:
    """(changeset_id, id, n, first) of the rows of blast_radius(): how many sources an item has, and the first ones that are listed."""
    key = ["changeset_id", "id"]
    turn = F.row_number().over(Window.partitionBy(*key).orderBy("path"))
    first = affected.withColumn("turn", turn).where(F.col("turn") <= MOST_LISTED).groupBy(*key).agg(F.array_sort(F.collect_list("path")).alias("first"))
    return affected.groupBy(*key).agg(F.count(F.lit(1)).cast("int").alias("n")).join(first, key)


def blast_digests(affected: DataFrame) -> DataFrame:
    """(changeset_id, id, md5) of each item's sources in order, joined by ``|``: they pass by sorted, and no row or task holds them all."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda key, state: pa.RecordBatch.from_pydict({"changeset_id": [key[0]], "id": [key[1]], "md5": [state.hexdigest()]})
        of, state = None, None
        for batch in batches:
            for changeset, item, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (changeset, item) == of:
                    state.update(b"|" + path.encode())
                    continue
                if state is not None:
                    yield made(of, state)
                of, state = (changeset, item), hashlib.md5(path.encode())
        if state is not None:
            yield made(of, state)

    rows = affected.select("changeset_id", "id", "path").repartition("changeset_id", "id").sortWithinPartitions("changeset_id", "id", "path")
    return rows.mapInArrow(digests, "changeset_id string, id string, md5 string")


def blast_summary() -> Column:
    n = F.col("n")
    more = F.when(n > MOST_LISTED, F.concat(F.lit(" (and "), n - MOST_LISTED, F.lit(" more)"))).otherwise("")
    return F.concat(F.lit("referenced by "), n, F.lit(" file"), F.when(n == 1, "").otherwise("s"), F.lit(": "), F.array_join("first", ", "), more)


def apply_blast_radius(items: DataFrame, sources: DataFrame, definitions: DataFrame, tests: DataFrame | None = None) -> DataFrame:
    """Items with the sources that depend on them."""
    targets = _targets(items).select("changeset_id", "id", "files", "name").distinct()
    rows = items.join(blast_counts(blast_radius(targets, sources, definitions, tests)), ["changeset_id", "id"], "left")
    proof = F.when(F.col("n").isNotNull(), evidence("blast-radius", blast_summary(), F.get("files", F.lit(0))))
    return rows.withColumn("evidence", _append(rows, proof)).drop("n", "first")
