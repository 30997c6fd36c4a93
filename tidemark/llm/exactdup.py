"""Exact duplicates by deterministic block naming.  DataFrame only.

Texts are cut into blocks of a fixed size; the sorted different blocks give each block its rank as an integer name, the
sorted different pairs of neighbouring names the next level's names, and so on, until one name is left of a document.
Names stand for contents, not for hashes, so two documents have one identity only if their texts are the same bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fits_broadcast, split_join, written

#: Bytes of a block.
BLOCK = 256

#: Stands beside the last name of a level of odd length.
NONE = -1


def ranked(found: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame:
    """Rows with different ``keys``, with ``name``: a row's rank in the order of the keys, from 0, whatever the partitions.

    A range sort; then the sizes of the ranges before it (one number per range) turn a row's place in its range into its rank.
    """
    ordered = found.repartitionByRange(*keys).sortWithinPartitions(*keys)
    table = scratch(ordered.withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33).cast("int")
    sizes = {r["part"]: r["n"] for r in table.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, offsets = 0, []
    for p in range(max(sizes, default=-1) + 1):
        offsets.append(str(before))
        before += sizes.get(p, 0)
    offset = F.element_at(F.split(F.lit(",".join(offsets or ["0"])), ",").cast("array<long>"), part + 1)
    return table.withColumn("name", offset + F.col("place").bitwiseAND((1 << 33) - 1)).drop("place")


def identities(texts: DataFrame, scratch: Scratch, *, block: int = BLOCK) -> DataFrame:
    """(rid, level, name) of rows (rid, text): equal binary texts, and only they, have the same level and name.

    ``texts`` is a written table.  A document's names travel as one array, 8 bytes for each block.  Blocks and pairs that
    many documents share are named where they are (``split_join``); all others meet their names in a shuffle.
    """
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("text") / block)).cast("int")
    cut = texts.select("rid", "text", F.explode(F.sequence(F.lit(0), count - 1)).alias("pos"))
    cut = cut.select("rid", "pos", F.substring("text", F.col("pos") * block + 1, F.lit(block)).alias("block"))
    named = split_join(cut, ranked(cut.groupBy("block").agg(F.count(F.lit(1)).alias("n")), ["block"], scratch), ["block"], "n")
    level, done = 0, None
    while True:
        in_order = F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"])
        names = scratch(named.groupBy("rid").agg(in_order.alias("names")))
        ready = names.where(F.size("names") == 1).select("rid", F.lit(level).alias("level"), F.element_at("names", 1).alias("name"))
        done = ready if done is None else done.unionByName(ready)
        if not names.where(F.size("names") > 1).head(1):
            return done
        pos = F.explode(F.sequence(F.lit(0), F.ceil(F.size("names") / 2).cast("int") - 1)).alias("pos")
        pairs = names.where(F.size("names") > 1).select("rid", "names", pos)
        pairs = pairs.select("rid", "pos", F.get("names", F.col("pos") * 2).alias("a"), F.coalesce(F.get("names", F.col("pos") * 2 + 1), F.lit(NONE)).alias("b"))
        named = split_join(pairs, ranked(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), ["a", "b"], scratch), ["a", "b"], "n")
        level += 1


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Groups of equal texts: id, keep_id, group_size, kept, text_sha256, a row for every document.

    A null text is the empty one; texts are compared as their UTF-8 bytes, whole, however long.  Of a group the largest id
    stays; null ids come after all others; of repeated rows one stays, and all count in the size.  An empty table gives an
    empty table; other columns are not read.

    A document whose length and first block no other one has is identified by them and needs no further names; all
    others (``twin``) are named to the end.  The SHA-256 is of the result only and decides nothing.
    """
    scratch = Scratch()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    rows = rows.select("id", "text", F.octet_length("text").alias("n_bytes"), F.substring("text", 1, block).alias("head"))
    shared = scratch(rows.groupBy("n_bytes", "head").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("twin", F.lit(True)))
    if fits_broadcast(shared.count(), block + 32):
        flagged = rows.join(F.broadcast(shared.drop("n")), ["n_bytes", "head"], "left")
    else:
        flagged = split_join(rows, shared, ["n_bytes", "head"], "n", "left")
    held = scratch(
        flagged.select(F.monotonically_increasing_id().alias("rid"), "id", "n_bytes", F.sha2("text", 256).alias("sha"), F.col("twin").isNotNull().alias("twin"), F.when(F.col("twin"), F.col("text")).alias("text"))
    )
    single = held.where("NOT twin").select(F.col("id").alias(id_col), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    twins = held.where("twin")
    found = identities(twins.select("rid", "text"), scratch, block=block)
    members = scratch(twins.select("rid", "id", "n_bytes", "sha").join(found, "rid"))
    best = F.max(F.struct("id", "rid")).alias("best")  # a null id is the smallest
    groups = scratch(members.groupBy("n_bytes", "level", "name").agg(best, F.count(F.lit(1)).alias("group_size"), F.count(F.lit(1)).alias("n")))
    met = split_join(members, groups, ["n_bytes", "level", "name"], "n")
    grouped = met.select(F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), "group_size", (F.col("rid") == F.col("best.rid")).alias("kept"), F.col("sha").alias("text_sha256"))
    result = written(single.unionByName(grouped))
    scratch.clear()
    return result
