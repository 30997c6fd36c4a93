"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact budget cuts.  DataFrame only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fits_broadcast, written

#: Rows that one range of hash keys should hold; a source gets as many ranges as it needs.
ROWS_PER_RANGE = 10_000


def source_targets(sizes: DataFrame, *, weights=(5.0, 2.0, 1.0), share: float = 1.5, stop: float = 2.0) -> DataFrame:
    """Target of each source, from rows (source, source_size).

    Sources rank by code point, null last, and take ``weights`` in turn.  Together they share ``share`` times all
    sizes by weight; a target stops at ``stop`` times its source's size and the excess is shared again by weight
    until none is above.  That is the water level at which the sum of min(stop * size, level * weight) is the total:
    sources sorted by stop * size / weight fill up one after the other, so a prefix sum gives the level directly.
    The window has one row per source, not per document.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    rows = sizes.select("source", "source_size", F.element_at(cycle, ((rank - 1) % len(weights) + 1).cast("int")).alias("w"))
    rows = rows.withColumn("full_at", F.lit(stop) * F.col("source_size") / F.col("w"))
    order = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rows = (
        rows.withColumn("total", F.lit(share) * F.sum("source_size").over(everything))
        .withColumn("filled", F.coalesce(F.sum(F.lit(stop) * F.col("source_size")).over(upto), F.lit(0.0)))
        .withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(upto), F.lit(0.0)))
        .withColumn("level_here", (F.col("total") - F.col("filled")) / F.col("w_left"))
    )
    level = F.max(F.when(F.col("level_here") <= F.col("full_at"), F.col("level_here"))).over(everything)
    return rows.select(
        "source",
        "source_size",
        F.least(F.lit(stop) * F.col("source_size"), F.coalesce(level, F.col("full_at")) * F.col("w")).alias("target"),
    )


def mix(docs: DataFrame, size, *, id_col: str = "doc_id", source_col: str = "source", seed: str = "mix", weights=(5.0, 2.0, 1.0), share: float = 1.5, stop: float = 2.0) -> DataFrame:
    """Words that a mix takes of each document: id, size, source, source_size, target, taken.

    ``size`` is a column with a document's words, however many.  Every source is put in the order of an MD5 key of the
    document's id; its budget, the target rounded down, takes whole epochs first and then the documents at the front
    of that order, the last of them in part, so each source is cut exactly.  Reruns agree.  Equal ids share a key; ties are
    broken by size and then by the prefix sum itself, so which of two equal rows comes first does not show.
    Nulls: a null source is a source of its own; a null id has a key of its own; a null size counts 0.
    An empty table gives an empty table.  Other columns are not read, so their names cannot clash.

    The texts are read once, for a narrow table of id, source, size and key.  Ranges of the key, enough of them that
    each holds about ROWS_PER_RANGE rows, split a source of any size over tasks: sums of a range (pre-aggregated), prefix
    sums over ranges, then prefix sums within each range.  Rows of one id, and those without id, lie in one range by their key;
    so rows of equal id, size and key are counted and take one place in it.
    """
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.coalesce(size, F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))).alias("key"),
    )
    rows = written(rows)
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    targets = source_targets(sums.select("source", "source_size"), weights=weights, share=share, stop=stop)
    plan = targets.join(sums.select(F.col("source").alias("s2"), "n"), F.col("source").eqNullSafe(F.col("s2"))).select(
        F.col("source").alias("p_source"), "source_size", "target", F.ceil(F.col("n") / ROWS_PER_RANGE).cast("long").alias("ranges")
    )
    plan = written(plan)
    few = fits_broadcast(plan.count(), 200)
    key_number = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")  # 32 bits, so the product stays in a long up to 2**31 ranges
    placed = rows.join(F.broadcast(plan) if few else plan, F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source")
    placed = placed.withColumn("range", F.shiftright(key_number * F.col("ranges"), 32))
    # equal rows are one until they take their words: a run of n rows of one size stands in one place
    runs = placed.groupBy("source", "range", "key", "id", "size").agg(F.count(F.lit(1)).alias("n"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    ranges = runs.groupBy("source", "range").agg(F.sum(F.col("size") * F.col("n")).alias("range_size"))
    before_range = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select(F.col("source").alias("o_source"), F.col("range").alias("o_range"), F.coalesce(F.sum("range_size").over(before_range), F.lit(0)).alias("offset"))
    before = Window.partitionBy("source", "range").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    counted = runs.withColumn("inside", F.coalesce(F.sum(F.col("size") * F.col("n")).over(before), F.lit(0)))
    counted = counted.join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("range") == F.col("o_range")))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    each = counted.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("offset") - F.col("inside") - F.col("copy") * F.col("size")))
    return each.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken")
    )
