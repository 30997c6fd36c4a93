"""Places of rows in groups of any size: 1, 2, 3 ... in a total order, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.barrier import settled

#: Rows of a group that one task may order.
MOST_IN_TASK = 1_000_000


def _same(keys: list[str], other: DataFrame) -> tuple[DataFrame, list[str]]:
    """``other`` with its key columns renamed, so that a join on them takes null keys too."""
    named = [f"{k}__of" for k in keys]
    for k, n in zip(keys, named, strict=True):
        other = other.withColumnRenamed(k, n)
    return other, named


def ranged(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``rows`` as a written table sorted by keys and order over all tasks, with ``__part``, a row's range, and ``__at``, its place in it."""
    dealt = rows.repartitionByRange(*[F.col(k) for k in keys], *order).sortWithinPartitions(*keys, *order)
    table = settled(dealt.withColumn("__place", F.monotonically_increasing_id()))
    return table.withColumn("__part", F.shiftright("__place", 33)).withColumn("__at", F.col("__place").bitwiseAND((1 << 33) - 1)).drop("__place")


def _with_offsets(table: DataFrame, offsets: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with ``__offset`` of its range and keys.  Only groups that lie in several ranges have one, so there are no more
    offsets than twice the ranges, and they are broadcast."""
    other, named = _same([*keys, "__part"], offsets)
    condition = F.lit(True)
    for k, n in zip([*keys, "__part"], named, strict=True):
        condition = condition & F.col(k).eqNullSafe(F.col(n))
    return table.join(F.broadcast(other), condition, "left").drop(*named)


def needs_ranges(rows: DataFrame, keys: list[str], most: int = MOST_IN_TASK) -> bool:
    """Whether some group is too large for one task."""
    largest = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return (largest or 0) > most


def numbered(rows: DataFrame, keys: list[str], order: list[Column], name: str, *, most: int = MOST_IN_TASK, next_where: Column | None = None, next_name: str = "next_pos") -> DataFrame:
    """``rows`` with ``name``: the place of each row among those of equal keys, an int from 1.

    ``order`` has to be total; rows that it leaves equal take places in any order.  Null keys are a group.  With ``next_where``
    each row also gets ``next_name``, the place of the first row after it in its group of which that holds, else null.

    Where no group has more than ``most`` rows, each is ordered in one task.  Otherwise the rows are dealt in ranges of
    keys and order, numbered within a range, and moved by the sizes of their group's earlier ranges; the first wanted place
    of later ranges travels the same way.
    """
    if not needs_ranges(rows, keys, most):
        rows = rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        if next_where is None:
            return rows
        after = Window.partitionBy(*keys).orderBy(F.desc(name)).rowsBetween(Window.unboundedPreceding, -1)  # backwards: one pass, where a frame to the end takes one a row
        return rows.withColumn(next_name, F.min(F.when(next_where, F.col(name))).over(after))
    table = ranged(rows, keys, order)
    in_range = Window.partitionBy(*keys, "__part").orderBy("__at")
    of_group = Window.partitionBy(*keys).orderBy("__part")
    sizes = settled(table.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("n")))
    before = sizes.withColumn("__offset", F.sum("n").over(of_group.rowsBetween(Window.unboundedPreceding, -1))).where(F.col("__offset").isNotNull()).drop("n")
    place = F.row_number().over(in_range) + F.coalesce("__offset", F.lit(0))
    table = _with_offsets(table, before, keys).withColumn(name, place.cast("int")).drop("__offset")
    if next_where is not None:
        table = settled(table)
        wanted = F.when(next_where, F.col(name))
        firsts = table.groupBy(*keys, "__part").agg(F.min(wanted).alias("first"))
        later = firsts.withColumn("__offset", F.min("first").over(Window.partitionBy(*keys).orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1))).where(F.col("__offset").isNotNull()).drop("first")
        inside = F.min(wanted).over(Window.partitionBy(*keys, "__part").orderBy(F.desc("__at")).rowsBetween(Window.unboundedPreceding, -1))
        table = _with_offsets(table, later, keys).withColumn(next_name, F.coalesce(inside, F.col("__offset"))).drop("__offset")
    return table.drop("__part", "__at")
