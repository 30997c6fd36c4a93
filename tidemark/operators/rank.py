"""Orders, cuts and gates over review items.  Every order is total: titles or ids settle what severity and priority leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import SEVERITIES, VERDICTS, rank_of
from .numbering import MOST_IN_TASK, numbered

MOST_JUDGED = 25
GROUP = ["changeset_id"]


def _order(*tie: str) -> list[Column]:
    return [F.desc("severity_rank"), F.desc("priority"), *map(F.col, tie)]


def review_places() -> list[Column]:
    """The order of a review: severity, priority and title."""
    return _order("title", "id")


def _first(items: DataFrame, most: int, *tie: str) -> DataFrame:
    """The first ``most`` items of each change set; every task drops its own others before rows meet."""
    turn = F.row_number().over(Window.partitionBy(*GROUP).orderBy(*_order(*tie)))
    return items.withColumn("pos", turn).where(F.col("pos") <= most)


def review_order(items: DataFrame, *, most: int = MOST_IN_TASK) -> DataFrame:
    """``items`` with pos, their place in the order of severity, priority and title; change sets of more than ``most`` items are
    ordered by many tasks."""
    return numbered(items, GROUP, _order("title", "id"), "pos", most=most)


def judged(items: DataFrame, most: int = MOST_JUDGED) -> DataFrame:
    """The first meaningful items by severity, priority and id."""
    return _first(items.where("category <> 'Mechanical'"), most, "id")


def candidates(items: DataFrame, floor: str = "High", most: int = 10) -> DataFrame:
    """Meaningful items from a severity up, in review order, no more than ``most`` and never more than 25."""
    least = SEVERITIES.index(floor)
    rows = items.where((F.col("category") != "Mechanical") & (F.col("severity_rank") >= least))
    return _first(rows, min(most, MOST_JUDGED), "title", "id")


def gate(items: DataFrame, threshold: str) -> DataFrame:
    """The meaningful item that trips a severity gate, one row per change set at most; of equals the last title."""
    rows = items.where((F.col("category") != "Mechanical") & (F.col("severity_rank") >= SEVERITIES.index(threshold)))
    best = F.max_by(F.struct("id", "title", "severity", "priority"), F.struct("severity_rank", "priority", "title", "id"))
    return rows.groupBy("changeset_id").agg(best.alias("b")).select("changeset_id", "b.*")


def task_gate(verdict: Column, threshold: str) -> Column:
    """Whether a task verdict is the threshold or worse."""
    return rank_of(verdict, VERDICTS) <= VERDICTS.index(threshold)


def visible(items: DataFrame, *, search: str = "", show_mechanical: bool = False, members: DataFrame | None = None, most: int = MOST_IN_TASK) -> DataFrame:
    """Items that a list shows: by a search in title and files, mechanical ones on demand; shown_pos counts them.

    ``members`` (changeset_id, id, path) are the files of buckets that come without them.
    """
    q = search.lower()
    rows = items if show_mechanical else items.where("category <> 'Mechanical'")
    if q:
        found = F.contains(F.lower("title"), F.lit(q)) | F.exists("files", lambda f: F.contains(F.lower(f), F.lit(q)))
        if members is not None:
            hits = members.where(F.contains(F.lower("path"), F.lit(q))).select("changeset_id", "id").distinct().withColumn("hit", F.lit(True))
            rows = rows.join(hits, ["changeset_id", "id"], "left").where(found | F.coalesce("hit", F.lit(False))).drop("hit")
        else:
            rows = rows.where(found)
    return numbered(rows, GROUP, _order("title", "id"), "shown_pos", most=most)


def next_meaningful(items: DataFrame, *, most: int = MOST_IN_TASK) -> DataFrame:
    """Items in review order with next_pos, the next place that is neither mechanical nor a test; null after the last."""
    return numbered(items, GROUP, _order("title", "id"), "pos", most=most, next_where=~F.col("category").isin("Mechanical", "Test"))


def in_range(rows: DataFrame, pos: str, first: int, last: int) -> DataFrame:
    """Rows of a window of places."""
    return rows.where(F.col(pos).between(first, last))


def selected(items: DataFrame, n: int, **how) -> DataFrame:
    """The n-th visible item of each change set, counted from 0."""
    return visible(items, **how).where(F.col("shown_pos") == n + 1)
