"""Connected components of links between documents, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fits_broadcast, written


def _counted(edges: DataFrame) -> tuple[int, int]:
    """Number of ``edges`` (u, v), and of nodes that keep them from being stars: with two roots, or below a root and a root."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("root")).unionByName(edges.select("v", F.lit(0), F.lit(1)).toDF("node", "below", "root"))
    nodes = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("root").alias("root"))
    rows, loose = nodes.agg(F.sum("below"), F.count_if((F.col("below") > 1) | ((F.col("below") > 0) & (F.col("root") > 0)))).first()
    return rows or 0, loose


def connected_components(links: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b), longs; a component is named by its smallest node.

    Each round hangs every node's larger neighbours on its smallest neighbour (large star), then the node and its
    smaller neighbours too (small star); it ends when all links are stars, after about log**2 rounds at most, and links that
    are stars around their smallest nodes take no round.  Minima are pre-aggregated, and broadcast while the counted links allow;
    else a hub's links are rows of a join that can be split.  Every round is written to the shared
    folder.  Loops and repeated links do no harm; no links give no rows.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(most_rounds):
        rows, loose = _counted(edges)
        if not loose:
            break
        small = fits_broadcast(2 * rows, 40)
        near = F.broadcast if small else lambda df: df
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(near(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large if small else large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(near(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        before, edges = edges, written(hung)
        discard(before)
    else:
        raise RuntimeError("connected components did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
