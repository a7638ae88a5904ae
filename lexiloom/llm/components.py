"""Connected components over an edge table, by alternating large and small stars.

DataFrame operations only. Each step needs the smallest neighbour of a node,
an aggregate that combines before the shuffle, and a join back that adaptive
execution can split for hub nodes. Every round is cut by a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shelf import Shelf


def _star(pairs: DataFrame, small: bool) -> DataFrame:
    """One star step on (u, v) rows; small: only v < u, else v > u get moved."""
    if small:
        both = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        both = pairs.union(pairs.select("v", "u"))
    low = both.groupBy("u").agg(F.min("v").alias("m"))
    low = low.select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    met = both.join(low, both.u == low.k)
    if small:
        moved = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(met.select("u", F.col("m").alias("v")))
    else:
        moved = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u != v").distinct()


def connected_components(edges: DataFrame, src: str, dst: str, shelf: Shelf, rows: int | None = None) -> DataFrame:
    """(node, component) for every node that has an edge; component: its smallest node.

    Works on any orderable type. Null ends and self-loops are ignored, repeated
    edges count once, an empty table gives an empty result. Nodes without an
    edge are their own component and aren't listed. ``rows``: a bound of the
    number of edges, if known.
    """
    now = shelf.keep(edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"), F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a != b").select("u", "v").distinct(), rows)
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).head()
        if not mark[0] or tuple(mark) == seen:
            break
        seen = tuple(mark)
        after = shelf.keep(_star(_star(now, small=False), small=True), 2 * mark[0])
        shelf.drop(now)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
