"""Connected components by alternating star contraction on DataFrames.

Each round points every larger neighbour of a node to the node's smallest neighbour (large star), then every
smaller one (small star); the edges end as stars around the smallest node of each component. Rounds are written
to the shared folder, so lineage stays short and a lost executor costs one round. Edges with a hot end are only
aggregated by minimum and joined to one row per node; nothing is gathered. Edges become fewer, so a round's tables have as
many parts as their rows need (``EDGES_IN_PART``, and a few more), not one for every shuffle partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loantide.session import written

LEAST_PARTS, EDGES_IN_PART = 8, 100_000


def _stars(edges: DataFrame, both_ways: bool, parts: int) -> DataFrame:
    """``edges`` are (u > v), written. Large star looks at all neighbours of a node, small star at the smaller ones."""
    if both_ways:
        seen = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = seen.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        low = written(low.coalesce(parts), "low")  # one row per node, written: a hot node's edges can then be split
        # larger neighbours of ``node`` are the edges where it is the smaller end
        hung = edges.select(F.col("v").alias("node"), F.col("u").alias("other")).join(low, "node").select(F.col("other").alias("u"), F.col("m").alias("v"))
        return hung.where("u > v").distinct().coalesce(parts)
    low = written(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).coalesce(parts), "low")
    moved = edges.select(F.col("u").alias("node"), F.col("v").alias("other")).join(low, "node").where("other <> m").select(F.col("other").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select(F.col("node").alias("u"), F.col("m").alias("v"))).distinct().coalesce(parts)


def _open(edges: DataFrame) -> tuple[int, int]:
    """The edges, and the ends that keep them from being stars: larger ends with several edges or below another larger end."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    each = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return tuple(each.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count_if((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("down") == 1)))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) of every node of ``edges`` (``a, b``: longs, any order).

    Loops and repeated edges are allowed; nodes without an edge to another node are not returned; an edge with a
    null end is ignored.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = written(e, "edges")
    while True:
        n, open_ends = _open(e)
        if not open_ends:
            break
        parts = n // EDGES_IN_PART + LEAST_PARTS
        # each half is written: the small star reads the large one twice
        e = written(_stars(written(_stars(e, True, parts), "edges"), False, parts), "edges")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
