"""Connected components of a table of links.

Alternating large-star and small-star steps (Kiveris et al., 2014): each step is
a grouped minimum and a join, never a neighbour list, so a node with many links
is only a skewed join key. Every round is written to the shared scratch folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askmill.session import materialise


def _star(edges: DataFrame) -> DataFrame:
    """Each edge ``(u, v)`` with the least ``v`` of its ``u``, as ``m``."""
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")


def _is_done(edges: DataFrame) -> bool:
    """Whether every node hangs on one other node, and that one on none."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds"))
    )
    nodes = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return nodes.where("hangs + holds > 1").isEmpty()


def stars(edges: DataFrame) -> DataFrame:
    """``(u, v)``: each node that is not the least of its component, with that least node.

    ``edges`` holds links ``(u, v)`` between integers, in either direction,
    repeated or not. Links of a node with itself and links with a null are none.
    """
    greater, less = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    now = materialise(edges.dropna().where("u <> v").select(greater, less).distinct(), "links")
    while not _is_done(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        down = _star(large)
        small = down.select("u", F.col("m").alias("v")).unionByName(
            down.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        now = materialise(small.distinct(), "links")
    return now


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node that has a link; a component is named by its least node."""
    found = stars(edges)
    own = found.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return found.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(own)
