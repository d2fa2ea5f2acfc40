"""Connected components of a graph of 64-bit nodes, by alternating stars.

In a large star every node links its larger neighbours to the smallest node it
knows; in a small star it links itself and its smaller neighbours to that node.
Alternating both shrinks any graph to one star for each component. A node's
smallest neighbour comes from an aggregation with partial sums, and a node with
very many links is split by the join, so no task holds a whole neighbourhood.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitweave.llm.common import stored


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def _open(edges: DataFrame) -> bool:
    """Whether some node has two links down, or is linked to and has a link down."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionAll(edges.select(F.col("v").alias("n"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    seen = ends.groupBy("n").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return not seen.where("down > 1 or down = 1 and up = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes with a link; the component is its smallest node.

    edges: u and v, long, in any order and with repeats. Loops link nothing.
    Each round is written to the shared folder, so a lost executor costs a
    round at most. No edges give no rows.
    """
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    down = stored(down, "edges")
    while _open(down):
        down = stored(_small(_large(down)), "edges")
    return down.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(down.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
