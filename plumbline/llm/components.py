"""Connected components of a stored edge list, by alternating large and small stars.

Every step is an aggregate (the smallest neighbour, combined before the
shuffle) and a join; no task holds a node's neighbours together. Each round is
written to the shared folder, so the lineage stays short and a lost executor
costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import keep, settled

#: Parts that the edges of one node are dealt over where they look something up.
PARTS = 16


def _least(edges: DataFrame) -> DataFrame:
    """For each node with a smaller neighbour, the smallest one."""
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))


def _with_least(edges: DataFrame, least: DataFrame, end: str, other: str) -> DataFrame:
    """The edges with ``m`` of their node in ``end``, null where it has none; a node's edges are dealt over PARTS tasks."""
    dealt = least.select(F.col("node").alias(end), "m", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    return edges.withColumn("part", F.pmod(F.xxhash64(other), F.lit(PARTS)).cast("int")).join(dealt, [end, "part"], "left")


def _round(edges: DataFrame) -> DataFrame:
    """edges (a, b) with a > b in; the same components with shorter ways to the smallest node out."""
    # A node without a smaller neighbour is its own minimum: its edges stay as they are.
    large = _with_least(edges, _least(edges), "b", "a").select("a", F.coalesce("m", "b").alias("b")).distinct()
    least = _least(large)
    small = _with_least(large, least, "a", "b").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.union(least.select("node", "m")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, comp (its component's smallest node) for all nodes of ``edges`` (a, b: long) but the smallest ones."""
    spark, mark = edges.sparkSession, None
    edges = keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == mark or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
        mark, edges = state, settled(spark, lambda edges=edges: _round(edges), "edges")
