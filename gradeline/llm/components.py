"""Connected components by alternating large-star and small-star steps, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeline.llm.common import cut, join_copies


def connected_components(edges: DataFrame) -> DataFrame:
    """(`node`, `component`) for every node of `edges` (`a`, `b`): the smallest node that links reach.

    Each step keeps at most as many edges as the one before and is written to the shared folder; nodes, edges and
    components stay distributed. Edges learn the smallest neighbour of their smaller end by a join that deals the edges of
    busy nodes to many tasks. Steps end as soon as the edges are stars, which the nodes' degrees tell; then each node's
    smallest neighbour is its component. Null ends link nothing; without edges there are no rows.

    The driver keeps an entry for each task of the last stages, so edges are read once for both directions, and one grouped
    sum gives minima, degrees and the end.
    """
    kind = edges.schema["a"].dataType
    edges = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        ends = F.array(F.struct("a", "b", F.lit(1).alias("up")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(0).alias("up")))
        nodes = edges.select(F.explode(ends).alias("end")).groupBy(F.col("end.a").alias("node"))
        # up, down: edges to smaller and to larger nodes
        low = cut(nodes.agg(F.least(F.min("end.b"), F.first("end.a")).alias("m"), F.sum("end.up").alias("up"), F.sum(1 - F.col("end.up")).alias("down")))
        # stars: every larger end has one edge and is no smaller end
        between = (F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))
        total, unlike = low.agg(F.sum("down"), F.max(between.cast("int"))).first()
        if unlike != 1:
            return low.select(F.col("node").cast(kind).alias("node"), F.col("m").cast(kind).alias("component"))
        minima = low.filter("down > 0").select(F.col("node").alias("b"), "m", "down")
        large = join_copies(edges, minima, "b", "down", total=total).select("a", F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        both = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))
        edges = cut(large.join(least, "a").select(F.explode(both).alias("edge")).select("edge.*").filter("a <> b").distinct())
