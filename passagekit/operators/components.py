"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagekit.plans.shared import stored

#: Edges whose nodes' least neighbours are broadcast at most (two nodes of 8 to 64 bytes each).
FEW = 250_000


def split(aggregate: DataFrame, *keys: str) -> DataFrame:
    """An aggregate that is to be joined by what it is grouped by, as a shuffle of its own.

    The runtime deals a hot key of the other side to several tasks only where both sides of a
    join are shuffles; an aggregate straight under the join is none, and a repartition by the
    same keys is planned away. So the keys pass a step that the planner does not see through.
    """
    return aggregate.withColumns({k: F.transform(F.array(k), lambda x: x)[0] for k in keys})


def _large_star(edges: DataFrame, side) -> DataFrame:
    """Every larger neighbour of a node is hung on the least of the node's neighbourhood."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (
        both.join(side(least, "a"), "a")
        .where((F.col("b") > F.col("a")) & (F.col("b") != F.col("m")))
        .select(F.col("m").alias("a"), "b")
    )


def _small_star(edges: DataFrame, side) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are hung on the least of them.

    Edges are stored as (a < b), so the smaller neighbours of b are its a's.
    """
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    hung = edges.join(side(least, "b"), "b")
    return (
        hung.select(F.col("m").alias("a"), F.col("a").alias("b"))
        .unionByName(least.select(F.col("m").alias("a"), "b"))
        .where("a <> b")
    )


def components(edges: DataFrame) -> DataFrame:
    """Label nodes of an undirected graph with the least node they can reach.

    ``edges(a, b)`` of one orderable type, self loops and repeats allowed. Returns
    ``(node, root)`` for every node that has an edge to another one. A round is two
    aggregations with map-side minima and two joins; where edges are few (they are counted)
    the minima are broadcast, so that a hub that most edges lead to is not one task's, and
    beyond that they are a shuffle of their own, so that the runtime can split a hub. Rounds grow with the logarithm of a component's
    size. No edge reaches the driver: only two figures per round do, to see whether anything
    changed. An empty table gives an empty result; null ends are no nodes.
    """
    edges = stored(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()[:]

    before = state(edges)
    while before[0]:
        side = (lambda least, key: F.broadcast(least)) if before[0] <= FEW else split
        edges = stored(_small_star(_large_star(edges, side), side).distinct())
        after = state(edges)
        if after == before:
            break
        before = after
    nodes = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return nodes.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
