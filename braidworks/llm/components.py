"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Edges that a task of a round handles, about; fewer edges than the session's partitions are worth go to fewer tasks.
TASK_EDGES = 4096


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b); root is the component's least node.

    Alternates two steps over edges (u, v) with u > v until they're stars: a node's larger
    neighbours, then its smaller ones and itself, are hung on its least neighbour (Kiveris et
    al., 2014). Each step is a minimum a node, which is combined before the shuffle, and a join that
    adaptive execution splits where a node is hot; no list of neighbours is ever collected.
    Rounds grow with the logarithm of the longest path. Edges are far fewer than the texts they come
    from, so each round's tasks follow their number, and a round over few edges writes few files.
    Empty edges give no rows.
    """
    state = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"))
    total = _digest(state)
    while total[0]:
        few = lambda df: df.coalesce(max(1, -(-total[0] // TASK_EDGES)))  # noqa: B023, E731  no step makes more edges than two an edge
        state = few(state)
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = cut(few(large))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        state = cut(few(few(small.unionByName(least.select("u", F.col("m").alias("v")))).distinct()))
        now = _digest(state)
        if now == total:
            break
        total = now
    roots = state.select(F.col("v").alias("node")).distinct().join(state.select(F.col("u").alias("node")), "node", "left_anti")
    return state.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))


def _digest(edges: DataFrame) -> tuple:
    """Count and order-free hash of the edges: equal if nothing has changed."""
    row = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    return int(row[0]), int(row[1])
