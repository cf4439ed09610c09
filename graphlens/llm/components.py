"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, reliable

#: Rounds grow with the logarithm of the longest path; so many are never needed, and a failure to settle is an error.
ROUNDS = 200


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b): the root is the least node of its component, itself included.

    Each round links every node's larger neighbours to its least one, then all smaller
    neighbours to the least; the edges never grow in number and end as stars. Rounds are
    checkpointed in the shared folder. The least neighbour of a hub is broadcast to
    the hub's edges, so that no hub lands in one task. Without edges there are no rows.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = reliable(edges.where("a <> b").select(high.alias("a"), low.alias("b")).distinct())
    state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    one = F.count(F.lit(1)).alias("_n")
    for _ in range(ROUNDS):
        total = 2 * state[0]
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), one)
        large = join_hot(both, least, ["a"], "_n", total).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = reliable(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"), one)
        small = join_hot(large, least, ["a"], "_n", total).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = reliable(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        before, state = state, tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
    raise RuntimeError("components did not settle")
