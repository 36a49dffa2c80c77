"""Connected components of a links table by alternating large-star and
small-star steps, each an aggregate and a join, cut by staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexicarta.llm.common import Staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: every neighbour above the node is linked to the least of
    the node's neighbourhood; small star: the node and its neighbours below."""
    if large:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        out = near.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        low = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = low.groupBy("a").agg(F.min("b").alias("m"))
        out = (low.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
               .unionByName(least.select("a", F.col("m").alias("b"))))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, staged: Staged, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``edges(a, b)``; root is the least node
    of its component.  Rows with equal ends are ignored."""
    now = staged.write(edges.select("a", "b").where("a <> b").distinct())
    mark = None
    for _ in range(max_rounds):
        now = staged.write(_star(_star(now, True), False))
        staged.drop(staged.count - 1)
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (seen.n, seen.s) == mark:
            break
        mark = (seen.n, seen.s)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = staged.write(now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
                         .unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))
    staged.drop(staged.count - 1)
    return roots
