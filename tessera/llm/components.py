"""Connected components of an edge table by alternating large and small stars (Kiveris and others, 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, drop_cut


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a long, b long); the component is its smallest node.

    Every round is two aggregations and two joins on tables of edges; the neighbours of a node are never gathered, so a
    node with very many only makes a skewed join. Each round is written to the shared folder. No edges give no rows.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct(), "stars")
    for _ in range(rounds):
        state = now.agg(F.count("*").alias("n"), F.countDistinct("v").alias("v")).first()
        inner = now.select(F.col("m").alias("v")).distinct().join(now, "v", "left_semi").limit(1).count()
        if state.n == state.v and not inner:  # every node points at its root, and no root points on
            break
        both = now.select(F.col("v").alias("u"), F.col("m").alias("w")).union(now.select(F.col("m").alias("u"), F.col("v").alias("w")))
        least = both.groupBy("u").agg(F.min("w").alias("x")).select("u", F.least("u", "x").alias("x"))
        large = both.where("w > u").join(least, "u").where("w <> x").select(F.col("w").alias("v"), F.col("x").alias("m")).distinct()
        least = large.groupBy("v").agg(F.min("m").alias("x"))
        small = large.join(least, "v").where("m <> x").select(F.col("m").alias("v"), F.col("x").alias("m")).union(least.select("v", F.col("x").alias("m")))
        before, now = now, cut(small.distinct(), "stars")
        drop_cut(before)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("v").alias("node"), F.col("m").alias("component")).union(now.select("m", "m").distinct())
