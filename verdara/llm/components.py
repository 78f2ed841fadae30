"""Connected components of an edge table, by contraction; no group is ever gathered in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdara.llm.common import cut


def connected(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges(a long, b long)``; nodes of one component share a label.

    Every round maps each node to the least of itself and its neighbours and contracts the edges;
    the maps are composed at the end. Even rounds compare ids, which ends stars at once; odd rounds
    compare hashes, which halves long paths. Nulls and self-loops are ignored; repeated edges count once.
    """
    left = cut(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b").distinct())
    labels = left.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node"))
    turn = 0
    while not left.isEmpty():
        key = F.col if turn % 2 == 0 else (lambda c, t=turn: F.xxhash64(F.col(c), F.lit(t)))
        both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min(F.struct(key("b").alias("o"), F.col("b").alias("id"))).alias("m"))
        own = F.struct(key("a").alias("o"), F.col("a").alias("id"))
        step = cut(near.select(F.col("a").alias("node"), F.least(F.col("m"), own)["id"].alias("to")))
        labels = labels.join(step.select(F.col("node").alias("label"), "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        ends = left.join(step.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(step.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        left = cut(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        turn += 1
    return cut(labels)
