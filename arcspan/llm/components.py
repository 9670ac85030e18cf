"""Connected components of a link table, by alternating large and small stars. Nothing reaches the driver but two counts a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcspan.llm.common import cut


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step on edges (a, b) with a > b."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    # large star: each larger neighbour points to the least of the neighbourhood
    large = edges.join(least, edges["b"] == least["k"]).select("a", F.col("m").alias("b")).where("a > b").distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    # small star: each smaller neighbour, and the node itself, point to the least one
    small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
    return small.select("e.*").where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """For each node of the links (a, b): node, root, the least node it is linked to. Null ends are ignored."""
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = cut(pairs), None
    while True:
        state = now.agg(F.count("*"), F.count_distinct("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        now = cut(_stars(now))
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
