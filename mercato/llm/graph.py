"""Connected components of a graph of any size, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import drop_unused, freeze


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of longs -> (node, root): the smallest node that each node reaches.

    Large star and small star in turn: each node hands its larger neighbours, then its
    smaller ones, to the smallest it knows, until the edges are stars around their least
    node. A round is two aggregates and two joins; rounds grow with the logarithm of the
    size. Minima are combined before the shuffle, so a hub costs its edges, not their square.
    Files of a round go with the next."""
    star = freeze(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
        large = (both.where("b > a").join(least, F.col("a") == F.col("node")).where("b != m")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), "m")
        small = (large.join(low, F.col("a") == F.col("node"))
                 .select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
                                           F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
                 .select("e.a", "e.b").where("a != b").distinct())
        star = freeze(small)
        drop_unused(star.sparkSession)
        now = star.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        if now == mark:
            break
        mark = now
    return star.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        star.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
