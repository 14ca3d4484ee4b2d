"""Connected components by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skydrift.runtime import Durable


def components(nodes: DataFrame, edges: DataFrame, node: str = "node", ends: tuple[str, str] = ("a", "b")) -> DataFrame:
    """node, component (the smallest node of its component) for every node.

    Each round a node takes the smallest label among its own and its neighbours', then the label
    of that label, which makes the rounds logarithmic in the longest path. Edges with a null end
    or an end that is no node link nothing.
    """
    spark = nodes.sparkSession
    keep = Durable(spark, "components")
    a, b = ends
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    both = keep.put(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    now = keep.put(nodes.select(F.col(node).alias("n")).where("n is not null").distinct().withColumn("l", F.col("n")))
    if both.isEmpty():
        return now.select(F.col("n").alias(node), F.col("l").alias("component"))
    while True:
        heard = both.join(now, both["v"] == now["n"]).groupBy("u").agg(F.min("l").alias("m"))
        low = now.join(heard, now["n"] == heard["u"], "left").select("n", "l", F.least("l", F.coalesce("m", "l")).alias("m"))
        # jump: what the node behind the label hears, if anything; worked out twice rather than written down in between
        ahead = low.select(F.col("n").alias("t"), F.col("m").alias("tm"))
        best = F.least("m", F.coalesce("tm", "m"))
        new = keep.put(low.join(ahead, F.col("m") == F.col("t"), "left").select("n", best.alias("l"), (best != F.col("l")).alias("moved")))
        moved = new.where("moved").limit(1).count()
        keep.drop(now)
        now = new
        if not moved:
            return now.select(F.col("n").alias(node), F.col("l").alias("component"))
