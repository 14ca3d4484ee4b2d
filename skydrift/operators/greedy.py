"""Priority-greedy selection without sequential code.

Taking the best row, discarding its neighbours and going on equals the lexicographically first
maximal independent set: a row no undecided better neighbour stands against is kept, the
undecided neighbours of kept rows are consumed, and this repeats until none is undecided.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skydrift.runtime import Durable


def greedy_keep(nodes: DataFrame, edges: DataFrame, node: str = "node", ends: tuple[str, str] = ("a", "b")) -> DataFrame:
    """node, keeper: each row with the kept row it belongs to (itself, if it is kept).

    Nodes are unique and ordered by priority: the smaller is the better. A consumed row belongs
    to the best kept row among its better neighbours. Edges may be given in any direction.
    """
    keep = Durable(nodes.sparkSession, "greedy")
    a, b = ends
    e = edges.select(F.least(a, b).alias("good"), F.greatest(a, b).alias("bad")).where("good < bad").distinct()
    live = edges_all = keep.put(e)
    open_ = keep.put(nodes.select(F.col(node).alias("n")).distinct())
    kept = None
    while not open_.isEmpty():
        blocked = live.select(F.col("bad").alias("n")).distinct()
        new = keep.put(open_.join(blocked, "n", "left_anti"))
        gone = live.join(new.withColumnRenamed("n", "good"), "good", "left_semi").select(F.col("bad").alias("n")).distinct()
        rest = keep.put(open_.join(new, "n", "left_anti").join(gone, "n", "left_anti"))
        r = rest.select("n")
        live = keep.put(live.join(r.withColumnRenamed("n", "good"), "good", "left_semi").join(r.withColumnRenamed("n", "bad"), "bad", "left_semi").select("good", "bad"))
        keep.drop(open_)
        open_ = rest
        kept = new if kept is None else kept.union(new)
    if kept is None:
        return nodes.select(F.col(node), F.col(node).alias("keeper")).limit(0)
    own = edges_all.join(kept.withColumnRenamed("n", "good"), "good", "left_semi").groupBy(F.col("bad").alias("n")).agg(F.min("good").alias("k"))
    consumed = own.join(kept, "n", "left_anti")
    return kept.select(F.col("n").alias(node), F.col("n").alias("keeper")).unionByName(consumed.select(F.col("n").alias(node), F.col("k").alias("keeper")))
