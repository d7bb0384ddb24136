"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxspark.llm.common import cut


def _stars(e: DataFrame) -> bool:
    """Whether every upper end (a) has one edge and is nobody's lower end (b)."""
    ends = e.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("low")).unionByName(e.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("low")))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.sum("low").alias("low")).where("up > 1 or up = 1 and low > 0").isEmpty()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges: (a, b) of any orderable type, undirected; repeated edges and loops are allowed, nulls are ignored.
    Returns (node, root): each node that stands in an edge to another node, with the smallest node it reaches.

    Rounds of the large-star and small-star steps: each ties a node's neighbours to the smallest of them. Edges stay as
    many as nodes, the minimum is aggregated before the shuffle, and the join with it is an ordinary skew-splittable
    one, so a node with very many neighbours loads no single task. Each step ends in a shared scratch table; it is over
    once all edges make stars, and rounds grow with the logarithm of the longest chain. An empty input gives an empty
    result."""
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    for _ in range(max_rounds):
        if _stars(e):
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "n")
        # large star: neighbours above the node go to the smallest
        up = both.where("b > a").join(low, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(up.where("a <> b").distinct())
        # small star: the node and its smaller neighbours go to the smallest
        low = e.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        down = e.join(low, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(down.unionByName(low.select(F.col("n").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct())
    raise RuntimeError("components: no star forest within the given rounds")
