"""Session helpers shared by the corpus operators, and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import shared_dir, shipped, staged, table

__all__ = ["connected_components", "n_shuffle", "shared_dir", "shipped", "staged", "table"]


def n_shuffle(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of an undirected graph given as (a, b) rows of longs; component is the
    smallest node reachable. Distributed union-find by alternating large-star and small-star
    steps, each one exchange by node; only one flag per round reaches the driver. edges are read
    once. Nodes without an edge are absent."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    # rows that repeat are next to each other in both orders
    near, order = W.partitionBy("u").orderBy("v"), W.partitionBy("u").orderBy("v", F.desc("moved"))
    for _ in range(max_rounds):
        both = e.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        large = both.withColumns({"m": F.least("u", F.first("v").over(near)), "last": F.lag("v").over(near)})
        large = large.where("v > u and not last <=> v").select(F.col("v").alias("u"), F.col("m").alias("v"), F.expr("m <> u").alias("moved"))
        small = large.withColumns({"m": F.first("v").over(order), "last": F.lag("v").over(order)}).where("not last <=> v")
        e = staged(small.select(F.expr("if(v = m, u, v)").alias("u"), F.col("m").alias("v"), F.expr("moved or v <> m").alias("moved")), "edges")
        if not e.agg(F.max("moved")).first()[0]:
            break
    else:
        raise RuntimeError("connected components did not converge")
    return e.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("component")), F.struct(F.col("v").alias("node"), F.col("v").alias("component"))))).distinct()
