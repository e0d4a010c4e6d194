"""Graph operators on edges(graph_id, source, target, weight), all graphs of a frame at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import staged


def symmetric(edges: DataFrame) -> DataFrame:
    """(graph_id, node, other, weight) in both directions."""
    return edges.select("graph_id", F.col("source").alias("node"), F.col("target").alias("other"), "weight").unionByName(
        edges.select("graph_id", F.col("target").alias("node"), F.col("source").alias("other"), "weight")
    )


def non_isolated(edges: DataFrame) -> DataFrame:
    return symmetric(edges).select("graph_id", F.col("node").alias("id")).distinct()


def neighbours(edges: DataFrame, of: DataFrame) -> DataFrame:
    """(graph_id, term, node, weight) next to each of of(graph_id, term)."""
    s = symmetric(edges).select("graph_id", F.col("node").alias("term"), F.col("other").alias("node"), "weight")
    return s.join(of.select("graph_id", "term"), ["graph_id", "term"])


def _second(edges: DataFrame, one: DataFrame) -> DataFrame:
    """(graph_id, term, node, score) of nodes one step beyond one(graph_id, term, node, weight)."""
    step = symmetric(edges).select("graph_id", F.col("node").alias("mid"), F.col("other").alias("node"), F.col("weight").alias("w2"))
    reached = one.select("graph_id", "term", F.col("node").alias("mid"), F.col("weight").alias("w1")).join(step, ["graph_id", "mid"]).where("node <> term")
    reached = reached.join(one.select("graph_id", "term", "node"), ["graph_id", "term", "node"], "left_anti")
    return reached.groupBy("graph_id", "term", "node").agg(F.max(F.col("w1") * F.col("w2")).alias("score"))


def _neighbours(edges, terms: DataFrame) -> DataFrame:
    """neighbours() in a frame of edges, or in a graph that makes only the edges asked for, whose
    neighbours are written, as they are read more than once."""
    if isinstance(edges, DataFrame):
        return neighbours(edges, terms)
    return staged(neighbours(edges.at(terms.select("graph_id", F.col("term").alias("id"))), terms), "one")


def _two_hop(edges, one: DataFrame) -> DataFrame:
    return _second(edges, one) if isinstance(edges, DataFrame) else edges.two_hop(one)


def two_hop(edges, terms: DataFrame) -> DataFrame:
    """(graph_id, term, node, score) of nodes two steps away: the largest product of two weights. Here
    and below edges is a frame, or a graph that makes only the edges asked for (cooccur.PmiGraph)."""
    return _two_hop(edges, _neighbours(edges, terms))


def ranked(edges, terms: DataFrame) -> DataFrame:
    """(graph_id, term, node, hop, score): the neighbourhood of each term."""
    one = _neighbours(edges, terms)
    first = one.select("graph_id", "term", "node", F.lit(1).alias("hop"), F.col("weight").alias("score"))
    return first.unionByName(_two_hop(edges, one).select("graph_id", "term", "node", F.lit(2).alias("hop"), "score"))


def proximity(edges, wanted: DataFrame) -> DataFrame:
    """Score of each wanted(graph_id, term, node): the edge's weight, else the best two-step
    product, else 0."""
    r = ranked(edges, wanted.select("graph_id", "term").distinct())
    return wanted.join(r, ["graph_id", "term", "node"], "left").select("graph_id", "term", "node", F.coalesce("score", F.lit(0.0)).alias("score"))


def ego(edges: DataFrame, terms: DataFrame, radius: int = 2) -> DataFrame:
    """(graph_id, term, node) within radius steps, the term included."""
    s = symmetric(edges).select("graph_id", "node", "other")
    out = terms.select("graph_id", "term", F.col("term").alias("node")).join(non_isolated(edges).withColumnRenamed("id", "node"), ["graph_id", "node"], "left_semi")
    for _ in range(radius):
        out = out.unionByName(out.join(s, ["graph_id", "node"]).select("graph_id", "term", F.col("other").alias("node"))).distinct()
    return out


def within_two(edges, terms: DataFrame) -> DataFrame:
    """ego() of radius 2, from the neighbourhood alone."""
    r = ranked(edges, terms)
    centre = r.select("graph_id", "term", F.col("term").alias("node")).distinct()
    return r.select("graph_id", "term", "node").unionByName(centre)


def _first(ranked: DataFrame, k: int) -> DataFrame:
    """The first k rows of each graph with their rank; the planner limits each task's rows to k before
    they are shuffled."""
    w = W.partitionBy("graph_id").orderBy(F.asc("hop"), F.desc("score"), F.asc("node"))
    return ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_neighbourhood(edges: DataFrame, terms: DataFrame, max_nodes: int) -> DataFrame:
    """The nodes that stay: direct neighbours by weight, then two-step ones by product; ties by
    node. One window does for both limits."""
    return _first(ranked(edges, terms), max_nodes)


def first_neighbours(edges, terms: DataFrame, max_nodes: int) -> DataFrame:
    """The direct neighbours in top_neighbourhood(), which come first in it: no second step is made."""
    one = _neighbours(edges, terms)
    return _first(one.select("graph_id", "term", "node", F.lit(1).alias("hop"), F.col("weight").alias("score")), max_nodes)


def induced(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges with both ends in keep(graph_id, id)."""
    for c in ("source", "target"):
        edges = edges.join(keep.select("graph_id", F.col("id").alias(c)), ["graph_id", c], "left_semi")
    return edges.select("graph_id", "source", "target", "weight")


class ListedGraph:
    """Edges that are at hand, as parts that pruned() asks for."""

    def __init__(self, edges: DataFrame):
        self.edges = staged(edges.select("graph_id", "source", "target", "weight"), "edges")

    def at(self, nodes: DataFrame) -> DataFrame:
        ends = [nodes.select("graph_id", F.col("id").alias(c)).distinct() for c in ("source", "target")]
        first = self.edges.join(ends[0], ["graph_id", "source"], "left_semi")
        rest = self.edges.join(ends[0], ["graph_id", "source"], "left_anti").join(ends[1], ["graph_id", "target"], "left_semi")
        return first.unionByName(rest)

    def among(self, nodes: DataFrame) -> DataFrame:
        return induced(self.edges, nodes)

    def graphs(self) -> DataFrame:
        return self.edges.select("graph_id").distinct()

    def whole(self, graphs: DataFrame) -> DataFrame:
        return self.edges.join(graphs, "graph_id", "left_semi")


def pruned(edges, terms: DataFrame, max_nodes: int) -> DataFrame:
    """Each graph around its term, at most max_nodes nodes beside it. A graph whose term has no
    edge is returned whole. edges is a frame, or a graph that makes only the edges asked for: those at
    the term, those at its neighbours where they are too few, and those among the nodes that stay.
    What is carried from step to step is max_nodes rows a graph."""
    if isinstance(edges, DataFrame):
        edges = ListedGraph(edges)
    terms = terms.select("graph_id", "term")
    one = neighbours(edges.at(terms.select("graph_id", F.col("term").alias("id"))), terms)
    one = staged(_first(one.select("graph_id", "term", "node", F.lit(1).alias("hop"), F.col("weight").alias("score")), max_nodes), "one")
    short = staged(one.groupBy("graph_id").agg(F.count("*").alias("n")).where(F.col("n") < max_nodes), "short")
    top = one
    if not short.isEmpty():
        # all of a short graph's direct neighbours are in one
        own = one.join(short, "graph_id", "left_semi")
        reach = edges.at(own.select("graph_id", F.col("node").alias("id")))
        far = _second(reach, own.select("graph_id", "term", "node", F.col("score").alias("weight")))
        far = far.select("graph_id", "term", "node", F.lit(2).alias("hop"), "score")
        far = _first(far, max_nodes).join(short, "graph_id").where(F.col("rank") <= max_nodes - F.col("n")).select(one.columns)
        top = staged(one.unionByName(far), "top")
    centre = one.select("graph_id", F.col("term").alias("id")).distinct()
    out = edges.among(top.select("graph_id", F.col("node").alias("id")).unionByName(centre))
    absent = staged(edges.graphs().join(one.select("graph_id").distinct(), "graph_id", "left_anti"), "absent")
    return out if absent.isEmpty() else out.unionByName(edges.whole(absent))


def sizes(edges: DataFrame) -> DataFrame:
    n = non_isolated(edges).groupBy("graph_id").agg(F.count("*").alias("n_nodes"))
    return n.join(edges.groupBy("graph_id").agg(F.count("*").alias("n_edges")), "graph_id")


def endpoints(edges: DataFrame, layout: DataFrame) -> DataFrame:
    """Edges with the coordinates of both ends; edges without are dropped."""
    for c, k in (("source", 1), ("target", 2)):
        at = layout.select("graph_id", F.col("id").alias(c), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))
        edges = edges.join(at, ["graph_id", c]).where(F.col(f"x{k}").isNotNull() & F.col(f"y{k}").isNotNull())
    return edges
