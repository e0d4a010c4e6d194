"""Sentence-level co-occurrence and pointwise mutual information."""

from __future__ import annotations

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import staged
from . import packed


def sent_count(sents: DataFrame) -> DataFrame:
    return sents.groupBy("graph_id").agg(F.count("*").alias("n_sents"))


def sent_freq(sents: DataFrame) -> DataFrame:
    """In how many sentences each token stands."""
    return sents.select("graph_id", F.explode(F.array_distinct("tokens")).alias("token")).groupBy("graph_id", "token").agg(F.count("*").alias("freq"))


def _counted(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("graph_id", "a", "b").agg(F.count("*").alias("cooc"))


def pair_rows(sents: DataFrame) -> DataFrame:
    """(graph_id, a, b, cooc) as pair_counts(), one row a pair until they are summed: for streams and for
    sentences of a few nodes. A sentence's pairs are made one first token at a time."""
    u = F.array_sort(F.array_distinct("tokens"))
    s = sents.select("graph_id", u.alias("u")).where(F.size("u") > 1)
    s = s.select("graph_id", "u", F.posexplode("u").alias("i", "a"))
    return _counted(s.select("graph_id", "a", F.explode(F.slice("u", F.col("i") + 2, F.size("u"))).alias("b")))


def pair_counts(sents: DataFrame) -> DataFrame:
    """(graph_id, a, b, cooc), a < b: sentences that hold both. The only wide step carries packed
    partial counts, a block of pairs a row. sents is read several times."""
    return packed.pairs(sents, packed.Words.of_sentences(sents)).select("graph_id", "a", "b", F.col("n").alias("cooc"))


def pmi(cooc: Column, freq_a: Column, freq_b: Column, n: Column) -> Column:
    """Natural logarithm, -Infinity where anything is 0 or absent."""
    some = (F.coalesce(cooc, F.lit(0)) > 0) & (F.coalesce(freq_a, F.lit(0)) > 0) & (F.coalesce(freq_b, F.lit(0)) > 0)
    return F.when(some, F.ln((cooc * n).cast("double") / (freq_a * freq_b))).otherwise(F.lit(float("-inf")))


def marginals(sents: DataFrame) -> DataFrame:
    """(graph_id, token, freq, n_sents): what a pair's PMI needs beside its own count."""
    return sent_freq(sents).join(sent_count(sents), "graph_id")


def _with_marginals(pairs: DataFrame, m: DataFrame) -> DataFrame:
    p = pairs.join(m.select("graph_id", F.col("token").alias("a"), F.col("freq").alias("freq_a"), "n_sents"), ["graph_id", "a"])
    return p.join(m.select("graph_id", F.col("token").alias("b"), F.col("freq").alias("freq_b")), ["graph_id", "b"])


def pair_stats(sents: DataFrame, positive: bool = False) -> DataFrame:
    """Pairs with the counts that their PMI is made from; only those of positive PMI if so asked.
    sents is read several times."""
    return packed.pairs(sents, packed.Words.of_sentences(sents), positive).withColumnRenamed("n", "cooc")


def pmi_scores(sents: DataFrame) -> DataFrame:
    return pair_stats(sents).withColumn("pmi", pmi(F.col("cooc"), F.col("freq_a"), F.col("freq_b"), F.col("n_sents")))


def pmi_of(stats: DataFrame, freq: DataFrame, n: DataFrame, wanted: DataFrame) -> DataFrame:
    """pmi of any wanted(graph_id, a, b), whatever their order, in or out of the pairs counted."""
    w = wanted.withColumn("lo", F.least("a", "b")).withColumn("hi", F.greatest("a", "b"))
    w = w.join(stats.select("graph_id", F.col("a").alias("lo"), F.col("b").alias("hi"), "cooc"), ["graph_id", "lo", "hi"], "left")
    for c in ("a", "b"):
        w = w.join(freq.select("graph_id", F.col("token").alias(c), F.col("freq").alias(f"freq_{c}")), ["graph_id", c], "left")
    w = w.join(n, "graph_id", "left")
    return w.select("graph_id", "a", "b", pmi(F.col("cooc"), F.col("freq_a"), F.col("freq_b"), F.col("n_sents")).alias("pmi"))


def _positive(stats: DataFrame) -> DataFrame:
    """Edges of positive PMI. The test is on whole numbers, before any logarithm."""
    p = stats.where(F.col("cooc") * F.col("n_sents") > F.col("freq_a") * F.col("freq_b"))
    return p.select("graph_id", F.col("a").alias("source"), F.col("b").alias("target"), pmi(F.col("cooc"), F.col("freq_a"), F.col("freq_b"), F.col("n_sents")).alias("weight"))


def pmi_edges(sents: DataFrame) -> DataFrame:
    return _positive(pair_stats(sents, positive=True))


def _own(sents: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, u, own): distinct tokens of sentences, and those among nodes(graph_id, id), which
    are few in each graph."""
    few = staged(nodes.groupBy("graph_id").agg(F.collect_set("id").alias("ids")), "nodes")
    s = sents.join(few, "graph_id").select("graph_id", F.array_distinct("tokens").alias("u"), "ids")
    return s.select("graph_id", "u", F.array_intersect("u", "ids").alias("own")).where(F.size("own") > 0)


def pairs_among(sents: DataFrame, nodes: DataFrame) -> DataFrame:
    """pair_counts() of pairs with both ends in nodes(graph_id, id), which are few in each graph."""
    return pair_rows(_own(sents, nodes).select("graph_id", F.col("own").alias("tokens")))


class PmiGraph:
    """The graph of positive PMI over sents(graph_id, tokens), of which only the asked parts are made:
    edges at a few nodes cost one look at each sentence, not all its pairs. sents is read a few times."""

    def __init__(self, sents: DataFrame):
        self.sents = sents
        self.marginals = staged(marginals(sents), "marginals")

    def at(self, nodes: DataFrame) -> DataFrame:
        """Edges (graph_id, source, target, weight) with an end in nodes."""
        s = _own(self.sents, nodes).select("graph_id", "u", "own", F.explode("own").alias("x"))
        s = s.select("graph_id", "own", "x", F.explode("u").alias("y")).where("x <> y and not (y < x and array_contains(own, y))")
        return _positive(_with_marginals(_counted(s.select("graph_id", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))), self.marginals))

    def among(self, nodes: DataFrame) -> DataFrame:
        """Edges with both ends in nodes."""
        return _positive(_with_marginals(pairs_among(self.sents, nodes), self.marginals))

    def two_hop(self, one: DataFrame) -> DataFrame:
        """(graph_id, term, node, score) two steps away, from all neighbours one(graph_id, term, node,
        weight) of the terms. These go by way of the driver, at most the vocabulary for each term."""
        words = packed.Words.of_sentences(self.sents)
        term = one.select("graph_id", F.col("term").alias("token")).distinct()
        term = term.withColumn("k", F.row_number().over(W.partitionBy("graph_id").orderBy("token"))).toArrow()
        out = None
        for k in range(1, 1 + max(term.column("k").to_pylist(), default=1)):
            # one term of each graph
            some = term.filter(pc.equal(term.column("k"), k))
            rows = one.join(self.sents.sparkSession.createDataFrame(some.to_pylist() or [], "graph_id string, token string, k int").select("graph_id", F.col("token").alias("term")), ["graph_id", "term"], "left_semi")
            rows = rows.select("graph_id", F.col("node").alias("token"), F.col("weight").cast("double").alias("weight")).toArrow()
            part = packed.best_second_steps(self.sents, words, some, rows)
            out = part if out is None else out.unionByName(part)
        return out

    def graphs(self) -> DataFrame:
        return self.marginals.select("graph_id").distinct()

    def whole(self, graphs: DataFrame) -> DataFrame:
        """All edges of some graphs(graph_id)."""
        return pmi_edges(self.sents.join(graphs, "graph_id", "left_semi"))
