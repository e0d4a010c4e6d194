"""Whole plans: from documents to pruned term networks, many (term, scope) graphs in one job.

Restricted sentences are read by several steps, so they are written once. The graph itself is never
made whole: pruning asks for the edges at a few nodes, and those come straight from the sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import cooccur, graph, similarity, vocab


def cooccurrence_network(sents: DataFrame, terms: DataFrame, min_freq: int = 22, max_nodes: int = 15, stopwords=()) -> DataFrame:
    """Edges of each graph's pruned PMI network. sents(graph_id, doc_id, sent_id, tokens) are
    unrestricted token lists; terms(graph_id, term) name each graph's centre."""
    kept = vocab.restricted(sents, vocab.vocabulary(sents, terms, min_freq, stopwords))
    return graph.pruned(cooccur.PmiGraph(kept), terms, max_nodes)


def similarity_network(sents: DataFrame, terms: DataFrame, min_freq: int = 22, max_nodes: int = 15, threshold: float = 0.7, stopwords=()) -> DataFrame:
    """As cooccurrence_network, with cosine similarity of contexts."""
    words = vocab.vocabulary(sents, terms, min_freq, stopwords)
    cells = similarity.context_matrix(vocab.restricted(sents, words))
    if threshold <= 0:
        return graph.pruned(similarity.cosine_edges(cells, threshold, words.withColumnRenamed("token", "id")), terms, max_nodes)
    return graph.pruned(similarity.CosineGraph(cells, threshold), terms, max_nodes)
