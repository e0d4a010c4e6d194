"""Sentences, vocabularies and sentences restricted to them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import staged
from . import packed


def sentences(docs: DataFrame, graph_id: Column, text: str = "text", split: Callable = T.english_sentences, tokens: Callable = T.english_tokens, apart: bool = True) -> DataFrame:
    """(graph_id, doc_id, sent_id, tokens) of docs, in one narrow pass. A sentence never crosses
    documents. graph_id may be an array: each sentence then belongs to several graphs, though
    its text is taken apart once. It is a row in each, or one row with the array if not apart, which is all that
    vocabularies and restricted sentences need. Sentences without tokens are dropped."""
    s = docs.select(graph_id.alias("graph_id"), "doc_id", F.posexplode(split(F.col(text))).alias("sent_id", "s"))
    s = s.select("graph_id", "doc_id", "sent_id", tokens(F.col("s")).alias("tokens")).where(F.size("tokens") > 0)
    return each_graph(s) if apart else s


def each_graph(sents: DataFrame) -> DataFrame:
    """A row in each of its graphs for a sentence whose graph_id is an array."""
    return sents.withColumn("graph_id", F.explode("graph_id")) if dict(sents.dtypes)["graph_id"].startswith("array") else sents


def token_lists(tokens: DataFrame) -> DataFrame:
    """(graph_id, doc_id, sent_id, tokens) of one row a token (graph_id, doc_id, sent_id, pos, token)."""
    g = tokens.groupBy("graph_id", "doc_id", "sent_id").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("t"))
    return g.select("graph_id", "doc_id", "sent_id", F.col("t.token").alias("tokens"))


def token_freq(sents: DataFrame) -> DataFrame:
    """Occurrences, repeats within a sentence included."""
    f = sents.select("graph_id", F.explode("tokens").alias("token")).groupBy("graph_id", "token").agg(F.count("*").alias("freq"))
    return each_graph(f).groupBy("graph_id", "token").agg(F.sum("freq").alias("freq")) if dict(sents.dtypes)["graph_id"].startswith("array") else f


def vocabulary(sents: DataFrame, terms: DataFrame, min_freq: int, stopwords: list[str] | DataFrame = ()) -> DataFrame:
    """(graph_id, token): tokens of min_freq occurrences that aren't stopwords, and always the
    graph's own term, from terms(graph_id, term)."""
    v = token_freq(sents).where(F.col("freq") >= min_freq)
    if isinstance(stopwords, DataFrame):
        v = v.join(stopwords, "token", "left_anti")
    elif stopwords:
        v = v.where(~F.col("token").isin(list(stopwords)))
    return v.select("graph_id", "token").unionByName(terms.select("graph_id", F.col("term").alias("token"))).distinct()


def restricted(sents: DataFrame, vocab: DataFrame, least: int = 2) -> DataFrame:
    """Sentences with only vocabulary tokens, order and repeats kept; those left with fewer than
    least tokens, repeats counted, are dropped. The vocabulary goes to all tasks, by way of the driver, and a
    sentence never leaves its task; the result is written. Rows with the same graph_id, doc_id and sent_id
    are one sentence: where there are such, tokens are joined and put together by key."""
    vocab = staged(vocab, "vocabulary")
    kept = staged(packed.narrowed(sents, vocab), "kept")
    # only a document that was met in two places can have rows with one key
    parted = kept.groupBy("doc_id", "run").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    parted = staged(parted, "parted")
    if not parted.isEmpty():
        again = kept.join(parted.withColumnRenamed("doc_id", "d"), F.col("doc_id").eqNullSafe(F.col("d")), "left_semi")
        if not again.groupBy("graph_id", "doc_id", "sent_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            t = each_graph(sents).select("graph_id", "doc_id", "sent_id", F.posexplode("tokens").alias("pos", "token"))
            return staged(token_lists(t.join(vocab, ["graph_id", "token"], "left_semi")).where(F.size("tokens") >= least), "kept")
    return kept.where(F.size("tokens") >= least).drop("run")


def pooled(first: Column, *more: Column) -> Column:
    """graph ids for the same sentence in several scopes, such as its document and a pooled corpus."""
    return F.array(first, *more)
