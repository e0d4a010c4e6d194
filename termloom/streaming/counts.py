"""Streaming: pair counts are sums, so they are kept up to date as sentences arrive; networks are made
anew from the sentences gathered so far, as vocabulary thresholds aren't monotone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cooccur
from ..plans import network
from ..storage import new_path, staged

COUNTS = "graph_id string, a string, b string, cooc long"


def pair_count_stream(sents: DataFrame) -> DataFrame:
    """Running pair counts of a stream of sentences, for output modes update and complete."""
    return cooccur.pair_rows(sents)


def final_counts(sents: DataFrame) -> DataFrame:
    """Pair counts of all that a stream holds now. Each micro-batch counts its own pairs, packed, and writes
    them as a table; these are sums, so several are added up at the end, and no state of all pairs is kept
    and written anew by each. A batch that is run again replaces its own table."""
    spark = sents.sparkSession
    path, epochs = new_path(spark, "pair-counts"), set()

    def write(batch: DataFrame, epoch: int) -> None:
        cooccur.pair_counts(staged(batch, "sentences")).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
        epochs.add(epoch)

    run = sents.writeStream.foreachBatch(write)
    run = run.option("checkpointLocation", new_path(spark, "stream")).trigger(availableNow=True).start()
    run.awaitTermination()
    if not epochs:
        return spark.createDataFrame([], COUNTS)
    every = spark.read.schema(COUNTS).parquet(*(f"{path}/epoch={k}" for k in sorted(epochs)))
    return every if len(epochs) == 1 else every.groupBy("graph_id", "a", "b").agg(F.sum("cooc").alias("cooc"))


def network_per_batch(terms: DataFrame, min_freq: int, max_nodes: int, gathered: str, sink: Callable[[DataFrame, int], None]):
    """A foreachBatch function: adds the batch's sentences to the table at the path gathered, and gives
    sink the network of all of them. A batch that is run again replaces its own part."""

    def on_batch(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{gathered}/epoch={epoch}")
        sents = batch.sparkSession.read.parquet(gathered).drop("epoch")
        sink(network.cooccurrence_network(sents, terms, min_freq, max_nodes), epoch)

    return on_batch
