"""Sinks: node-link JSON and its names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import slug


def node_link(edges: DataFrame) -> DataFrame:
    """(graph_id, json): one document a graph, nodes and edges sorted. For pruned graphs, whose size
    is bounded."""
    ends = F.flatten(F.collect_list(F.array(F.struct(F.col("source").alias("id")), F.struct(F.col("target").alias("id")))))
    e = F.sort_array(F.collect_list(F.struct("source", "target", "weight")))
    g = edges.groupBy("graph_id").agg(F.sort_array(F.array_distinct(ends)).alias("nodes"), e.alias("edges"))
    doc = F.struct(F.lit(False).alias("directed"), F.lit(False).alias("multigraph"), F.create_map().cast("map<string,string>").alias("graph"), "nodes", "edges")
    return g.select("graph_id", F.to_json(doc).alias("json"))


def file_name(term: Column, title: Column | None = None) -> Column:
    """Name of a graph's file. Titles that agree in their first 12 characters would collide, so
    write_node_links() keys folders by graph_id."""
    parts = [F.lit("cooccurrence"), term] + ([slug(title, 12)] if title is not None else [])
    return F.concat(F.concat_ws("_", *parts), F.lit(".json"))


def write_node_links(edges: DataFrame, path: str) -> None:
    node_link(edges).select(F.col("json").alias("value"), "graph_id").write.partitionBy("graph_id").text(path)
