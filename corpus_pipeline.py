"""The corpus pipeline: STAGES over documents, each written and read again.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of documents; the last returns the mix: every document with its copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import decontaminate, line_dedup, mixing, near_dedup, quality
from termloom.llm.common import shipped, staged, table

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their source's adaptive thresholds."""
    packed = docs.select(F.struct("*").alias("row"), "text", "lang", "source")
    return quality.judged(packed, ["row"]).where("kept").select("row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; one that loses all its words goes. n_chars follows."""
    left = line_dedup.without_recurring(docs).where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("n_dropped") == 0, F.col("n_chars")).otherwise(F.length("text")))
    return left.select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, and of rows that repeat a doc_id; rows without
    doc_id stay."""
    kept = near_dedup.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    one = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return one.unionByName(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows into which no benchmark item leaks, whatever their ids."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their copies; rows that share a doc_id are taken each."""
    packed = docs.select(F.struct("*").alias("row"), "doc_id", "text", "source", "lang")
    return mixing.mixed(packed, ("row",)).where("copies > 0").select("row.*", "size", "source_size", "target", "taken", "copies")


STAGES = [(f.__name__, shipped(f)) for f in (quality_rules, drop_lines, near_duplicates, decontamination, mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
