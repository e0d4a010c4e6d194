"""Seams for what built-in functions can't do: taggers with a model, and trees of any depth."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TAGGED = "array<array<struct<lemma:string,pos:string,is_stop:boolean,is_alpha:boolean>>>"

#: Characters of texts whose words are held at a time.
PART = 100_000


def _parts(texts: pd.Series) -> Iterator[pd.Series]:
    """texts in their order, each part as long as its text number PART characters, or a longer text alone."""
    ends = texts.str.len().fillna(0).cumsum().to_numpy()
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(ends.searchsorted((ends[lo - 1] if lo else 0) + PART, "right")))
        yield texts.iloc[lo:hi]
        lo = hi


def tagged(docs: DataFrame, load: Callable, text: str = "text") -> DataFrame:
    """docs with the column tagged: sentences of (lemma, pos, is_stop, is_alpha). load() makes the
    tagger, a function from a text to such sentences; each Python worker calls it once and keeps it
    for all its Arrow batches. A null text has no sentences. Words of about PART characters of texts are
    held at a time, however many texts a batch has."""

    def tag(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tagger = load()
        for part in (p for texts in batches for p in _parts(texts)):
            yield part.map(lambda t: [[dict(zip(("lemma", "pos", "is_stop", "is_alpha"), w, strict=True)) for w in s] for s in tagger(t)] if t else [])

    return docs.withColumn("tagged", F.pandas_udf(tag, TAGGED)(F.col(text)))


def _image_lists(trees: pd.Series) -> pd.Series:
    def walk(node: object, out: list) -> list:
        if isinstance(node, dict):
            if node.get("type") == "img" and isinstance(node.get("url"), str):
                alt = node.get("caption")
                out.append({"path": node["url"], "alt": alt if isinstance(alt, str) else None})
            elif isinstance(node.get("children"), list):
                for child in node["children"]:
                    walk(child, out)
        return out

    def images(tree: str | None) -> list:
        try:
            nodes = json.loads(tree) if tree else []
        except ValueError:
            return []
        return [x for node in (nodes if isinstance(nodes, list) else []) for x in walk(node, [])]

    return trees.map(images)


def images(tree: Column) -> Column:
    """(path, alt) of the img nodes of a JSON array of nodes, in the order of the page, at any depth."""
    return F.pandas_udf(_image_lists, "array<struct<path:string,alt:string>>")(tree)
