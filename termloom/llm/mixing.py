"""Mixing sources to target weights by entropy balancing.

Targets. Sources in code point order (null last) weigh 5, 2, 1, repeating, and share SHARE percent
of all tokens; a target stops at CAP times its source's tokens and the excess is shared among the
others by weight until none is above.

Constraints. Each source's tokens meet its target. Over that, each language should keep its share of
the corpus in the mix, which the sources' weights alone would shift: a soft constraint, of penalty RIDGE,
as it may contradict the targets. The LANGS languages of most tokens have one each, the rest share
one; null is a language.

Rates. Of all rates between 0 and CAP those nearest in relative entropy to the corpus are exponential
tilts, min(CAP, exp(lambda of the source + mu of the language)). The dual is convex. Given mu each
source's lambda is its own root; the outer Newton steps on mu need the gradient and the Hessian with the
lambdas eliminated, which are sums over sources: each step is one distributed pass over the (source,
language) sums, pre-aggregated from the documents, and only those sums, at most (LANGS + 1)**2 numbers,
reach the driver. Steps end when the gradient is below TOLERANCE of all tokens. The sources' targets
hold at every step.

Rounding. A document gets floor(rate) copies or one more (or fewer, where a source ends off its target). Documents of one source, language and size
are alike, so the number of extra copies is settled for each such cell, from large sizes to small ones,
carrying the words still missing or in excess to the next cell of the source; within a cell the
documents with the smallest hashes of doc_id get the copy. Ranks inside a cell are prefix sums over
hash slices, so a cell with a third of all rows is still dealt over many tasks.

Defined cases: null text has size 0 and takes nothing; null source is a source; without a column lang all
rows are of one language; null doc_ids and repeated rows are told apart by no rule, so among equal rows
(and ties of the hash) any may get the extra copy (their number is fixed); an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged, table

WEIGHTS, SHARE, CAP = (5, 2, 1), 150, 2
LANGS, RIDGE, TOLERANCE, NEWTON_STEPS = 64, 0.02, 1e-7, 30
SLICES = 64
WORD = r"[^\x20\x09-\x0D]+"


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) of sources(source, source_size)."""
    spark = sources.sparkSession
    # one row a source, read in their order; the window below needs the few sums, not the documents
    order = W.orderBy(F.col("source").isNull(), "source")
    s = sources.withColumn("k", F.row_number().over(order)).withColumn("all", F.sum("source_size").over(W.partitionBy()))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("k") - 1) % len(weights) + 1)
    s = s.select("source", "source_size", weight.cast("double").alias("weight"), "all")
    # water filling: sources reach their caps in the order of size / weight; with the first m of them
    # capped the level of the rest is (budget - caps) / remaining weight
    by = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before = by.rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("capped", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * cap)
    s = s.withColumn("open", F.sum("weight").over(by.rowsBetween(0, W.unboundedFollowing)))
    s = s.withColumn("level", (F.col("all") * share / 100 - F.col("capped")) / F.col("open"))
    s = s.withColumn("full", F.col("level") * F.col("weight") >= F.col("source_size") * cap)
    # the first source that isn't full sets the level for all after it
    s = s.withColumn("rest", F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, 0)))
    return s.select("source", "source_size", F.when(F.col("rest").isNull(), F.col("source_size") * F.lit(float(cap))).otherwise(F.col("rest") * F.col("weight")).alias("target"))


def lambdas(words: np.ndarray, target: np.ndarray, mu: np.ndarray, cap: float = CAP) -> np.ndarray:
    """Each row's root of sum(words * min(cap, exp(x + mu))) = target, for 0 < target < cap * sum(words),
    by Newton steps inside a bracket."""
    used = words > 0
    total = words.sum(axis=1)
    low = np.log(target / total) - np.where(used, mu, -np.inf).max(axis=1)
    high = np.log(cap) - np.where(used, mu, np.inf).min(axis=1)
    x = np.clip(np.log(target / total), low, high)
    for _ in range(100):
        e = np.exp(x[:, None] + mu)
        gap = (words * np.minimum(e, cap)).sum(axis=1) - target
        if (np.abs(gap) <= 1e-12 * target).all():
            break
        low, high = np.where(gap < 0, x, low), np.where(gap > 0, x, high)
        slope = (words * np.where(e < cap, e, 0)).sum(axis=1)
        step = x - gap / np.maximum(slope, 1e-300)
        x = np.where((step > low) & (step < high), step, (low + high) / 2)
    return x


def _dense(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words by source and language group, targets, which sources are held at the cap)."""
    lists = batch.column("cells")
    row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
    words = np.zeros((batch.num_rows, n))
    np.add.at(words, (row, lists.flatten().field("g").to_numpy()), lists.flatten().field("words").to_numpy())
    return words, batch.column("target").to_numpy(), batch.column("full").to_numpy(zero_copy_only=False)


def rates(words: np.ndarray, target: np.ndarray, full: np.ndarray, mu: np.ndarray) -> np.ndarray:
    """Rate of each source and language group."""
    out = np.full(words.shape, float(CAP))
    free = ~full
    if free.any():
        out[free] = np.minimum(CAP, np.exp(lambdas(words[free], target[free], mu)[:, None] + mu))
    return out


def moments(words: np.ndarray, target: np.ndarray, full: np.ndarray, mu: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The part that some sources add to the languages' tokens and to the Hessian on mu."""
    r = rates(words, target, full, mu)
    a = np.where((r < CAP) & ~full[:, None], words * r, 0.0)
    total = a.sum(axis=1)
    share = a / np.maximum(total, 1e-300)[:, None]
    return (words * r).sum(axis=0), np.diag(a.sum(axis=0)) - share.T @ a


def balanced(sources: DataFrame, goal: np.ndarray, all_tokens: float, steps: int = NEWTON_STEPS) -> tuple[np.ndarray, int]:
    """(mu, Newton steps) for sources(target, full, cells) and the languages' token goals."""
    n = len(goal)
    mu = np.zeros(n)
    for step in range(steps):

        def part(it: Iterator[pa.RecordBatch], mu=mu) -> Iterator[pa.RecordBatch]:
            for batch in it:
                taken, hessian = moments(*_dense(batch, n), mu)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n + n * n)), pa.array(np.concatenate([taken, hessian.ravel()]))], names=["k", "v"])

        sums = np.zeros(n + n * n)
        for r in sources.select("target", "full", "cells").mapInArrow(part, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
            sums[r.k] = r.v
        gradient = sums[:n] - goal + RIDGE * all_tokens * mu
        if np.abs(gradient).max(initial=0) <= TOLERANCE * all_tokens:
            return mu, step
        delta = np.linalg.solve(sums[n:].reshape(n, n) + RIDGE * all_tokens * np.eye(n), gradient)
        mu = mu - np.clip(delta, -1, 1)
    return mu, steps


def _extra(cells: pd.DataFrame) -> pd.DataFrame:
    """How many documents of each (source, language, size) cell get one copy more; all cells of one source.
    A row a distinct size and language: their number is bounded by the longest document, not by documents."""
    cells = cells.sort_values(["size", "_l"], ascending=[False, True])
    rows = list(zip(cells["size"].tolist(), cells["n"].tolist(), np.minimum(cells["rate"], CAP).tolist(), strict=True))
    missing, copies = 0.0, []
    for size, n, rate in rows:
        whole = math.floor(rate + 1e-12)
        missing += (rate - whole) * size * n
        m = max(0, min(n, math.floor(missing / size + 0.5))) if whole < CAP else 0
        missing -= m * size
        copies.append(whole * n + m)
    # what no later cell could take up goes to any cell that has room, again from large to small
    for k, (size, n, _) in enumerate(rows):
        more = max(-copies[k], min(CAP * n - copies[k], math.floor(missing / size + 0.5)))
        copies[k] += more
        missing -= more * size
    copies = np.array(copies, np.int64)
    return cells.assign(whole=copies // cells["n"], extra=copies % cells["n"])[["source", "_l", "size", "whole", "extra"]]


def solved(words: DataFrame) -> DataFrame:
    """(_s, _n, _l, source_size, target, rate) of words(_s, _n, source, _l, words), one row a source and language."""
    sums = words.groupBy("source").agg(F.sum("words").alias("source_size"))
    goals = staged(targets(sums), "goals").select(F.coalesce("source", F.lit("")).alias("_s"), F.col("source").isNull().alias("_n"), "source_size", "target")
    langs = words.groupBy("_l").agg(F.sum("words").alias("w")).orderBy(F.desc("w"), "_l").limit(LANGS).collect()
    total = words.agg(F.sum("words")).first()[0] or 0
    group = {r["_l"]: k for k, r in enumerate(langs)}
    found = F.try_element_at(F.create_map(*(F.lit(x) for kv in group.items() for x in kv)), "_l") if group else F.lit(None)
    g = F.coalesce(found, F.lit(len(group))).cast("int")
    rows = words.where("words > 0").groupBy("_s", "_n").agg(F.sort_array(F.collect_list(F.struct("_l", g.alias("g"), F.col("words").cast("double").alias("words")))).alias("cells"))
    rows = staged(rows.join(goals, ["_s", "_n"]).withColumn("full", F.col("target") >= CAP * F.col("source_size") * (1 - 1e-12)), "sources")
    budget = rows.agg(F.sum("target")).first()[0] or 0.0
    share = np.array([float(r["w"]) for r in langs] + [float(total - sum(r["w"] for r in langs))])
    n = len(share)
    mu, _ = balanced(rows, budget * share / max(1.0, float(total)), max(1.0, float(budget)))

    def rated(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            r = rates(*_dense(batch, n), mu)
            lists = batch.column("cells")
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            at = pa.array(row)
            rate = r[row, lists.flatten().field("g").to_numpy()]
            yield pa.RecordBatch.from_arrays([batch.column("_s").take(at), batch.column("_n").take(at), lists.flatten().field("_l"), pa.array(rate)], names=["_s", "_n", "_l", "rate"])

    each = rows.select("_s", "_n", "target", "full", "cells").mapInArrow(rated, "_s string, _n boolean, _l string, rate double")
    every = words.select("_s", "_n", "_l").join(goals, ["_s", "_n"]).join(each, ["_s", "_n", "_l"], "left")
    return staged(every.withColumn("rate", F.coalesce("rate", F.lit(0.0))), "rates")


def mixed(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, rate) and the columns keep for every row of
    docs(doc_id, text, source, lang). Kept columns stay with their row; with any, docs is read twice."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lang = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")) if "lang" in docs.columns else F.lit("")
    d = docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), lang.alias("_l"), *keep)
    d = d if keep else staged(d, "sizes")
    h = F.xxhash64(F.lit(17), "doc_id")
    d = d.select("*", h.alias("_h"), F.pmod(F.xxhash64(F.lit(29), "doc_id"), F.lit(SLICES)).alias("_slice"), F.coalesce("source", F.lit("")).alias("_s"), F.col("source").isNull().alias("_n"))
    key = ["_s", "_n", "_l", "size"]
    slices = staged(d.groupBy(*key, "_slice").agg(F.count("*").alias("n"), F.first("source").alias("source")), "slices")
    words = staged(slices.groupBy("_s", "_n", "source", "_l").agg(F.sum(F.col("size") * F.col("n")).alias("words")), "words")
    goals = solved(words)
    cells = slices.where("size > 0").groupBy(*key).agg(F.sum("n").alias("n")).join(goals, ["_s", "_n", "_l"])
    cells = cells.select(F.to_json(F.struct("_s", "_n")).alias("source"), "_l", "size", "n", "rate")
    copies = cells.groupBy("source").applyInPandas(_extra, "source string, _l string, size long, whole long, extra long")
    copies = staged(copies, "copies").withColumn("x", F.from_json("source", "_s string, _n boolean")).select("x.*", "_l", "size", "whole", "extra")
    ahead = W.partitionBy(*key).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    plan = slices.withColumn("_before", F.coalesce(F.sum("n").over(ahead), F.lit(0))).select(*key, "_slice", "_before")
    plan = plan.join(copies, key, "left")
    rank = F.row_number().over(W.partitionBy(*key, "_slice").orderBy("_h", "doc_id"))
    ranked = d.withColumn("_rank", rank).join(plan, [*key, "_slice"]).join(goals, ["_s", "_n", "_l"])
    n = F.coalesce("whole", F.lit(0)) + F.when(F.col("_before") + F.col("_rank") <= F.coalesce("extra", F.lit(0)), 1).otherwise(0)
    return ranked.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), (n * F.col("size")).cast("long").alias("taken"), n.cast("long").alias("copies"), "rate", *keep)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
