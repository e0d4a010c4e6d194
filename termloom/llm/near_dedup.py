"""Near-duplicate groups by SuperMinHash signatures, banding, exact verification and
distributed union-find.

Words are maximal runs without white space after lower-casing A-Z. A document's set is its
distinct five-word shingles; with fewer words the whole sequence is one shingle; without words
the set is empty and the document is linked with nothing. Two documents are linked where
100 * intersection >= 75 * union of the full sets.

Plan. One pass computes sets, a 128-bit fingerprint of each set and the band keys. Equal sets
collapse to one representative by a pre-aggregated group-by, so groups of exact copies cost one
row. Then two rounds: (1) every member of a bucket is verified against the bucket's most central
member, the one that shares its buckets with most others (the original among its edited copies),
which joins the members of a group in linear work; (2) in the buckets that still hold several
components, members of different components are verified, block against block with inverted
lists, and only the links found are returned. Pairs are never formed as rows beyond a member and its
bucket's centre, and no bucket is capped.

With 32 bands of 4 rows a pair at similarity 0.75 shares a bucket with probability 1 - 6e-6.

Defined cases: null text is empty; rows without doc_id get a null component_id and are kept;
rows that repeat a doc_id are one document, whose set for linking is the one of the row with the most
shingles (ties: the least fingerprint); extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import connected_components, staged, table

BANDS, ROWS = 32, 4
#: Up to so many ids are sent to every task to pick texts by; beyond, texts are joined by id.
ID_BROADCAST = 500_000
#: Shingles of a block of members in the second round; a task holds two blocks.
BLOCK = 300_000
SHINGLE = 5


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, set offsets): each text's distinct shingle hashes, sorted."""
    s, e, woff = tk.word_spans(data, off, tk.SPACE)
    w = tk.span_hash(tk.prefix_code(data, tk.FOLDED_CODE), s, e)
    n = np.diff(woff)
    at = tk.starts_within(woff, size)
    h = tk.ngram_hash(w, size)[at] if len(at) else np.zeros(0, np.uint64)
    doc = np.searchsorted(woff, at, "right") - 1
    few = np.flatnonzero((n > 0) & (n < size))
    if len(few):
        own = np.array([int(tk.ngram_hash(w[woff[d] : woff[d + 1]], int(n[d]))[0]) for d in few], np.uint64)
        h, doc = np.concatenate([h, own]), np.concatenate([doc, few])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(off)))


def superminhash(h: np.ndarray, soff: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash signatures, one row of m values a set (infinite for an empty set).

    Round j gives each element a value in [j, j + 1) at the next place of the element's own
    random permutation, so ranks of one element are correlated; a set stops as soon as all its
    places hold values that no later round can lower."""
    d = len(soff) - 1
    sig = np.full(d * m, np.inf)
    doc = np.repeat(np.arange(d), np.diff(soff))
    perm = np.tile(np.arange(m, dtype=np.uint8), (len(h), 1)) if m <= 256 else np.tile(np.arange(m, dtype=np.int32), (len(h), 1))
    for j in range(m):
        if not len(h):
            break
        rnd = tk.mix(h + np.uint64(2 * j + 1) * tk._M1)
        k = j + (((rnd & np.uint64(0xFFFFFFFF)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64)
        rows = np.arange(len(h))
        there, here = perm[rows, k], perm[:, j].copy()
        perm[rows, k] = here
        perm[:, j] = there
        value = (tk.mix(rnd) >> np.uint64(11)).astype(np.float64) * 2.0**-53 + j
        np.minimum.at(sig, doc * m + there, value)
        live = np.unique(doc)
        open_ = np.zeros(d, bool)
        open_[live] = sig.reshape(d, m)[live].max(axis=1) >= j + 1
        keep = open_[doc]
        if not keep.all():
            h, doc, perm = h[keep], doc[keep], perm[keep]
    return sig.reshape(d, m)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = tk.mix(sig.view(np.uint64)).reshape(len(sig), bands, rows)
    key = np.zeros((len(sig), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * tk._M1
    for r in range(rows):
        key = tk.mix(key ^ bits[:, :, r])
    return key


def _fingerprints(h: np.ndarray, soff: np.ndarray) -> list[pa.Array]:
    """Two 64-bit hashes of each set."""
    out = []
    for x in (h, h ^ tk._M2):
        c = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(tk.mix(x), out=c[1:])
        out.append(pa.array(tk.to_int64(tk.mix(c[soff[1:]] - c[soff[:-1]]))))
    return out


def _signed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        data, off = tk.text_buffer(batch.column(1))
        for i, j, part, poff in tk.chunks(data, off, 1 << 20):
            h, soff = shingle_sets(part, poff)
            n = np.diff(soff)
            keys = band_keys(superminhash(h, soff, BANDS * ROWS), BANDS, ROWS)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(i, j - i),
                    pa.array(n.astype(np.int64)),
                    *_fingerprints(h, soff),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i) * BANDS + 1, BANDS, dtype=np.int32)), pa.array(tk.to_int64(keys).ravel())),
                ],
                names=["doc_id", "n_shingles", "f1", "f2", "keys"],
            )


def _sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        data, off = tk.text_buffer(batch.column(1))
        for i, j, part, poff in tk.chunks(data, off):
            h, soff = shingle_sets(part, poff)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), *_fingerprints(h, soff), pa.ListArray.from_arrays(pa.array(soff.astype(np.int32)), pa.array(tk.to_int64(h)))],
                names=["node", "f1", "f2", "set"],
            )


def _similar(shared: Column, na: Column, nb: Column, percent: int) -> Column:
    return 100 * shared >= percent * (na + nb - shared)


def _sets_of(pairs: DataFrame, texts: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, set): the full sets of all members of pairs(a, b), which stand for sets(node, f1, f2)."""
    nodes = staged(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(sets.select("node", "f1", "f2"), "node"), "wanted")
    if nodes.count() <= ID_BROADCAST:
        nodes = F.broadcast(nodes)
    need = texts.join(nodes, texts.doc_id == nodes.node, "left_semi").select("doc_id", "text")
    made = need.mapInArrow(_sets, "node long, f1 long, f2 long, set array<long>")
    # a repeated doc_id may have rows of other sets
    return staged(made.join(nodes, ["node", "f1", "f2"], "left_semi").select("node", "set").dropDuplicates(["node"]), "sets")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) rows that are linked, by the full sets of both."""
    x = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a")
    x = x.join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
    return x.where(_similar(F.size(F.array_intersect("sa", "sb")), F.size("sa"), F.size("sb"), percent)).select("a", "b")


def _across(percent: int):
    """For a block of one family's members: pairs of components with linked members, enough of
    them to join all that are linked."""

    def links(block: pa.Table) -> pa.Table:
        comp = block.column("c").to_numpy()
        lists = block.column("set").combine_chunks()
        value, off = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        size = np.diff(off)
        member = np.repeat(np.arange(len(comp)), size)
        order = np.argsort(value, kind="stable")
        value_at, member_at = value[order], member[order]
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        found = []
        label = comp.copy()  # follows the unions made here
        for x in range(len(comp)):
            if (label == label[x]).all():
                break
            own = value[off[x] : off[x + 1]]
            lo, hi = np.searchsorted(value_at, own, "left"), np.searchsorted(value_at, own, "right")
            n = hi - lo
            hits = member_at[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            shared = np.bincount(hits, minlength=len(comp))
            near = np.flatnonzero((label != label[x]) & (100 * shared >= percent * (size + size[x] - shared)) & (shared > 0))
            for y in near.tolist():
                a, b = sorted((root(int(comp[x])), root(int(comp[y]))))
                if a != b:
                    parent[b] = a
                    found.append((a, b))
                    label[label == b] = a
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return links


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs(doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = staged(docs.mapInArrow(_signed, "doc_id long, n_shingles long, f1 long, f2 long, keys array<long>"), "signed")
    # a document's set; then one node for each distinct set, whose number is the smallest doc_id that has it
    own = signed.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct((-F.col("n_shingles")).alias("less"), "f1", "f2")).alias("s"))
    own = staged(own.select("doc_id", (-F.col("s.less")).alias("n_shingles"), "s.f1", "s.f2"), "own")
    sets = staged(own.where("n_shingles > 0").groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("node")), "nodes")
    keys = signed.select("doc_id", "n_shingles", "f1", "f2", "keys").join(
        sets.withColumnRenamed("node", "doc_id"), ["doc_id", "f1", "f2", "n_shingles"], "left_semi"
    )
    bucketed = keys.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), F.explode("keys").alias("key"))
    # what a key knows of its rows comes from a window: one exchange by the key, no join
    by_key = W.partitionBy("key")
    buckets = staged(bucketed.withColumn("size", F.count("*").over(by_key)).where("size > 1"), "buckets")
    central = buckets.select("key", "node", F.sum("size").over(W.partitionBy("node")).alias("weight"))
    stars = central.select("node", (-F.max(F.struct("weight", (-F.col("node")).alias("minus"))).over(by_key)["minus"]).alias("head")).where("node <> head")
    stars = staged(stars.select(F.least("head", "node").alias("a"), F.greatest("head", "node").alias("b")).distinct(), "stars")
    sets_of = _sets_of(stars, docs, sets)
    links = staged(_verified(stars, sets_of, percent), "links")
    labels = staged(connected_components(links), "labels")
    # second round: only across components, among the members of buckets that still hold several
    cell = buckets.join(labels, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("c"))
    cell = cell.withColumns({"lo": F.min("c").over(by_key), "hi": F.max("c").over(by_key), "head": F.min("node").over(by_key)}).where("lo <> hi")
    cell = staged(cell.select("head", "node", "n", "c").distinct(), "mixed")
    families = connected_components(cell.select(F.col("head").alias("a"), F.col("node").alias("b")))
    member = cell.select("node", "n", "c").distinct().join(families, "node").withColumnRenamed("component", "family")
    member = member.withColumn("k", F.ceil(F.sum("n").over(W.partitionBy("family")) / BLOCK))
    member = member.join(sets_of, "node").withColumn("_own", F.pmod(F.xxhash64("node"), F.col("k")))
    pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("k") - 1), lambda x: F.struct(F.least("_own", x).alias("i"), F.greatest("_own", x).alias("j")))
    member = member.select("family", "node", "c", "set", F.explode(pair).alias("p")).select("family", "p.i", "p.j", "node", "c", "set")
    more = staged(member.groupBy("family", "i", "j").applyInArrow(_across(percent), "a long, b long").distinct(), "more")
    merged = connected_components(more).select(F.col("node").alias("component"), F.col("component").alias("merged"))
    label = labels.join(merged, "component", "outer").select(
        F.coalesce("node", "component").alias("node"), F.coalesce("merged", "component").alias("component_id")
    )
    rep = sets.join(label, "node", "left").select("f1", "f2", "n_shingles", F.coalesce("component_id", "node").alias("component_id"))
    # of each document its component, for all its rows
    placed = own.join(rep, ["f1", "f2", "n_shingles"], "left").select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = signed.select("doc_id", "n_shingles").join(placed, "doc_id", "left").select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
