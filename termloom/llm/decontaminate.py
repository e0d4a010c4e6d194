"""Benchmark decontamination: CGK random-walk embedding, bit-sampling LSH over item-sized windows,
exact edit verification.

Words are runs of letters and digits (and any non-ASCII character), A-Z lower-cased. An item of
n words leaks into a document where some run of the document's words has word edit distance of
at most floor(n * rate) to the item (rate 0.2 unless set).

The CGK walk reads a window with a pointer that stays or moves on by a random bit of the step
and the word read, which maps edit distance to Hamming distance: after an edit two walks soon read the
same words again. A table's key is the words read at BITS steps that stand within SPREAD steps of each
other, as agreement comes in stretches. A window that shares a key with the item in any of the SAMPLES
tables of any of WALKS walks is a candidate, and the words around it are aligned with the item: the
distance is exact. At the full rate one walk missed 4 to 13 percent of leaks of items of 16 to
200 words, two under 2 percent and three none of 400 (measured), so all WALKS miss about one in 1e5 at most.

Windows of an item's size may begin at every word of every document. Two necessary conditions keep
those away that can't leak, without loss. A leaking run of an item of n words and k allowed edits has
at most n + k words, and at least n - k of them stand in the item; so it holds as many of the item's
rarest words (by counts over the whole corpus) as Index says.

The items are the query set and are held in blocks of at most BLOCK_CHARS characters; every
block is run against all documents in one narrow pass without a shuffle.

Defined cases: null or wordless texts have no leaks; leaks() leaves out rows with a null doc_id, which
without_leaks() screens like others; rows with a null item_id and items without words are left out;
of equally near places of an item the first is given; repeated rows give repeated hits; extra columns
are ignored (and kept by without_leaks).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import table

RATE = 0.2
WALKS, SAMPLES, BITS, SPREAD = 6, 16, 4, 12
#: Windows that are walked at once.
WALK_WINDOWS = 1 << 14
#: Words of stretches that are aligned at once.
ALIGN_WORDS = 1 << 19
#: Words of an item, beyond its allowed edits, by which its places are looked up.
SEEDS = 3
MASK = np.uint64((1 << 20) - 1)
BLOCK_CHARS = 8_000_000
HITS = "doc_id long, item_id long, distance long, first_word long, item_words long"


def _words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s, e, woff = tk.word_spans(data, off, tk.PUNCT)
    return tk.span_hash(tk.prefix_code(data, tk.FOLDED_CODE), s, e), woff


@functools.lru_cache(10_000)
def sampled_steps(n: int, walk: int) -> np.ndarray:
    """SAMPLES rows of steps of a walk over n words, those of a row close together."""
    rnd = np.random.default_rng([n, walk])
    steps = 2 * n
    first = rnd.integers(0, max(1, steps - SPREAD + 1), SAMPLES)
    return np.stack([lo + np.sort(rnd.choice(min(SPREAD, steps), min(BITS, steps), replace=False)) for lo in first])


def cgk_reads(words: np.ndarray, start: np.ndarray, stop: np.ndarray, n: int, walk: int) -> np.ndarray:
    """The words that a walk over the windows words[start:stop] of n words at most reads at its sampled
    steps, one row a step in rising order; 0 past a window's end."""
    wanted = np.unique(sampled_steps(n, walk))
    out = np.zeros((len(wanted), len(start)), np.uint64)
    at, k = start.copy(), 0
    for j in range(int(wanted[-1]) + 1):
        read = np.where(at < stop, words[np.minimum(at, len(words) - 1)], np.uint64(0))
        if j == wanted[k]:
            out[k] = read
            k += 1
        at += (tk.mix(read ^ np.uint64(walk * 100_003 + j * 7 + 1)) >> np.uint64(63)).astype(np.int64)
    return out


def shares_key(item: np.ndarray, reads: np.ndarray, n: int, walk: int) -> np.ndarray:
    """Which windows have a key in common with the item, whose own reads are item."""
    steps = sampled_steps(n, walk)
    at = np.searchsorted(np.unique(steps), steps)
    # keys of nothing but padding say nothing
    at = at[(item[at] != 0).any(axis=1)]
    return (reads == item[:, None])[at].all(axis=1).any(axis=0)


class Index:
    """A block of items, and for each the words by which its places are looked up.

    An item of n words and k allowed edits keeps at least n - k of its words in any leaking run,
    so of any k + SEEDS of its words at least SEEDS stand in a run of n + k words of the
    document. The item's rarest words in the corpus are taken; an item with fewer words than that
    takes all of them."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        data, off = tk.text_buffer(pa.array([t for _, t in items], pa.string()))
        words, woff = _words(data, off)
        self.items = [(i, words[woff[k] : woff[k + 1]]) for k, (i, _) in enumerate(items) if woff[k + 1] > woff[k]]
        self.size = np.array([len(w) for _, w in self.items], np.int64)
        self.edits = (self.size * rate).astype(np.int64)
        self.vocab = np.unique(np.concatenate([w for _, w in self.items] or [np.zeros(0, np.uint64)]))
        self.look_up(np.ones(len(self.vocab)))

    def look_up(self, freq: np.ndarray) -> None:
        """Choose the words of each item by their counts in the corpus, freq along vocab."""
        token, item, self.need = [], [], np.zeros(len(self.items), np.int64)
        for x, (_, w) in enumerate(self.items):
            at = np.argsort(freq[np.searchsorted(self.vocab, w)], kind="stable")[: self.edits[x] + SEEDS]
            seeds = np.unique(w[at])
            token.append(seeds)
            item.append(np.full(len(seeds), x))
            self.need[x] = len(at) - self.edits[x]
        token, item = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (token, item))
        order = np.lexsort((item, token))
        self.token, first = np.unique(token[order], return_index=True)
        self.first = np.append(first, len(order))
        self.item = item[order].astype(np.int64)
        self.mask = bit_mask(self.token)
        zero = np.zeros(1, np.int64)
        self.reads = [[cgk_reads(w, zero, zero + len(w), len(w), walk)[:, 0] for walk in range(WALKS)] for _, w in self.items]


def bit_mask(words: np.ndarray) -> np.ndarray:
    """A table that is False for most hashes not in words."""
    mask = np.zeros(1 << 20, bool)
    mask[(words & MASK).astype(np.int64)] = True
    return mask


def vocab_counts(vocab: np.ndarray, mask: np.ndarray, words: np.ndarray) -> np.ndarray:
    words = words[mask[(words & MASK).astype(np.int64)]]
    at = np.minimum(np.searchsorted(vocab, words), len(vocab) - 1)
    return np.bincount(at[vocab[at] == words], minlength=len(vocab))


def best_alignments(item: np.ndarray, words: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distance, end) of the run nearest to item in each of the stretches words[lo:hi], by word
    edit distance. Shorter stretches are filled up at their ends, which brings no run nearer."""
    m = int((hi - lo).max())
    at = lo[:, None] + np.arange(m)
    read = words[np.minimum(at, len(words) - 1)]
    vocab = np.unique(item)
    own = np.minimum(np.searchsorted(vocab, read), len(vocab) - 1).astype(np.int32)
    own[(at >= hi[:, None]) | (vocab[own] != read)] = -1
    ramp = np.arange(m + 1, dtype=np.int32)
    row = np.zeros((len(lo), m + 1), np.int32)
    for k, w in enumerate(np.searchsorted(vocab, item)):
        new = np.empty_like(row)
        new[:, 0] = k + 1
        np.minimum(row[:, :-1] + (own != w), row[:, 1:] + 1, out=new[:, 1:])
        new -= ramp
        row = np.minimum.accumulate(new, axis=1)
        row += ramp
    end = row.argmin(axis=1)
    return row[np.arange(len(lo)), end], end


def _places(index: Index, words: np.ndarray, woff: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, lo, hi) of the stretches that may hold a leak: every leaking run lies in one."""
    p = np.flatnonzero(index.mask[(words & MASK).astype(np.int64)])
    at = np.minimum(np.searchsorted(index.token, words[p]), len(index.token) - 1)
    known = index.token[at] == words[p]
    p, at = p[known], at[known]
    n = index.first[at + 1] - index.first[at]
    pos = np.repeat(p, n)
    item = index.item[np.repeat(index.first[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    doc = np.searchsorted(woff, pos, "right") - 1
    group = doc * len(index.items) + item
    order = np.lexsort((pos, group))
    pos, item, doc, group = pos[order], item[order], doc[order], group[order]
    last = np.arange(len(pos)) + index.need[item] - 1
    end = np.minimum(last, max(0, len(pos) - 1))
    width = index.size[item] + index.edits[item]
    ok = (last < len(pos)) & (group[end] == group) & (pos[end] - pos < width)
    lo = np.maximum(pos[end] - width + 1, woff[doc])[ok]
    hi = np.minimum(pos + width, woff[doc + 1])[ok]
    return _joined(doc[ok], item[ok], lo, hi)


def _joined(doc: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches of one text and item that overlap as one; given by text, item and lo, hi rising with lo."""
    new = np.ones(len(lo), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (lo[1:] > hi[:-1])
    last = np.append(new[1:], True) if len(new) else new
    return doc[new], item[new], lo[new], hi[last]


def _bounded(item: np.ndarray, edits: int, words: np.ndarray, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, lo, hi): the parts of the stretches in which some len(item) + edits words hold at least
    len(item) - edits words of item."""
    n, width = hi - lo, len(item) + edits
    at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
    of = np.repeat(np.arange(len(lo)), n)
    own = np.unique(item)
    held = own[np.minimum(np.searchsorted(own, words[at]), len(own) - 1)] == words[at]
    up_to = np.concatenate([[0], np.cumsum(held)])
    last = np.minimum(np.arange(len(at)) + width, np.cumsum(n)[of])
    ok = up_to[last] - up_to[:-1] >= len(item) - edits
    first, of = at[ok], of[ok]
    doc, _, lo, hi = _joined(doc[of], np.zeros(len(of), np.int64), first, np.minimum(first + width, hi[of]))
    return doc, lo, hi


def _candidates(index: Index, x: int, words: np.ndarray, end: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The stretches words[lo:hi] with a window that shares a key with item x. end: of their texts."""
    n, edits = int(index.size[x]), int(index.edits[x])
    found = np.zeros(len(lo), bool)
    # a leaking run has n - edits words at least, so later windows can't begin one
    many = np.maximum(hi - (n - edits) - lo, 0) + 1
    for walk in range(WALKS):
        todo = np.flatnonzero(~found)
        i = 0
        while i < len(todo):
            j = i + max(1, int(np.searchsorted(np.cumsum(many[todo[i:]]), WALK_WINDOWS, "right")))
            own = todo[i:j]
            of = np.repeat(own, many[own])
            start = lo[of] + np.arange(len(of)) - np.repeat(np.cumsum(many[own]) - many[own], many[own])
            reads = cgk_reads(words, start, np.minimum(start + n, end[of]), n, walk)
            found[of[shares_key(index.reads[x][walk], reads, n, walk)]] = True
            i = j
    return found


def _leaks(index: Index, words: np.ndarray, woff: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
    """{(text, item): (distance, first word, item's words)}."""
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    if not len(words) or not len(index.items):
        return found
    docs, items, los, his = _places(index, words, woff)
    order = np.argsort(items, kind="stable")
    docs, items, los, his = docs[order], items[order], los[order], his[order]
    for x in np.unique(items):
        a, b = np.searchsorted(items, [x, x + 1])
        (item_id, item), edits, n = index.items[x], int(index.edits[x]), int(index.size[x])
        doc, lo, hi = _bounded(item, edits, words, docs[a:b], los[a:b], his[a:b])
        some = _candidates(index, x, words, woff[doc + 1], lo, hi)
        doc, lo, hi = doc[some], lo[some], hi[some]
        order = np.argsort(hi - lo, kind="stable")
        doc, lo, hi = doc[order], lo[order], hi[order]
        i = 0
        while i < len(lo):
            size = hi[i:] - lo[i:]
            j = i + max(1, int(np.searchsorted(size * np.arange(1, len(size) + 1), ALIGN_WORDS, "right")))
            distance, end = best_alignments(item, words, lo[i:j], hi[i:j])
            near = np.flatnonzero(distance <= edits)
            first = np.maximum(0, lo[i:j] + end - n - woff[doc[i:j]])
            for d, k, at in zip(doc[i:j][near].tolist(), distance[near].tolist(), first[near].tolist(), strict=True):
                if (d, item_id) not in found or (k, at) < found[d, item_id][:2]:
                    found[d, item_id] = (k, at, n)
            i = j
    return found


def _indexes(docs: DataFrame, items: DataFrame, rate: float) -> Iterator[Index]:
    """The items in blocks, their words to be looked up chosen by counts over docs(text)."""
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.where("item_id is not null and text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = chars // BLOCK_CHARS + 1
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).distinct().orderBy("item_id", "text").collect()
        block = Index([(r.item_id, r.text) for r in rows], rate)
        if not block.items:
            continue
        vocab = spark.sparkContext.broadcast(block.vocab)

        def count(it: Iterator[pa.RecordBatch], vocab=vocab) -> Iterator[pa.RecordBatch]:
            total, mask = np.zeros(len(vocab.value), np.int64), bit_mask(vocab.value)
            for batch in it:
                for _, _, part, poff in tk.chunks(*tk.text_buffer(batch.column(0))):
                    total += vocab_counts(vocab.value, mask, _words(part, poff)[0])
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], names=["word", "n"])

        freq = np.zeros(len(block.vocab))
        for r in docs.select(F.col("text").cast("string")).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
            freq[r.word] = r.n
        block.look_up(freq)
        yield block


def leaks(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """One row for each document and item that leaks into it: docs(doc_id, text) against
    items(item_id, text). distance is the least found, first_word where its run begins, about
    (exactly where lengths agree)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    out = None
    for block in _indexes(docs, items, rate):
        index = spark.sparkContext.broadcast(block)

        def search(it: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in it:
                data, off = tk.text_buffer(batch.column(1))
                for i, _, part, poff in tk.chunks(data, off):
                    hits = sorted(_leaks(index.value, *_words(part, poff)).items())
                    at = pa.array([i + d for (d, _), _ in hits], pa.int64())
                    cols = [batch.column(0).take(at), pa.array([k for (_, k), _ in hits], pa.int64())]
                    cols += [pa.array([v[c] for _, v in hits], pa.int64()) for c in range(3)]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "item_id", "distance", "first_word", "item_words"])

        part = docs.mapInArrow(search, HITS)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], HITS)


def without_leaks(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of docs into which no item leaks, with all their columns; rows, not ids, are judged."""
    at = docs.columns.index("text")
    for block in _indexes(docs, items, rate):
        index = docs.sparkSession.sparkContext.broadcast(block)

        def screen(it: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in it:
                clean = np.ones(batch.num_rows, bool)
                for i, _, part, poff in tk.chunks(*tk.text_buffer(batch.column(at).cast(pa.string()))):
                    clean[[i + d for d, _ in _leaks(index.value, *_words(part, poff))]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(screen, docs.schema)
    return docs


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
