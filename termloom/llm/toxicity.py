"""Toxicity scores from a convolutional text classifier in numpy.

Words (runs of letters, A-Z lower-cased) get an embedding that is the sum of a row of each of two
hashed tables; filters of widths 1 to 3 run over the whole text from each word on, max pooling takes each
filter's strongest place, a logistic layer gives the score. Only the text enters a score.

Training reads every labelled row outside the held-out fold, whole. Rows are dealt by a hash of doc_id to
shards of about SHARD_ROWS rows and SHARD_CHARS characters, each in one file of a staged table.
Embeddings start from a lower confidence bound of each word's log odds, from counts over all rows. Then
everything is trained by Adam: in each round every shard trains a copy of the model for some epochs,
and the changes are averaged, an embedding's over the shards that changed it. Changes are summed on the
executors as whole numbers, so results don't depend on how shards were dealt to tasks. Thresholds come from
rows outside the fit: a model for each of the other four folds, trained alike without it, scores that fold.
Of these scores, rounded to 1 / GRID, all rows are counted; the intercept is set so that 0.5 is
the best single threshold, and thresholds are calibrated by language, which are returned beside it. The
model itself is fitted on all folds but the held-out one.

Inference is one narrow pass: the convolution is unrolled into table look-ups by word bucket.

Defined cases: null or wordless texts score as a text without any feature; without usable labels
of both kinds every score is 0; a null doc_id is in no fold (held_out null); of rows that repeat a doc_id
the one with the least text is learned from; repeated labels count once, as toxic if one says so; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import new_path
from . import textkernel as tk
from .common import staged, table

#: Rows and characters that a shard of the training rows holds, about (a text is never divided).
SHARD_ROWS, SHARD_CHARS = 2048, 8_000_000
#: Up to so many labels are sent to every task to find their texts; beyond, texts are joined by id.
LABEL_BROADCAST = 2_000_000
#: Rows of each label that a language needs for a threshold of its own.
FEW = 20
#: Bytes of text that training takes apart at once.
PIECE = 1 << 18
BUCKETS = 1 << 17
DIM, FILTERS, WIDTHS = 4, 4, (1, 2, 3)
#: Epochs that a shard trains by itself in each round; rows and words of a step.
EPOCHS, BATCH, BATCH_WORDS = (3, 2), 128, 1 << 18
#: The held-out fold, and the others. A model is named by the fold that it is fitted without.
HELD, FOLDS = 0, (1, 2, 3, 4)
#: Steps that a whole unit of a logit has in the counts that thresholds come from.
GRID = 1024
#: Ranges of keys that sums are made by; fixed point of summed changes.
SLOTS, POINT = 128, 2.0**24
SCORES = "doc_id long, lang string, held_out boolean, score double"


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def _buckets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    s, e, woff = tk.word_spans(data, off, tk.NOT_LETTER)
    h = tk.span_hash(tk.prefix_code(data, tk.FOLDED_CODE), s, e)
    mask = np.uint64(BUCKETS - 1)
    return (h & mask).astype(np.int32) + 1, ((h >> np.uint64(32)) & mask).astype(np.int32) + 1, woff


def _padded(b: np.ndarray, woff: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with a window of bucket 0 after each text, so that windows never cross texts and no text
    is empty."""
    pad = max(WIDTHS)
    poff = woff + pad * np.arange(len(woff))
    out = np.zeros(int(poff[-1]) + pad, np.int32)
    out[np.arange(len(b)) + pad * np.repeat(np.arange(len(woff) - 1), np.diff(woff))] = b
    return out, poff


def _outside(poff: np.ndarray, n: int) -> np.ndarray:
    """Places at which no window begins: all but those of words, or the first of a text without words.
    The padding is long enough for the windows that begin."""
    own = np.maximum(np.diff(poff) - max(WIDTHS), 1)
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, poff[:-1], 1)
    np.add.at(change, poff[:-1] + own, -1)
    return np.cumsum(change)[:n] <= 0


#: Parameters behind the two tables of embeddings, with their shapes.
SMALL = {f"w{w}": (w, DIM, FILTERS) for w in WIDTHS} | {f"b{w}": (FILTERS,) for w in WIDTHS} | {"v": (len(WIDTHS) * FILTERS,), "c": (1,)}


class TextCnn:
    """All parameters are views of flat, rows of DIM numbers: the two tables, then the rest."""

    def __init__(self, seed: int = 11, flat: np.ndarray | None = None):
        tables = 2 * (BUCKETS + 1)
        rest = sum(int(np.prod(x)) for x in SMALL.values())
        self.flat = np.zeros((tables + -(-rest // DIM), DIM), np.float32) if flat is None else flat.copy()
        self.p = {f"e{k}": self.flat[k * (BUCKETS + 1) : (k + 1) * (BUCKETS + 1)] for k in (0, 1)}
        at, tail = 0, self.flat[tables:].reshape(-1)
        for name, shape in SMALL.items():
            n = int(np.prod(shape))
            self.p[name] = tail[at : at + n].reshape(shape)
            at += n
        if flat is not None:
            return
        rnd = np.random.default_rng(seed)
        for k in (0, 1):
            self.p[f"e{k}"][:] = rnd.normal(0, 0.01, (BUCKETS + 1, DIM))
            self.p[f"e{k}"][0] = 0
        for w in WIDTHS:
            self.p[f"w{w}"][:] = rnd.normal(0, 0.3, (w, DIM, FILTERS))
            self.p[f"w{w}"][0, 0] = np.abs(self.p[f"w{w}"][0, 0]) + 0.3
        self.p["v"][:] = 0.2
        self.p["c"][:] = -2.0

    def start_from_odds(self, c1: np.ndarray, c0: np.ndarray, n1: int, n0: int) -> None:
        """From the texts of each label that have a bucket, (2, BUCKETS + 1), and those there are."""
        c1, c0 = c1 + 0.5, c0 + 0.5
        odds = np.log(c1 / c0) + np.log(max(1, n0) / max(1, n1))
        odds = np.sign(odds) * np.maximum(0, np.abs(odds) - 2.4 * np.sqrt(1 / c1 + 1 / c0))
        odds[:, 0] = 0
        for k in (0, 1):
            self.p[f"e{k}"][:, 0] = odds[k] / 2

    def features(self, x0: np.ndarray, x1: np.ndarray, poff: np.ndarray, keep: bool = False):
        """Max-pooled filter values of each text, and where they stand."""
        emb = self.p["e0"][x0] + self.p["e1"][x1]
        n, out, where = len(x0), [], []
        outside = _outside(poff, n)
        for w in WIDTHS:
            z = np.zeros((n, FILTERS), np.float32)
            for o in range(w):
                z[: n - o] += emb[o:] @ self.p[f"w{w}"][o]
            z[outside] = -np.inf
            top = np.maximum.reduceat(z, poff[:-1], axis=0)
            if keep:
                doc = np.repeat(np.arange(len(poff) - 1), np.diff(np.append(poff[:-1], n)))
                row, col = np.nonzero(z == top[doc])
                first = np.full((len(top), FILTERS), n, np.int64)
                np.minimum.at(first, (doc[row], col), row)
                where.append(first)
            out.append(top + self.p[f"b{w}"])
        return np.concatenate(out, axis=1), where, emb

    def step(self, x0, x1, poff, label, weight) -> dict:
        f, where, emb = self.features(x0, x1, poff, True)
        a = np.tanh(f * 0.5) * 2  # bounded, so that no single word decides beyond reach
        p = 1 / (1 + np.exp(-(a @ self.p["v"] + self.p["c"])))
        d = ((p - label) * weight / len(label)).astype(np.float32)
        g = {"v": a.T @ d, "c": np.array([d.sum()], np.float32)}
        df = d[:, None] * self.p["v"][None] * (1 - (a / 2) ** 2)
        ge, n = {}, len(x0)
        at, val = [], []
        for k, w in enumerate(WIDTHS):
            dz = df[:, k * FILTERS : (k + 1) * FILTERS]
            g[f"b{w}"] = dz.sum(0)
            gw = np.zeros_like(self.p[f"w{w}"])
            for o in range(w):
                pos = np.minimum(where[k] + o, n - 1)
                inside = (where[k] + o < n)[..., None]
                gw[o] = np.einsum("dfe,df->ef", emb[pos] * inside, dz)
                at.append(pos.ravel())
                val.append((dz[..., None] * self.p[f"w{w}"][o].T[None] * inside).reshape(-1, DIM))
            g[f"w{w}"] = gw
        at, val = np.concatenate(at), np.concatenate(val)
        for k, x in ((0, x0), (1, x1)):
            rows, inv = np.unique(x[at], return_inverse=True)
            acc = np.zeros((len(rows), DIM), np.float32)
            np.add.at(acc, inv, val)
            acc[rows == 0] = 0
            ge[f"e{k}"] = (rows, acc)
        return g | ge

    def train(self, b0: np.ndarray, b1: np.ndarray, woff: np.ndarray, ids: np.ndarray, labels: np.ndarray, share: float, epochs: int, seed: list[int]) -> None:
        """Epochs over texts ids of a shard; share is that of label 1 in all rows."""
        rnd = np.random.default_rng(seed)
        weight = np.where(labels == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        for _ in range(epochs):
            for batch in _batches(rnd.permutation(ids), np.diff(woff)):
                take = np.concatenate([np.arange(woff[d], woff[d + 1]) for d in batch]).astype(np.int64)
                woff_b = np.concatenate([[0], np.cumsum(woff[batch + 1] - woff[batch])])
                x0, poff = _padded(b0[take], woff_b)
                x1, _ = _padded(b1[take], woff_b)
                t += 1
                for k, grad in self.step(x0, x1, poff, labels[batch], weight[batch]).items():
                    rate = 0.003 if k[0] == "e" else 0.02
                    rows, grad = grad if isinstance(grad, tuple) else (slice(None), grad)
                    m[k][rows] = 0.9 * m[k][rows] + 0.1 * grad
                    s[k][rows] = 0.99 * s[k][rows] + 0.01 * grad**2
                    self.p[k][rows] -= rate * (m[k][rows] / (1 - 0.9**t)) / (np.sqrt(s[k][rows] / (1 - 0.99**t)) + 1e-4)

    def lookups(self) -> list:
        """For each width and offset the filter values by bucket, of both tables."""
        return [(w, o, *(self.p[f"e{k}"] @ self.p[f"w{w}"][o] for k in (0, 1))) for w in WIDTHS for o in range(w)]

    def logits(self, data: np.ndarray, off: np.ndarray, tables: list) -> np.ndarray:
        b0, b1, woff = _buckets(data, off)
        x0, poff = _padded(b0, woff)
        x1, _ = _padded(b1, woff)
        n, z, out = len(x0), {}, []
        outside = _outside(poff, n)
        for w, o, t0, t1 in tables:
            if o == 0:
                z[w] = np.zeros((n, FILTERS), np.float32)
            z[w][: n - o] += t0[x0[o:]] + t1[x1[o:]]
        for w in WIDTHS:
            z[w][outside] = -np.inf
            out.append(np.maximum.reduceat(z[w], poff[:-1], axis=0) + self.p[f"b{w}"])
        a = np.tanh(np.concatenate(out, axis=1) * 0.5) * 2
        # row by row: a product of matrices rounds by the number of rows
        return ((a * self.p["v"]).sum(axis=1) + self.p["c"]).astype(np.float64)


def _batches(order: np.ndarray, words: np.ndarray) -> Iterator[np.ndarray]:
    """Runs of at most BATCH texts, and of at most BATCH_WORDS words unless one text has more."""
    at = n = 0
    for i, w in enumerate(words[order].tolist()):
        if i > at and (i - at == BATCH or n + w > BATCH_WORDS):
            yield order[at:i]
            at, n = i, 0
        n += w
    if at < len(order):
        yield order[at:]


def _best_threshold(cells: list[tuple[int, int, int]]) -> float:
    """The cut with the fewest errors, midway between neighbours, of (cell of GRID, rows of label 1, of label 0)."""
    x, n1, n0 = np.array(sorted(cells), np.int64).T
    x = np.concatenate([[x[0] - 1], x, [x[-1] + 1]]) / GRID
    errors = np.concatenate([[0], np.cumsum(n1)]) + n0.sum() - np.concatenate([[0], np.cumsum(n0)])
    best = np.flatnonzero(errors == errors.min())
    k = int(best[len(best) // 2])
    return float((x[k] + x[k + 1]) / 2)


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, lang, toxic, part) of all rows with a text and a usable label outside the held-out
    fold; part is their fold."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = staged(known.withColumn("part", fold(F.col("doc_id")).cast("int")).where(F.col("part") != HELD), "known")
    if known.count() <= LABEL_BROADCAST:
        known = F.broadcast(known)
    return docs.where(F.length("text") > 0).join(known, "doc_id").select("doc_id", "text", "lang", "toxic", "part")


def labelled_sample(docs: DataFrame, labels: DataFrame) -> list:
    """The rows that training learns from, on the driver: to look at those of a small table."""
    return labelled_rows(docs, labels).collect()


def shards(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(shard, doc_id, text, lang, toxic, part): all labelled rows, those of a shard in the order of doc_id, text
    and lang, in one row group of one file, which one task reads."""
    spark, rows = docs.sparkSession, labelled_rows(docs, labels)
    n, chars = rows.agg(F.count("*"), F.sum(F.length("text"))).first()
    k = max(1, -(-n // SHARD_ROWS), -(-(chars or 0) // SHARD_CHARS))
    rows = rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(k)).alias("shard"), "*").repartition(k, "shard").sortWithinPartitions("shard", "doc_id", "text", "lang")
    path = new_path(spark, "shards")
    rows.write.option("parquet.block.size", 1 << 29).parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _unpacked(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(shard, texts, langs, labels, folds) of each shard, one row a doc_id."""

    def whole() -> tuple:
        shard, doc, text, lang, toxic, part = (x.combine_chunks() for x in pa.Table.from_batches(held).columns)
        doc = doc.to_numpy()
        first = pa.array(np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])))
        return shard[0].as_py(), text.take(first), lang.take(first), toxic.take(first).to_numpy(), part.take(first).to_numpy()

    held, last = [], None
    for batch in it:
        shard = batch.column(0).to_numpy()
        at = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            if held and hi > lo and shard[lo] != last:
                yield whole()
                held = []
            if hi > lo:
                held.append(batch.slice(lo, hi - lo))
                last = shard[lo]
    if held:
        yield whole()


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [_buckets(piece, off) for _, _, piece, off in tk.chunks(*tk.text_buffer(texts), PIECE)]
    b0, b1 = (np.concatenate([x[k] for x in parts]) for k in (0, 1))
    return b0, b1, np.concatenate([[0], np.cumsum(np.concatenate([np.diff(x[2]) for x in parts]))])


def _sum_by_key(df: DataFrame, keys: int, width: int, made: Callable) -> tuple[np.ndarray, np.ndarray]:
    """The keys that occur, below keys, and their sums, rows of width whole numbers, of what made yields for
    the batches of df: (keys, values) without a key twice. One row a task and slot is exchanged."""

    def partial(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((keys, width), np.int64)
        for key, value in made(it):
            total[key] += value
        yield from packed(np.flatnonzero(total.any(axis=1)), total)

    def packed(used: np.ndarray, total: np.ndarray) -> Iterator[pa.RecordBatch]:
        slot = used * SLOTS // keys
        for k in np.unique(slot).tolist():
            own = used[slot == k]
            yield pa.RecordBatch.from_pydict({"slot": pa.array([k], pa.int32()), "keys": [own.astype(np.int64).tobytes()], "sums": [total[own].tobytes()]})

    def merged(group: pa.Table) -> pa.Table:
        key = np.concatenate([np.frombuffer(x, np.int64) for x in group.column("keys").to_pylist()])
        own, at = np.unique(key, return_inverse=True)
        total = np.zeros((len(own), width), np.int64)
        np.add.at(total, at, np.concatenate([np.frombuffer(x, np.int64).reshape(-1, width) for x in group.column("sums").to_pylist()]))
        return pa.table({"slot": group.column("slot").slice(0, 1), "keys": [own.tobytes()], "sums": [total.tobytes()]})

    kind = "slot int, keys binary, sums binary"
    rows = df.mapInArrow(partial, kind).groupBy("slot").applyInArrow(merged, kind).collect()
    key, total = (np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r[k], np.int64) for r in rows)]) for k in ("keys", "sums"))
    return key, total.reshape(-1, width)


def _word_counts(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Texts that have a bucket, by fold and label; key 0 of the first table, which no word has, counts texts."""
    for _, texts, _, label, part in _unpacked(it):
        b0, b1, woff = _words(texts)
        kind = (part - 1) * 2 + label
        doc = np.repeat(np.arange(len(label)), np.diff(woff))
        count = np.zeros((2 * (BUCKETS + 1), 2 * len(FOLDS)), np.int64)
        for k, b in ((0, b0), (1, b1)):
            order = np.lexsort((doc, b))
            d, x = doc[order], b[order]
            new = np.ones(len(d), bool)
            new[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1])
            at = (k * (BUCKETS + 1) + x[new].astype(np.int64)) * count.shape[1] + kind[d[new]]
            count += np.bincount(at, minlength=count.size).reshape(count.shape)
        count[0] = np.bincount(kind, minlength=count.shape[1])
        used = np.flatnonzero(count.any(axis=1))
        yield used, count[used]


def fit(packed: DataFrame) -> tuple[TextCnn | None, dict[str | None, float]]:
    """A model, and thresholds on its score by language, from all rows of shards."""
    spark = packed.sparkSession
    bucket, counts = _sum_by_key(packed, 2 * (BUCKETS + 1), 2 * len(FOLDS), _word_counts)
    models, share = {}, {}
    for name in (HELD, *FOLDS):
        own = np.zeros((2, 2 * (BUCKETS + 1)), np.int64)
        own[:, bucket] = counts.reshape(-1, len(FOLDS), 2)[:, [p != name for p in FOLDS]].sum(axis=1).T
        n0, n1 = own[:, 0].tolist()
        if n0 and n1:
            models[name], share[name] = TextCnn(), n1 / (n0 + n1)
            models[name].start_from_odds(own[1].reshape(2, -1), own[0].reshape(2, -1), n1, n0)
    if HELD not in models:
        return None, {}
    names, size = list(models), len(models[HELD].flat)
    for turn, epochs in enumerate(EPOCHS):
        sent = spark.sparkContext.broadcast([models[name].flat for name in names])

        def changes(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for shard, texts, _, label, part in _unpacked(it):
                b0, b1, woff = _words(texts)
                for k, name in enumerate(names):
                    ids = np.flatnonzero(part != name)
                    if len(ids):
                        own = TextCnn(flat=sent.value[k])
                        own.train(b0, b1, woff, ids, label.astype(np.float64), share[name], epochs, [3, turn, shard])
                        used = np.flatnonzero((own.flat != sent.value[k]).any(axis=1))
                        change = np.rint((own.flat[used].astype(np.float64) - sent.value[k][used]) * POINT).astype(np.int64)
                        yield k * size + used, np.column_stack([change, np.ones(len(used), np.int64)])

        row, moved = _sum_by_key(packed, len(names) * size, DIM + 1, changes)
        sent.destroy()
        for k, name in enumerate(names):
            own = row // size == k
            models[name].flat[row[own] % size] += (moved[own, :DIM] / (moved[own, DIM:] * POINT)).astype(np.float32)
    sent = spark.sparkContext.broadcast({name: net.flat for name, net in models.items()})

    def scores(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # where one label stands in one fold only, that fold is scored by the whole model
        nets = {name: TextCnn(flat=flat) for name, flat in sent.value.items()}
        tables = {name: net.lookups() for name, net in nets.items()}
        for _, texts, lang, label, part in _unpacked(it):
            for p in np.unique(part):
                name, own = (p if p in tables else HELD), pa.array(np.flatnonzero(part == p))
                for i, j, piece, off in tk.chunks(*tk.text_buffer(texts.take(own)), PIECE):
                    cell = np.rint(nets[name].logits(piece, off, tables[name]) * GRID).astype(np.int64)
                    mine = own.slice(i, j - i)
                    yield pa.RecordBatch.from_arrays([lang.take(mine), pa.array(cell), pa.array(label[mine.to_numpy()].astype(np.int64))], names=["lang", "cell", "toxic"])

    cells = packed.mapInArrow(scores, "lang string, cell long, toxic long").groupBy("lang", "cell").agg(F.sum("toxic").alias("n1"), F.sum(1 - F.col("toxic")).alias("n0"))
    cells = staged(cells, "cells")
    of_all = cells.groupBy("cell").agg(F.sum("n1"), F.sum("n0")).collect()
    cut = _best_threshold([tuple(r) for r in of_all])
    models[HELD].p["c"] -= np.float32(cut)
    sent.destroy()
    enough = cells.groupBy("lang").agg(F.sum("n1").alias("all1"), F.sum("n0").alias("all0")).where((F.col("all1") >= FEW) & (F.col("all0") >= FEW))
    by_lang: dict[str | None, list] = {}
    for r in cells.join(F.broadcast(enough.select(F.col("lang").alias("own"))), F.col("lang").eqNullSafe(F.col("own"))).collect():
        by_lang.setdefault(r.lang, []).append((r.cell, r.n1, r.n0))
    return models[HELD], {lang: float(1 / (1 + np.exp(cut - _best_threshold(x)))) for lang, x in by_lang.items()}


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, lang_threshold, flagged) for every row of
    docs(doc_id, text, lang), learned from labels(doc_id, toxic)."""
    spark = docs.sparkSession
    docs = docs.select(*(F.col(c).cast(t).alias(c) for c, t in (("doc_id", "long"), ("text", "string"), ("lang", "string"))))
    model, by_lang = fit(shards(docs, labels))
    shared = spark.sparkContext.broadcast(model.flat if model else None)

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = None if shared.value is None else TextCnn(flat=shared.value)
        tables = net.lookups() if net else []
        for batch in it:
            data, off = tk.text_buffer(batch.column(3))
            for i, j, part, poff in tk.chunks(data, off, 1 << 20):
                p = 1 / (1 + np.exp(-net.logits(part, poff, tables))) if net else np.zeros(j - i)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(3)), pa.array(p)], names=["doc_id", "lang", "held_out", "score"])

    scored = docs.select("doc_id", "lang", (fold(F.col("doc_id")) == 0).alias("held_out"), "text").mapInArrow(score, SCORES)
    cut = F.lit(0.5)
    for lang, at in sorted(by_lang.items(), key=str):
        cut = F.when(F.col("lang").eqNullSafe(F.lit(lang)), F.lit(at)).otherwise(cut)
    return scored.select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), cut.alias("lang_threshold"), (F.col("score") >= cut).alias("flagged")
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
