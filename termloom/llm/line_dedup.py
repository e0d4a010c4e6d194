"""Line dedup with a log-template tree of fixed depth.

A line's path in the tree is its number of words and its first LEAD words; words with a digit are
variable fields and are generalised. Under a leaf, lines that agree in every generalised word are
one form. Forms of MIN_SIMILAR words or more that agree in at least SIMILAR percent of their words
are linked, and linked forms (connected components) are instances of one template, their differing
words being further variable fields; a leaf holds any number of templates. A form, or a template
with its instances, that stands in at least MIN_DOCS documents recurs; one of LONG words or more
recurs from MIN_DOCS_LONG documents on, as so long a line does not repeat by chance. It stays in the
document with the smallest doc_id and is dropped from all others, so one document of a group of
copies stays whole.

Lines travel as 64-bit hashes with two bytes a word, deduplicated within documents. The forms of one
leaf (equal word count, first words equal) meet in one task, never its lines. Forms that agree in
SIMILAR percent have one of k + 1 bands of positions in common, k being the words that may differ,
so only forms that share a band are compared, and no link is lost to that. Two bytes a word may take
different words for equal ones, but never lose a link; what they link is linked again by the words' full
64-bit hashes, read from the first document of each such form.

Defined cases: null text is empty and stays null; lines without words are never dropped; rows with
null doc_id neither count nor lose lines; rows that repeat a doc_id are one document and lose the
same lines; of several documents that could keep a line the smallest doc_id does, and equally frequent
forms are treated alike; extra columns are kept, but for those named n_lines or n_dropped, which are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as tk
from .common import staged, table

LEAD, MIN_DOCS = 3, 3
LONG, MIN_DOCS_LONG = 50, 2
#: Up to so many forms (two longs each) are sent to every task to pick lines by; beyond, lines are joined.
FORM_BROADCAST = 500_000
#: Forms of a leaf up to which no bands are made.
SMALL = 64
MIN_SIMILAR, SIMILAR = 6, 80
_FIELD = np.uint64(0xD1B54A32D192ED03)
LINES = "doc_id long, h long, leaf long, n long, sig binary"
TEMPLATES = "leaf long, n long, h long, template long"


def line_forms(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(line offsets, first line of each text, form hash, leaf hash, words, word hashes, word
    offsets) of all lines; a text has one line more than it has \\n."""
    nl = np.flatnonzero(data == 10) + 1
    # a text's lines begin at its start and after each \n, even one that ends it
    starts = np.concatenate([off[:-1], nl])
    text = np.concatenate([np.arange(len(off) - 1), np.searchsorted(off, nl - 1, "right") - 1])
    order = np.lexsort((starts, text))
    starts, text = starts[order], text[order]
    loff = np.append(starts, len(data))
    first = np.searchsorted(text, np.arange(len(off)))
    s, e, woff = tk.word_spans(data, loff, tk.SPACE)
    w = tk.span_hash(tk.prefix_code(data, tk.BYTE_CODE), s, e)
    digits = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
    w = np.where(digits[e] > digits[s], _FIELD, w)
    n = np.diff(woff)
    pre = np.zeros(len(w) + 1, np.uint64)
    pows, inv = tk.powers(len(w) + 1)
    np.cumsum(w * inv[: len(w)], out=pre[1:])
    form = tk.mix((pre[woff[1:]] - pre[woff[:-1]]) * pows[woff[:-1]] + n.astype(np.uint64) * tk._M1)
    leaf = tk.mix(n.astype(np.uint64))
    for k in range(LEAD):
        at = np.minimum(woff[:-1] + k, max(0, len(w) - 1))
        leaf = tk.mix(leaf ^ np.where(k < n, w[at] if len(w) else np.uint64(0), np.uint64(k)))
    return loff, first, form, leaf, n, w, woff


def _signed(batch: pa.RecordBatch, kind: type) -> Iterator[pa.RecordBatch]:
    """The distinct lines of each text, with the leading bytes of their words' hashes as kind has them."""
    width = np.dtype(kind).itemsize
    data, off = tk.text_buffer(batch.column(1))
    for i, _, part, poff in tk.chunks(data, off):
        _, first, form, leaf, n, w, woff = line_forms(part, poff)
        text = np.repeat(np.arange(len(poff) - 1), np.diff(first))
        at = np.flatnonzero(n > 0)
        order = at[np.lexsort((form[at], text[at]))]
        new = np.ones(len(order), bool)
        new[1:] = (form[order[1:]] != form[order[:-1]]) | (text[order[1:]] != text[order[:-1]])
        at = order[new]
        take = np.repeat(woff[at] - np.cumsum(n[at]) + n[at], n[at]) + np.arange(n[at].sum())
        sig = (w[take] >> np.uint64(64 - 8 * width)).astype(kind)
        soff = np.concatenate([[0], width * np.cumsum(n[at])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(i + text[at])),
                pa.array(tk.to_int64(form[at])),
                pa.array(tk.to_int64(leaf[at])),
                pa.array(n[at].astype(np.int64)),
                pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(soff.tobytes()), pa.py_buffer(sig.tobytes())]),
            ],
            names=["doc_id", "h", "leaf", "n", "sig"],
        )


def _lines(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        yield from _signed(batch, np.uint16)


def _whole_lines(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        yield from _signed(batch, np.uint64)


def components(sig: np.ndarray) -> np.ndarray:
    """For each row of sig (forms by words) the least row that it is linked to by steps of agreement."""
    m, n = sig.shape
    need = -(-SIMILAR * n // 100)
    label = np.arange(m)
    # few forms are compared all with all, as if they shared one band
    bands = [np.arange(LEAD)] if m <= SMALL else np.array_split(np.arange(LEAD, n), n - need + 1)
    for band in bands:
        key = np.ascontiguousarray(sig[:, band]).view(f"V{sig.itemsize * len(band)}").ravel()
        _, of = np.unique(key, return_inverse=True)
        order = np.argsort(of, kind="stable")
        for todo in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
            if len(todo) < 2 or (label[todo] == label[todo[0]]).all():
                continue
            while len(todo):
                front, todo = [todo[0]], todo[1:]
                group = list(front)
                while front and len(todo):
                    near = (sig[todo] == sig[front.pop()]).sum(axis=1) >= need
                    group += todo[near].tolist()
                    front += todo[near].tolist()
                    todo = todo[~near]
                old = np.unique(label[group])
                if len(old) > 1:
                    label[np.isin(label, old)] = old[0]
    return label


def _templates(kind: type):
    def templates(forms: pa.Table) -> pa.Table:
        """(leaf, n, h, template) of the forms of one leaf that are linked to others."""
        forms = forms.sort_by("h")
        n = forms["n"][0].as_py()
        h = forms["h"].to_numpy()
        label = components(np.frombuffer(b"".join(forms["sig"].to_pylist()), kind).reshape(len(h), n))
        many = np.bincount(label, minlength=len(h))[label] > 1
        own = forms.filter(pa.array(many))
        return pa.table({"leaf": own["leaf"], "n": own["n"], "h": pa.array(h[many]), "template": pa.array(h[label[many]])})

    return templates


def _enough() -> Column:
    """Documents from which on a line of n words recurs."""
    return F.when(F.col("n") >= LONG, MIN_DOCS_LONG).otherwise(MIN_DOCS)


def recurring(docs: DataFrame) -> DataFrame:
    """(doc_id, forms): the forms that each document loses."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    lines = staged(ids.mapInArrow(_lines, LINES), "lines")
    # a document's lines are distinct, but for rows that repeat its id
    twice = staged(ids.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id"), "twice")
    if not twice.isEmpty():
        own = lines.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id", "h"])
        lines = lines.join(twice, "doc_id", "left_anti").unionByName(own)
    forms = staged(lines.groupBy("leaf", "h", "n").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"), F.first("sig").alias("sig")), "forms")
    leaves = forms.where(F.col("n") >= MIN_SIMILAR).groupBy("leaf", "n").agg(F.count("*").alias("n_forms"), F.sum("n_docs").alias("all_docs"))
    leaves = leaves.where((F.col("n_forms") > 1) & (F.col("all_docs") >= _enough())).select("leaf")
    shared = forms.where(F.col("n") >= MIN_SIMILAR).join(leaves, "leaf").select("leaf", "h", "n", "sig")
    may = staged(shared.groupBy("leaf").applyInArrow(_templates(np.uint16), TEMPLATES), "may")
    # the whole words of those forms, from the first document of each
    reps = staged(may.select("h", "leaf").join(forms.select("h", "leaf", F.col("first_doc").alias("doc_id")), ["h", "leaf"]), "reps")
    sent = F.broadcast if reps.count() <= FORM_BROADCAST else lambda x: x
    some = ids.join(sent(reps.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", "text")
    whole = some.mapInArrow(_whole_lines, LINES).join(sent(reps), ["doc_id", "h", "leaf"], "left_semi").dropDuplicates(["leaf", "h"])
    near = staged(whole.groupBy("leaf").applyInArrow(_templates(np.uint64), TEMPLATES), "near")
    templates = lines.join(near.drop("n"), ["leaf", "h"]).groupBy("leaf", "template").agg(F.count_distinct("doc_id").alias("n_docs"), F.min("doc_id").alias("first_doc"))
    by_template = near.join(templates, ["leaf", "template"]).where(F.col("n_docs") >= _enough()).select("h", "first_doc")
    drop = forms.where(F.col("n_docs") >= _enough()).select("h", "first_doc").unionByName(by_template).groupBy("h").agg(F.min("first_doc").alias("first_doc"))
    hits = lines.join(staged(drop, "drop"), "h").where("doc_id > first_doc").select("doc_id", "h")
    return hits.groupBy("doc_id").agg(F.collect_set("h").alias("forms"))


def without_recurring(docs: DataFrame) -> DataFrame:
    """docs with text less its recurring lines, and the columns n_lines and n_dropped."""
    docs = docs.drop("n_lines", "n_dropped")
    lost = recurring(docs).withColumnsRenamed({"doc_id": "_id", "forms": "_forms"})
    joined = docs.withColumn("text", F.col("text").cast("string")).join(lost, F.col("doc_id").cast("long") == F.col("_id"), "left").drop("_id")
    names = docs.columns
    at = names.index("text")
    schema = T.StructType([f for f in joined.schema if f.name != "_forms"] + [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def apply(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            forms = batch.column(batch.schema.get_field_index("_forms"))
            data, off = tk.text_buffer(batch.column(at))
            texts, n_lines, n_dropped = [], [], []
            for i, j, part, poff in tk.chunks(data, off):
                loff, first, form, _, n, _, _ = line_forms(part, poff)
                for d in range(j - i):
                    lo, hi = int(first[d]), int(first[d + 1])
                    n_lines.append(hi - lo)
                    gone = forms[i + d].values
                    if gone is None or not len(gone):
                        texts.append(batch.column(at)[i + d].as_py())
                        n_dropped.append(0)
                        continue
                    out = np.isin(form[lo:hi], np.asarray(gone).view(np.uint64)) & (n[lo:hi] > 0)
                    raw = part[poff[d] : poff[d + 1]].tobytes().split(b"\n")
                    texts.append(b"\n".join(x for x, o in zip(raw, out, strict=True) if not o).decode())
                    n_dropped.append(int(out.sum()))
            cols = [pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*names, "n_lines", "n_dropped"])

    return joined.select(*names, "_forms").mapInArrow(apply, schema)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_recurring(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "text")
