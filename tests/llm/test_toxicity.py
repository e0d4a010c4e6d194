import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from termloom.llm import textkernel as tk
from termloom.llm.toxicity import DIM, WIDTHS, TextCnn, _buckets, labelled_sample, op10_toxicity, shards, toxicity


def corpus(n=900, seed=1):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 7))) for _ in range(500)]
    docs, labels = [], []
    for d in range(n):
        text = [rnd.choice(words) for _ in range(rnd.randint(20, 150))]
        toxic = int(d % 3 == 0)
        if toxic:
            text[rnd.randrange(len(text))] = rnd.choice(["zorgface", "Quixtard", "wumpling"])
        docs.append((d, " ".join(text) + ".", "en", "s"))
        labels.append((d, 1, toxic))
    return docs, labels


def test_held_out_accuracy_and_fold(spark):
    docs, labels = corpus()
    out = toxicity(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(out) == len(docs)
    truth = {d: t for d, _, t in labels}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_defined_cases(spark):
    docs, labels = corpus(300)
    docs += [(1000, None, None, None), (1001, "", "xx", "s"), (None, "plain words", "en", "s"), (5, docs[5][1], "en", "s"), (1002, "word " * 200_000 + "zorgface", "en", "s")]
    labels += [(None, 1, 1), (7, None, None), (2000, 0, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as score", "true as held_out")
    out = toxicity(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(out) == len(docs) and all(r.score is not None for r in out)
    assert [r.held_out for r in out if r.doc_id is None] == [None]
    assert [r.predicted for r in out if r.doc_id == 1002] == [1]
    none = toxicity(d, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert {r.score for r in none} == {0.0}
    assert toxicity(d.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_whole_table_reruns_agree(spark, sf_dir):
    a, b = (sorted((r.doc_id, r.score) for r in op10_toxicity(spark, sf_dir).collect()) for _ in range(2))
    assert a == b


def test_inference_against_a_plain_convolution():
    """Table look-ups equal filters slid over each padded text, one text at a time."""
    rnd = np.random.default_rng(7)
    model = TextCnn()
    for k, v in model.p.items():
        model.p[k] = rnd.normal(0, 0.5, v.shape).astype(np.float32)
    for k in (0, 1):
        model.p[f"e{k}"][0] = 0
    texts = ["", "one", "one two", "a b c d e f g", "ÄB cd\nef! gh", "w " * 500 + "x"]
    data, off = tk.text_buffer(pa.array(texts, pa.string()))
    got = model.logits(data, off, model.lookups())
    for text, z in zip(texts, got, strict=True):
        b0, b1, _ = _buckets(*tk.text_buffer(pa.array([text], pa.string())))
        pad = max(WIDTHS) - 1
        rows = np.concatenate([model.p["e0"][b0] + model.p["e1"][b1], np.zeros((2 * pad, DIM))])
        pooled = []
        for w in WIDTHS:
            places = [sum(rows[i + o] @ model.p[f"w{w}"][o] for o in range(w)) for i in range(max(1, len(b0)))]
            pooled.append(np.max(places, axis=0) + model.p[f"b{w}"])
        want = (np.tanh(np.concatenate(pooled) / 2) * 2) @ model.p["v"] + model.p["c"][0]
        assert abs(z - want) < 1e-3, text[:20]


def test_long_texts_are_sampled_too(spark):
    docs, labels = corpus(400)
    docs = [(d, ("filler " * 20_000 + t) if x[0] and d % 9 == 0 else t, *r) for (d, t, *r), x in zip(docs, [(lab[2],) for lab in labels], strict=True)]
    rows = labelled_sample(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").select("doc_id", "text", "lang"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert any(len(r.text) > 100_000 for r in rows) and {r.part for r in rows} == {1, 2, 3, 4}


def test_all_labelled_rows_are_learned_from(spark):
    """A word that only the toxic rows have that are last by hash, beyond the first 2000; and rows in another order."""
    docs, labels = corpus(9000)
    toxic = [r.id for r in spark.range(0, 9000, 3).orderBy(F.xxhash64("id"), "id").collect()]
    fitted = [d for d in toxic if zlib.crc32(str(d).encode()) % 5]
    held = [d for d in toxic if zlib.crc32(str(d).encode()) % 5 == 0][::2]
    assert len(fitted) > 2300
    for d in fitted[-300:] + held:
        _, text, *rest = docs[d]
        docs[d] = (d, re.sub("zorgface|Quixtard|wumpling", "blorvex", text), *rest)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = [r.doc_id for r in shards(df, marks).collect()]
    assert sorted(rows) == [d for d in range(9000) if zlib.crc32(str(d).encode()) % 5]
    got = {r.doc_id: (r.score, r.predicted, r.lang_threshold) for r in toxicity(df, marks).collect()}
    assert sum(got[d][1] for d in held) >= 0.95 * len(held)
    again = toxicity(df.repartition(7, "text"), marks.repartition(3, "doc_id")).collect()
    assert {r.doc_id: (r.score, r.predicted, r.lang_threshold) for r in again} == got
