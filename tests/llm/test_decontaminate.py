import random
import re

import numpy as np

from termloom.llm.decontaminate import SAMPLES, WALKS, Index, cgk_reads, leaks, op7_decontaminate, shares_key, without_leaks
from tests.llm.brute import lower_ascii

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def distance(item, words):
    """Least word edit distance of item to a run of words."""
    row = [0] * (len(words) + 1)
    for w in item:
        new = [row[0] + 1]
        for j, x in enumerate(words):
            new.append(min(row[j] + (x != w), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def brute(docs, items, rate=0.2):
    out = {}
    for d, t in docs:
        words = WORD.findall(lower_ascii(t or ""))
        for i, it in items:
            item = WORD.findall(lower_ascii(it or ""))
            if item and words and (k := distance(item, words)) <= int(len(item) * rate):
                out[d, i] = k
    return out


def found(df):
    return {(r.doc_id, r.item_id): r.distance for r in df.collect()}


def planted(seed=3, n_items=25):
    rnd = random.Random(seed)
    common = ["the", "of", "and", "to"]
    words = common * 30 + [f"w{i}é" for i in range(3000)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(12, 50)))) for i in range(n_items)]
    docs = []
    for d in range(120):
        text = [rnd.choice(words) for _ in range(rnd.randint(0, 150))]
        if d % 2:
            own = items[d % n_items][1].split()
            for _ in range(rnd.randint(0, len(own) // 5)):
                k, op = rnd.randrange(len(own)), rnd.random()
                own[k : k + 1] = [] if op < 0.3 else [own[k], rnd.choice(words)] if op < 0.6 else [rnd.choice(words)]
            at = rnd.randint(0, len(text))
            text[at:at] = own
        docs.append((d, " ".join(w.upper() if d % 3 else w for w in text)))
    return docs, items


def test_recall_and_precision_on_planted_edits(spark):
    docs, items = planted()
    got = found(leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    want = brute(docs, items)
    assert set(got) <= set(want)
    assert all(got[k] >= want[k] for k in got)
    assert len(got) >= 0.95 * len(want)
    assert {k for k, v in want.items() if v == 0} <= {k for k, v in got.items() if v == 0}


def test_whole_table(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    got = found(op7_decontaminate(spark, sf_dir))
    small = [(d, t) for d, t in docs if len(t or "") < 1500][:60]
    want = brute(small, items)
    ids = {d for d, _ in small}
    assert {k for k in got if k[0] in ids} == set(want)


def test_defined_cases(spark):
    docs = [(1, None), (2, ""), (3, "alpha beta gamma delta epsilon zeta"), (None, "alpha beta gamma delta epsilon"), (3, "alpha beta gamma delta epsilon zeta"), (4, "beta gamma delta epsilon")]
    items = [(1, "Alpha beta, gamma delta epsilon"), (2, None), (3, "..."), (None, "alpha beta")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id")
    rows = sorted((r.doc_id, r.item_id, r.distance) for r in leaks(d, i).collect())
    assert rows == [(3, 1, 0), (3, 1, 0), (4, 1, 1)]
    assert leaks(d, i.limit(0)).count() == 0
    assert leaks(d.limit(0), i).count() == 0


def test_every_leak_at_the_full_rate(spark):
    rnd = random.Random(11)
    words = ["the", "of", "and", "to"] * 200 + [f"w{i}" for i in range(3000)]
    docs, items = [], []
    for n in (50, 100, 200):
        for _ in range(12):
            item = [rnd.choice(words) for _ in range(n)]
            items.append((len(items), " ".join(item)))
            own = list(item)
            for at in sorted(rnd.sample(range(n), n // 5), reverse=True):
                op = rnd.random()
                own[at : at + 1] = [] if op < 0.35 else [own[at], "added"] if op < 0.7 else ["changed"]
            text = [rnd.choice(words) for _ in range(120)]
            at = rnd.randint(0, len(text))
            docs.append((len(docs), " ".join(text[:at] + own + text[at:])))
    got = found(leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert {(d, d) for d, _ in docs} <= set(got)
    assert got == brute(docs, items)


def test_unchanged_items_of_any_size_share_a_key():
    zero = np.zeros(1, np.int64)
    for n in range(1, 60):
        item = np.random.default_rng(n).integers(1, 1 << 60, n).astype(np.uint64)
        for walk in range(WALKS):
            reads = cgk_reads(item, zero, zero + n, n, walk)
            assert shares_key(reads[:, 0], reads, n, walk).all() or n < 4
    for word in range(1, 500):
        index = Index([(1, f"word{word}")], 0.2)
        assert any(shares_key(r, r[:, None], 1, walk).all() for walk, r in enumerate(index.reads[0]))


def test_recall_of_one_walk_at_the_full_rate():
    rnd = np.random.default_rng(2)
    for n in (16, 50, 100, 200):
        missed = 0
        for _ in range(60):
            item = rnd.integers(1, 1 << 60, n).astype(np.uint64)
            own = list(item)
            for _ in range(n // 5):
                k, op = int(rnd.integers(len(own))), int(rnd.integers(3))
                own[k : k + 1] = [] if op == 0 else [own[k], rnd.integers(1, 1 << 60)] if op == 1 else [rnd.integers(1, 1 << 60)]
            text = np.concatenate([np.array(x, np.uint64) for x in (rnd.integers(1, 1 << 60, n), own, rnd.integers(1, 1 << 60, n))])
            start = np.arange(n - n // 5, n + n // 5 + 1)
            zero = np.zeros(1, np.int64)
            missed += not shares_key(cgk_reads(item, zero, zero + n, n, 0)[:, 0], cgk_reads(text, start, start + n, n, 0), n, 0).any()
        assert missed <= 0.15 * 60, (n, missed, SAMPLES)


def test_rows_are_judged_and_kept_whole(spark):
    item = "alpha beta gamma delta epsilon"
    rows = [(1, item, "a"), (1, "clean text", "b"), (None, f"x {item} y", "c"), (None, "also clean", "d"), (2, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = without_leaks(d, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted(map(str, kept)) == sorted(map(str, [r for r in d.collect() if r.lang in ("b", "d", None)]))
