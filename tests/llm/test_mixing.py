from collections import defaultdict

import numpy as np

from termloom.llm.mixing import NEWTON_STEPS, RIDGE, mixed, moments, op5_mixing, rates
from tests.llm.brute import SPACE_WORD


def brute_targets(sizes):
    """{source: target}; sizes by source."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        above = {s for s in open_ if left * weight[s] / total >= 2 * sizes[s]}
        if not above:
            return out | {s: left * weight[s] / total for s in open_}
        out |= {s: 2.0 * sizes[s] for s in above}
        left -= sum(out[s] for s in above)
        open_ -= above
    return out


def check(rows, out):
    size, taken, target = defaultdict(int), defaultdict(int), {}
    source = dict(rows["source"])
    for d, t in rows["text"]:
        size[source[d]] += len(SPACE_WORD.findall(t or ""))
    want = brute_targets(size)
    assert len(out) == len(rows["text"])
    texts = dict(rows["text"])
    least = defaultdict(lambda: 10**9)
    for r in out:
        s = source[r.doc_id]
        assert r.size == len(SPACE_WORD.findall(texts[r.doc_id] or "")) and r.source_size == size[s]
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
        target[s] = r.target
        least[s] = min(least[s], r.size or 10**9)
    for s in size:
        assert abs(target[s] - want[s]) <= 1e-6 * max(1, want[s])
        assert abs(taken[s] - want[s]) <= max(0.02 * want[s], 40), (s, taken[s], want[s])


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_whole_table_and_reruns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()
    a, b = op5_mixing(spark, sf_dir).collect(), op5_mixing(spark, sf_dir).collect()
    check({"text": [(r.doc_id, r.text) for r in docs], "source": [(r.doc_id, r.source) for r in docs]}, a)
    assert sorted(a) == sorted(b)


def test_hot_source_null_and_empty(spark):
    rows = [(i, "w " * (i % 37), "hot" if i % 3 else None) for i in range(600)] + [(1000 + i, "same words here", "hot") for i in range(500)] + [(5000, None, "z"), (5001, "", "y"), (5002, "a " * 50_000, "x")]
    df = table(spark, rows).selectExpr("*", "1 as size", "2.0 as target", "3 as n")
    out = mixed(df).collect()
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(SPACE_WORD.findall(t or ""))
    want, taken = brute_targets(size), defaultdict(int)
    src = {d: s for d, _, s in rows}
    for r in out:
        assert r.taken <= 2 * r.size and abs(r.target - want[src[r.doc_id]]) < 1e-6
        taken[src[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] + 5 for s in ("hot", None))
    assert mixed(df.limit(0)).count() == 0


def test_dual_against_a_plain_solver():
    """Newton's mu equals that of alternating exact updates; sources hold their targets at every mu."""
    rnd = np.random.default_rng(3)
    words = rnd.integers(0, 1000, (12, 4)).astype(float)
    words[:, 0] += 1
    target = words.sum(axis=1) * rnd.uniform(0.3, 1.9, 12)
    full = np.zeros(12, bool)
    full[3], target[3] = True, 2 * words[3].sum()
    budget, goal = target.sum(), target.sum() * words.sum(axis=0) / words.sum()
    mu = np.zeros(4)
    for _ in range(NEWTON_STEPS):
        taken, hessian = moments(words, target, full, mu)
        gradient = taken - goal + RIDGE * budget * mu
        mu = mu - np.clip(np.linalg.solve(hessian + RIDGE * budget * np.eye(4), gradient), -1, 1)
    plain = np.zeros(4)
    for _ in range(20_000):
        taken = (words * rates(words, target, full, plain)).sum(axis=0)
        plain -= 0.2 * (taken - goal + RIDGE * budget * plain) / budget
    assert np.abs(mu - plain).max() < 1e-6 and np.abs(mu).max() > 0.01
    r = rates(words, target, full, mu)
    assert np.allclose((words * r).sum(axis=1), target) and r.max() <= 2
    off = lambda m: np.abs((words * rates(words, target, full, m)).sum(axis=0) - goal).sum()
    assert off(mu) < 0.5 * off(np.zeros(4))


def test_languages_and_missing_column(spark):
    rows = [(i, "w " * (1 + i % 9), f"s{i % 4}", ["en", "de", None][i % 3 if i % 4 else 0]) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    out, plain = mixed(df).collect(), mixed(df.drop("lang")).collect()
    lang = {d: x for d, _, _, x in rows}
    size, share = defaultdict(int), {True: defaultdict(int), False: defaultdict(int)}
    for d, t, *_ in rows:
        size[lang[d]] += len(t.split())
    for with_lang, res in ((True, out), (False, plain)):
        for r in res:
            share[with_lang][lang[r.doc_id]] += r.taken
    off = {k: sum(abs(v[x] / sum(v.values()) - size[x] / sum(size.values())) for x in size) for k, v in share.items()}
    assert off[True] < 0.6 * off[False]
    for res in (out, plain):
        taken, target = defaultdict(int), {}
        for r in res:
            taken[r.source_size, r.target] += r.taken
        assert all(abs(v - t) <= 0.02 * t for (_, t), v in taken.items())
