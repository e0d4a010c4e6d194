import random

import pytest

from termloom.llm import common
from termloom.llm.near_dedup import near_duplicates, op6_near_dedup
from tests.llm import brute


def check(out, rows):
    want = brute.near(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in out}
    assert got == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check(op6_near_dedup(spark, sf_dir).collect(), rows)


def test_edits_and_edge_cases(spark):
    rnd = random.Random(5)
    words = [f"W{i}é" for i in range(400)]
    rows, n = [(0, None), (1, ""), (2, " \n\t"), (3, "One two"), (4, "one  TWO"), (5, "one two three")], 10
    for _ in range(12):
        base = [rnd.choice(words) for _ in range(rnd.randint(5, 120))]
        for k in range(6):
            copy = list(base)
            for _ in range(k * len(copy) // 60):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            rows.append((n, " ".join(copy)))
            n += 1
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' as n_shingles", "1 as component_id")
    check(near_duplicates(df).collect(), rows)


def test_null_ids_repeats_and_empty(spark):
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (9, "A B c d e f")]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.component_id, r.kept) for r in out) == [(-1, None, True), (7, 7, True), (7, 7, True), (9, 7, False)]
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("hot", [60])
def test_one_large_group(spark, hot):
    base = [f"w{i}" for i in range(200)]
    rows = []
    for d in range(hot):
        copy = list(base)
        copy[(d * 7) % 200] = f"x{d}"
        copy[(d * 13 + 50) % 200] = f"y{d}"
        rows.append((d, " ".join(copy)))
    check(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_one_id_with_different_texts(spark):
    """Such rows are one document, with the set of most shingles, whatever their order."""
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(1, a), (1, f"{b} x y z"), (2, a), (3, f"{b} x y z"), (4, f"{b} x y"), (1, None)]
    for order in (rows, rows[::-1]):
        out = near_duplicates(spark.createDataFrame(order, "doc_id long, text string")).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == [(1, 0, 1), (1, 36, 1), (1, 39, 1), (2, 36, 2), (3, 39, 1), (4, 38, 1)]


def test_union_find_takes_two_exchanges_a_round(spark, monkeypatch):
    """Components of chains, stars, cycles and loose pairs, some edges repeated or turned, and what a round costs."""
    exchanges, staged = [], common.staged

    def counted(df, label):
        exchanges.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return staged(df, label)

    monkeypatch.setattr(common, "staged", counted)
    rnd = random.Random(9)
    ids = rnd.sample(range(-(10**12), 10**12), 700)
    edges = list(zip(ids[:100], ids[1:100])) + [(ids[100], x) for x in ids[101:300]] + list(zip(ids[300:340], [*ids[301:340], ids[300]]))
    edges += [tuple(rnd.sample(ids[340:], 2)) for _ in range(150)] + [(ids[0], ids[0]), (ids[699], ids[699])]
    edges += [e[::-1] for e in edges[::3]] + edges[::5]
    rnd.shuffle(edges)
    least = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(200):
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    out = common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(out) == len(least) and {r.node: r.component for r in out} == least
    assert exchanges and max(exchanges) <= 2
    assert common.connected_components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0
