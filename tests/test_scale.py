"""Steps whose work must not grow faster than the input: results against brute force, and what their plans send."""

import math
import random
from collections import Counter
from itertools import combinations
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from termloom.functions import adapters
from termloom.operators import cooccur, graph, packed, similarity, vocab
from termloom.plans import catalogue


def random_sents(spark, graphs=("g", "h"), n=120, seed=3):
    rnd = random.Random(seed)
    rows = [(g, k, 0, rnd.choices("abcdefghijklmnop", k=rnd.randint(2, 6))) for g in graphs for k in range(n)]
    return spark.createDataFrame(rows, "graph_id string, doc_id long, sent_id int, tokens array<string>").repartition(3), rows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def brute_edges(rows):
    """Edges of positive PMI of each graph, both ways."""
    n, freq, cooc = Counter(), Counter(), Counter()
    for g, _, _, tokens in rows:
        n[g] += 1
        freq.update((g, t) for t in set(tokens))
        cooc.update((g, *p) for p in combinations(sorted(set(tokens)), 2))
    e = {}
    for (g, a, b), c in cooc.items():
        if c * n[g] > freq[g, a] * freq[g, b]:
            e[g, a, b] = e[g, b, a] = math.log(c * n[g] / (freq[g, a] * freq[g, b]))
    return e, cooc


def test_pairs_travel_packed(spark, monkeypatch):
    monkeypatch.setattr(packed, "BLOCK_PAIRS", 50)
    s, rows = random_sents(spark)
    got = cooccur.pair_counts(s)
    e, cooc = brute_edges(rows)
    assert {(r.graph_id, r.a, r.b): r.cooc for r in got.collect()} == cooc
    assert {(r.graph_id, r.source, r.target): pytest.approx(r.weight) for r in cooccur.pmi_edges(s).collect()} == {k: v for k, v in e.items() if k[1] < k[2]}
    assert len(packed.Words.of_sentences(s).blocks()) > 10
    for df in (got, cooccur.pmi_scores(s)):
        assert "hashpartitioning(block" in plan(df) and "Exchange hashpartitioning(graph_id" not in plan(df)


def test_neighbourhoods_without_the_whole_graph(spark, monkeypatch):
    """Two terms in one graph and one in another; the same as from the listed edges, which aren't made."""
    s, rows = random_sents(spark)
    terms = spark.createDataFrame([("g", "a"), ("g", "b"), ("h", "c"), ("h", "none")], "graph_id string, term string")
    e, _ = brute_edges(rows)
    one = {(g, t, n): w for g, t in [("g", "a"), ("g", "b"), ("h", "c")] for (x, m, n), w in e.items() if (x, m) == (g, t)}
    two = {}
    for (g, t, m), w in one.items():
        for (x, k, n), w2 in e.items():
            if (x, k) == (g, m) and n != t and (g, t, n) not in one:
                two[g, t, n] = max(two.get((g, t, n), 0), w * w2)
    assert two
    monkeypatch.setattr(cooccur, "pair_stats", None)  # what lists all edges
    pmi = cooccur.PmiGraph(s)
    near = lambda df: {(r.graph_id, r.term, r.node): pytest.approx(r.score) for r in df.collect()}
    assert near(graph.two_hop(pmi, terms)) == two
    assert near(graph.ranked(pmi, terms)) == one | two
    assert {(r.graph_id, r.term, r.node) for r in graph.within_two(pmi, terms).collect()} == {*one, *two, *((g, t, t) for g, t, _ in one)}
    wanted = terms.select("graph_id", "term", F.explode(F.array(*(F.lit(x) for x in "abcz"))).alias("node"))
    assert near(graph.proximity(pmi, wanted)) == {(g, t, n): (one | two).get((g, t, n), 0) for g, t in [("g", "a"), ("g", "b"), ("h", "c"), ("h", "none")] for n in "abcz"}
    first = {(r.graph_id, r.node): r.rank for r in graph.first_neighbours(pmi, terms.where("term in ('a', 'c')"), 3).collect()}
    order = sorted(((-w, n) for (g, t, n), w in one.items() if (g, t) == ("g", "a")))[:3]
    assert {n: k for (g, n), k in first.items() if g == "g"} == {n: k for k, (_, n) in enumerate(order, 1)}


@pytest.mark.parametrize("name", ["one_hop_topk", "two_hop_scores", "ego_graph", "proximity", "pmi_lookup"])
def test_query_of_a_few_nodes_makes_no_whole_graph(spark, sf_dir, monkeypatch, name):
    def whole(*_):
        raise AssertionError("all pairs are made")

    for f in ("pair_counts", "pair_stats", "pmi_edges"):
        monkeypatch.setattr(cooccur, f, whole)
    assert catalogue.QUERIES[name](spark, sf_dir).count()


@pytest.mark.parametrize("looked_up", [0, 60])
def test_cosines_read_blocks_and_deal_out_none(spark, monkeypatch, looked_up):
    """Two graphs, many blocks and strips, with the rest of each pair looked up (0) or not; pairs with occurrences."""
    for name, value in (("BLOCK_CELLS", 60), ("BLOCK_ROWS", 4), ("STRIP", 3), ("LOOKED_UP", looked_up)):
        monkeypatch.setattr(similarity, name, value)
    plans = {}

    def staged(df, label, put=similarity.staged):
        plans[label] = plan(df)
        return put(df, label)

    monkeypatch.setattr(similarity, "staged", staged)
    s, rows = random_sents(spark, n=40)
    m = {}
    for g, _, _, tokens in rows:
        n = Counter(tokens)
        for a in n:
            for b in n:
                if a != b:
                    m.setdefault((g, a), Counter())[b] += n[a] * n[b]
    norm = {k: math.sqrt(sum(x * x for x in v.values())) for k, v in m.items()}
    want = {(g, a, b): sum(x * m[g, b][c] for c, x in m[g, a].items()) / norm[g, a] / norm[g, b] for g, a in m for h, b in m if g == h and a < b}
    want = {k: pytest.approx(v) for k, v in want.items() if v >= 0.7}
    found = lambda df: {(r.graph_id, r.source, r.target): r.weight for r in df.collect()}
    cells = similarity.context_cells(s)
    assert {(r.graph_id, r.a, r.b): r.m for r in cells.collect()} == {(g, a, b): x for (g, a), v in m.items() for b, x in v.items() if a < b}
    assert want and found(similarity.cosine_edges(cells, 0.7)) == want
    graph_ = similarity.CosineGraph(similarity.context_matrix(s), 0.7)
    assert found(similarity.cosine_edges(graph_.matrix, 0.7)) == want
    assert graph_.matrix.blocks.count() > 8
    assert "CartesianProduct" in plans["cosines"] and "Exchange" not in plans["cosines"]
    some = spark.createDataFrame([("g", "a"), ("g", "b"), ("h", "c"), ("h", "none")], "graph_id string, id string")
    ends = {("g", "a"), ("g", "b"), ("h", "c")}
    assert found(graph_.at(some)) == {k: v for k, v in want.items() if {(k[0], k[1]), (k[0], k[2])} & ends}
    assert found(graph_.among(some)) == {k: v for k, v in want.items() if {(k[0], k[1]), (k[0], k[2])} <= ends}
    assert found(graph_.whole(spark.createDataFrame([("h",)], "graph_id string"))) == {k: v for k, v in want.items() if k[0] == "h"}


def test_vectors_are_multiplied_in_blocks(spark):
    """Slices and batches of a few rows; nulls, zeros and another length have no cosine. No vector is copied to each batch."""
    rnd = random.Random(5)
    rows = [(k, [rnd.gauss(0, 1) for _ in range(4)]) for k in range(60)] + [(90, [0.0] * 4), (91, None), (92, [1.0, None, 1.0, 1.0]), (93, [1.0] * 3), (None, [1.0] * 4)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(2)
    whole = {k: x for k, x in v.collect() if k is not None and x and None not in x and any(x)}
    norm = {k: math.sqrt(sum(a * a for a in x)) for k, x in whole.items()}
    want = {(q, k): sum(a * b for a, b in zip(whole[q], x, strict=True)) / norm[q] / norm[k] for q in whole if q % 3 == 0 for k, x in whole.items() if q != k and len(x) == len(whole[q])}
    got = similarity.vector_cosine_edges(v, 0.2, v.where("vec_id % 3 = 0"), slice_rows=7, batch=3)
    assert {(r.source, r.target): r.weight for r in got.collect()} == {k: pytest.approx(w) for k, w in want.items() if w >= 0.2}
    assert "CartesianProduct" in plan(got) and "Exchange" not in plan(got)


def test_tagged_words_are_held_for_a_part_of_a_batch(spark):
    """A batch of 10,000 texts never has all its words at hand at once; order, nulls and long texts stay."""

    def load():
        alive = [0]

        class Word(str):
            def __new__(cls, x):
                alive[0] += 1
                if alive[0] > 300_000:
                    raise MemoryError("all words of the batch are held")
                return super().__new__(cls, x)

            def __del__(self):
                alive[0] -= 1

        return lambda text: [[(Word(w), "NOUN", False, True) for w in text.split()]]

    text = F.when(F.col("id") % 1000 == 3, None).when(F.col("id") == 7, F.repeat(F.lit("w "), 150_000)).otherwise(F.concat(F.repeat(F.lit("w "), 99), F.col("id").cast("string")))
    t = adapters.tagged(spark.range(0, 10_000, 1, 1).select("id", text.alias("text")), load)
    first = F.get("tagged", F.lit(0))
    got = {r.id: (r.n, r.last, r.words) for r in t.select("id", F.size("tagged").alias("n"), F.try_element_at(first, F.lit(-1))["lemma"].alias("last"), F.size(first).alias("words")).collect()}
    assert got == {k: (0, None, got[k][2]) if k % 1000 == 3 else (1, "w", 150_000) if k == 7 else (1, str(k), 100) for k in range(10_000)}


def test_stream_keeps_no_state_of_all_pairs(spark, tmp_path):
    """Counts of two micro-batches and of none; the checkpoint has no state."""
    from termloom.storage import shared_dir
    from termloom.streaming import counts

    s, rows = random_sents(spark)
    half = F.col("doc_id") % 2 == 0
    for k, part in enumerate((s.where(half), s.where(~half))):
        part.coalesce(1).write.parquet(f"{tmp_path}/{k}")
    folder = Path(shared_dir(spark).removeprefix("file://"), "termloom")
    before = set(folder.glob("stream-*"))
    stream = lambda n: spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{n}")
    got = counts.final_counts(stream("[01]"))
    assert {(r.graph_id, r.a, r.b): r.cooc for r in got.collect()} == brute_edges(rows)[1]
    (tmp_path / "none").mkdir()
    assert counts.final_counts(stream("none")).count() == 0
    made = set(folder.glob("stream-*")) - before
    assert made and not [p for d in made for p in d.rglob("state/*")]


def test_restricted_sentences_never_leave_their_task(spark, monkeypatch):
    """Arrays of graphs, a token of one graph only, empty rows; rows that share a key are one sentence, though one token each."""
    plans = {}

    def staged(df, label, put=vocab.staged):
        plans.setdefault(label, plan(df))
        return put(df, label)

    monkeypatch.setattr(vocab, "staged", staged)
    words = spark.createDataFrame([("g", "a"), ("g", "b"), ("h", "a"), ("h", "c")], "graph_id string, token string")
    rows = [(["g", "h"], 1, 0, ["a", "x", "b", "a", "c"]), (["g"], 1, 1, ["x"]), (["h", "none"], 2, 0, ["c", "c"]), (["g"], 2, 1, []), (["g"], None, 0, ["b", "a"])]
    sents = lambda r: spark.createDataFrame(r, "graph_id array<string>, doc_id long, sent_id int, tokens array<string>").coalesce(1)
    got = lambda s: sorted((r.graph_id, r.doc_id or 0, r.sent_id, "".join(r.tokens)) for r in vocab.restricted(s, words).collect())
    want = [("g", 0, 0, "ba"), ("g", 1, 0, "aba"), ("h", 1, 0, "aac"), ("h", 2, 0, "cc")]
    assert got(sents(rows)) == want == got(vocab.each_graph(sents(rows)))
    assert "MapInArrow" in plans["kept"] and "Exchange" not in plans["kept"]
    assert {(r.graph_id, r.token): r.freq for r in vocab.token_freq(sents(rows)).collect()}["h", "c"] == 3
    # the document is met again, without and with a key of its own
    assert got(sents([*rows, (["g"], 1, 5, ["a", "b"])])) == sorted([*want, ("g", 1, 5, "ab")])
    assert got(sents([*rows, (["g"], 1, 1, ["x", "a"]), (["g"], 2, 9, ["a"]), (["g"], 1, 1, ["b"])])) == sorted([*want, ("g", 1, 1, "ba")])
