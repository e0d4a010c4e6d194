"""One small fixture for each rule that is easy to get wrong, with hand-computed results."""

import json
import math

import pytest
from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.operators import cooccur, dictionary, graph, layout, similarity, vocab
from termloom.plans import network
from termloom.sources import readers, writers


def sents(spark, lists, g="g"):
    return spark.createDataFrame([(g, 0, k, x) for k, x in enumerate(lists)], "graph_id string, doc_id long, sent_id int, tokens array<string>")


def term(spark, t, g="g"):
    return spark.createDataFrame([(g, t)], "graph_id string, term string")


def edges(spark, rows):
    return spark.createDataFrame([("g", *r) for r in rows], "graph_id string, source string, target string, weight double")


def pairs(df):
    return {tuple(sorted((r.source, r.target))): r.weight for r in df.collect()}


FOUR = [["a", "b"], ["a", "b"], ["c", "d"], ["c", "d"]]


def test_vocabulary_and_restriction(spark):
    s = sents(spark, [["a", "a", "b"], ["a", "c"], ["b"]])
    v = vocab.vocabulary(s, term(spark, "z"), 2)
    assert {r.token for r in v.collect()} == {"a", "b", "z"}
    assert [r.tokens for r in vocab.restricted(s, v).collect()] == [["a", "a", "b"]]
    assert {r.token for r in vocab.vocabulary(s, term(spark, "a"), 9, ["a"]).collect()} == {"a"}


def test_sentence_of_one_repeated_token_counts(spark):
    s = sents(spark, [["a", "a"], ["a", "b"]])
    assert cooccur.sent_count(s).first().n_sents == 2
    assert {r.token: r.freq for r in cooccur.sent_freq(s).collect()} == {"a": 2, "b": 1}
    assert cooccur.pmi_scores(s).first().pmi == 0 and cooccur.pmi_edges(s).count() == 0


def test_pmi(spark):
    s = sents(spark, FOUR)
    assert pairs(cooccur.pmi_edges(s)) == {("a", "b"): pytest.approx(math.log(2)), ("c", "d"): pytest.approx(math.log(2))}
    wanted = spark.createDataFrame([("g", "a", "c"), ("g", "a", "a"), ("g", "b", "a"), ("g", "q", "a")], "graph_id string, a string, b string")
    got = {(r.a, r.b): r.pmi for r in cooccur.pmi_of(cooccur.pair_counts(s), cooccur.sent_freq(s), cooccur.sent_count(s), wanted).collect()}
    assert got == {("a", "c"): -math.inf, ("a", "a"): -math.inf, ("q", "a"): -math.inf, ("b", "a"): pytest.approx(math.log(2))}


def test_term_without_edges_leaves_the_graph_whole(spark):
    e = network.cooccurrence_network(sents(spark, FOUR), term(spark, "z"), 1, 1)
    assert set(pairs(e)) == {("a", "b"), ("c", "d")}


def test_pruning_order_and_induced_edges(spark):
    rows = [("t", "a", 0.1), ("t", "b", 0.2), ("a", "x", 9.0), ("b", "y", 1.0), ("a", "b", 5.0)]
    got = pairs(graph.pruned(edges(spark, rows), term(spark, "t"), 3))
    assert set(got) == {("a", "t"), ("b", "t"), ("a", "x"), ("a", "b")}
    assert set(pairs(graph.pruned(edges(spark, rows), term(spark, "t"), 1))) == {("b", "t")}
    wanted = spark.createDataFrame([("g", "t", n) for n in "axyq"], "graph_id string, term string, node string")
    score = {r.node: r.score for r in graph.proximity(edges(spark, rows), wanted).collect()}
    assert score == {"a": 0.1, "x": pytest.approx(0.9), "y": pytest.approx(0.2), "q": 0.0}
    assert {r.node for r in graph.ego(edges(spark, rows), term(spark, "t"), 1).collect()} == {"t", "a", "b"}


def test_cosine(spark):
    one = {(r.a, r.b): r.m for r in similarity.context_cells(sents(spark, [["a", "a", "b"]])).collect()}
    assert one == {("a", "b"): 2}
    cells = similarity.context_cells(sents(spark, [["a", "c"], ["b", "c"]]))
    assert pairs(similarity.cosine_edges(cells, 1.0)) == {("a", "b"): 1.0}
    nodes = spark.createDataFrame([("g", x) for x in "abc"], "graph_id string, id string")
    assert pairs(similarity.cosine_edges(cells, 0.0, nodes)) == {("a", "b"): 1.0, ("a", "c"): 0.0, ("b", "c"): 0.0}
    assert set(pairs(network.similarity_network(sents(spark, [["a", "c"], ["b", "c"]]), term(spark, "a"), 1, 15, 0.7))) == {("a", "b")}


def test_pooled_is_not_a_union(spark):
    docs = spark.createDataFrame([(1, "x y. " * 11), (2, "x y. " * 11)], "doc_id long, text string")
    s = vocab.sentences(docs, vocab.pooled(F.col("doc_id").cast("string"), F.lit("all")))
    terms = spark.createDataFrame([(g, "t") for g in ("1", "2", "all")], "graph_id string, term string")
    v = {(r.graph_id, r.token) for r in vocab.vocabulary(s, terms, 22).collect()}
    assert v == {("1", "t"), ("2", "t"), ("all", "t"), ("all", "x"), ("all", "y")}


def test_dictionary(spark):
    def entries(lines):
        return {r.headword: r for r in dictionary.dictionary(spark.createDataFrame(list(enumerate(lines)), "line_no int, value string")).collect()}

    four = ["仁 仁 [Ren2] /A/", "仁 仁 [ren2] /b/", "仁 仁 [ren4] /c/", "仁 仁 [Ren5] /D/"]
    assert entries(four)["仁"].definitions == ["c"] and entries([four[0], four[3]])["仁"].definitions == ["A"]
    e = entries(["知 知 [zhi1] /a/CL:x/b/also pr. [zhi4 shi4]/"])["知"]
    assert (e.definitions, e.alt_pronunciation, e.pinyin) == (["a", "b"], ["zhì", "shì"], "zhī")
    assert entries(["知 知 [lu:4 Ou1 gui3 xue2] /a/b/", "#知 知 [x] /n/"])["知"].pinyin == "lǜ Ōu guǐ xué"
    for n, more in ((9, True), (7, False)):
        d = dictionary.dictionary(spark.createDataFrame([(0, "多 多 [duo1] /" + "/".join("abcdefghi"[:n]) + "/")], "line_no int, value string"))
        row = dictionary.looked_up(spark.createDataFrame([("多",)], "id string"), d).first()
        assert len(row.definitions) == 7 and row.more is more


def test_sources(spark, tmp_path):
    hits = spark.createDataFrame([("t", k) for k in range(5)], "term string, rank int")
    assert readers.top_hits(hits, 0).count() == 5 and readers.top_hits(hits, 4).count() == 4
    (tmp_path / "c.json").write_text("\n".join(json.dumps({"ord": k, "title": t, "fulltext": f}) for k, t, f in [(2, None, ["b"]), (1, "T", [" a ", "", "　", "b"])]))
    assert [(r.title, r.text) for r in readers.chapters(spark, str(tmp_path / "c.json")).collect()] == [("T", "a\nb"), ("", "b")]
    (tmp_path / "bad.json").write_text(json.dumps({"ord": 1, "title": "T", "fulltext": []}))
    with pytest.raises(Exception, match="no paragraphs"):
        readers.chapters(spark, str(tmp_path / "bad.json")).collect()
    page = spark.createDataFrame([("u", '<h1>H</h1><div id="preamble">P</div><div class="result_url"> http://x </div>')], "url string, html string")
    a = readers.articles(page, ["#preamble", "#toc"]).first()
    assert (a.title, a.text, a.description) == ("H", "P", "P")
    assert page.select(readers.result_links(F.col("html"))).first()[0] == ["http://x"]


def test_cache(spark):
    cache = spark.sql("select 'a' as key, current_timestamp() as fetched_at, 'new' as body union all select 'a', current_timestamp() - interval 1 day, 'old' union all select 'b', current_timestamp() - interval 9 days, 'stale' union all select 'c', current_timestamp() - interval 9 days, 'stale'")
    keys = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "key string")
    got = spark.createDataFrame([("a", "f"), ("b", "f")], "key string, body string")
    assert {r.key: r.body for r in readers.cached_or_fetched(keys, cache, got).collect()} == {"a": "new", "b": "f", "c": "stale", "d": None}


def test_node_link_round_trip(spark, tmp_path):
    e = edges(spark, [("仁", "b", 1.5), ("b", "c", 0.5)])
    doc = json.loads(writers.node_link(e).first().json)
    assert list(doc) == ["directed", "multigraph", "graph", "nodes", "edges"] and doc["graph"] == {} and not doc["directed"]
    assert doc["nodes"] == [{"id": x} for x in ("b", "c", "仁")]
    writers.write_node_links(e, str(tmp_path / "out"))
    back = readers.node_links(spark, str(tmp_path / "out" / "*")).select(F.explode("edges").alias("e")).select("e.*")
    assert {(r.source, r.target, r.weight) for r in back.collect()} == {("仁", "b", 1.5), ("b", "c", 0.5)}
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text('{"directed": false, "multigraph": false, "graph": {}, "nodes": [{"id": "a"}]}')
    with pytest.raises(Exception, match="node-link"):
        readers.node_links(spark, str(tmp_path / "bad")).collect()


def test_scalars(spark):
    row = spark.createDataFrame([("https://x.org/me/a?q=1#t", "Éa, b! c d e f g", 0, "p/q.PNG")], "u string, t string, z int, f string").select(
        T.url_host(F.col("u")), T.without_query(F.col("u")), T.handle(F.col("u")), T.slug(F.col("t"), 12), T.or_default(F.col("z"), 50), T.file_extension(F.col("f")),
        T.heading(F.lit(9)), T.page_title(F.lit("A"), "S"), T.page_title(F.lit(""), "S"), T.month_year(F.lit("2024-03-05").cast("timestamp")), T.stroke_width(F.lit(None).cast("double")), T.is_cjk(F.lit("仁a")),
        T.url_host(F.lit("not a url")),
    ).first()
    assert list(row) == ["x.org", "https://x.org/me/a#t", "@me", "ea-b-c-d-e-f", 50, ".PNG", "h6", "A – S", "S", "Mar 2024", pytest.approx(0.4), False, None]


def test_tagged_tokens_and_layout(spark):
    tags = spark.sql("select array(named_struct('lemma','Virtue','pos','NOUN','is_stop',false,'is_alpha',true), named_struct('lemma','be','pos','VERB','is_stop',true,'is_alpha',true), named_struct('lemma','of','pos','ADP','is_stop',false,'is_alpha',true)) as t")
    assert tags.select(T.content_tokens(F.col("t"))).first()[0] == ["virtue"]
    at = {r.id: r for r in layout.layout(edges(spark, [("t", "a", 1.0), ("t", "b", 1.0)]), term(spark, "t")).collect()}
    assert (at["t"].x, at["t"].y, at["t"].pinned) == (50, 50, True) and not at["a"].pinned
    assert math.dist((at["a"].x, at["a"].y), (at["b"].x, at["b"].y)) > 5
    p = graph.endpoints(edges(spark, [("t", "a", 1.0), ("t", "gone", 1.0)]), layout.layout(edges(spark, [("t", "a", 1.0)]), term(spark, "t")))
    assert p.count() == 1


def test_icons(spark):
    from termloom.operators import icons

    entries = [("site", "https://x.org/a"), ("mail", "mailto:")]
    rows = spark.createDataFrame([("https://x.org/b",), ("mailto:me@y.org",), ("https://z.org",), ("none",), (None,)], "u string")
    named = lambda e: spark.createDataFrame(e, "name string, url string")
    assert [r.icon for r in icons.matched(rows, "u", named(entries)).orderBy(F.col("u").desc_nulls_last()).collect()] == [None, "mail", None, "site", None]
    for bad in (("other", "http://x.org/"), ("none", "no url")):
        with pytest.raises(Exception, match="bad or duplicate"):
            icons.matched(rows, "u", named([*entries, bad])).collect()


def test_requests(spark, tmp_path):
    from termloom.sources import fetch

    for k in range(3):
        (tmp_path / f"{k}.txt").write_text(f"仁{k}")
    got = fetch.fetched(spark, [f"file://{tmp_path}/{k}.txt" for k in (2, 0, 1)], pause=False)
    assert [(r.ord, r.body) for r in got.orderBy("ord").collect()] == [(0, "仁2"), (1, "仁0"), (2, "仁1")]
    assert fetch.with_query("https://x.org/f?old=1#t", {"q": "a b", "n": "é"}) == "https://x.org/f?q=a+b&n=%C3%A9"
    assert fetch.exists(f"{tmp_path}/0.txt") and not fetch.exists(f"{tmp_path}/none")
    import hashlib

    assert [(r.length, r.md5) for r in readers.files(spark, str(tmp_path), "0.txt").collect()] == [(4, hashlib.md5("仁0".encode()).hexdigest())]


def test_small_scalars(spark):
    row = spark.range(1).select(
        T.without_prefix(F.lit("https://assets.example/12-ab/https://y.org/i.png"), "https://assets.example/[a-f0-9-]*/"), T.without_prefix(F.lit("i.png"), "https://assets.example/"),
        T.looked_up(F.lit("a"), F.create_map(F.lit("a"), F.lit("A"))), T.looked_up(F.lit("b"), F.create_map(F.lit("a"), F.lit("A"))),
        T.image_options(F.lit("cover"), F.lit(0), F.lit(None).cast("int")), T.image_options(F.lit("odd"), F.lit(None).cast("int"), F.lit(None).cast("int")),
        T.has_rich_text(F.lit('{"children":[1,2]}')), T.has_rich_text(F.lit('{"children":[]}')), T.has_rich_text(F.lit("broken")), T.file_kind(F.lit("a/b.pdf")), T.file_kind(F.lit("a/b")), T.file_kind(F.lit("c.zip")),
    ).first()
    assert list(row) == ["https://y.org/i.png", "i.png", "A", "b", ("cover", [50, 50]), (None, None), True, False, False, "pdf", "link", "file"]


def test_blocked_product_equals_the_plain_one(spark, monkeypatch):
    import random

    monkeypatch.setattr(similarity, "BLOCK_CELLS", 30)
    monkeypatch.setattr(similarity, "STRIP", 4)
    rnd = random.Random(4)
    words = [f"w{k}" for k in range(25)]
    s = sents(spark, [rnd.choices(words, k=rnd.randint(2, 7)) for _ in range(80)])
    cells = similarity.context_cells(s)
    m = {}
    for r in cells.collect():
        m.setdefault(r.a, {})[r.b] = r.m
        m.setdefault(r.b, {})[r.a] = r.m
    norm = {a: math.sqrt(sum(x * x for x in v.values())) for a, v in m.items()}
    want = {(a, b): sum(x * m[b].get(c, 0) for c, x in m[a].items()) / norm[a] / norm[b] for a in m for b in m if a < b}
    want = {k: pytest.approx(v) for k, v in want.items() if v >= 0.3}
    assert want and pairs(similarity.cosine_edges(cells, 0.3)) == want
    nodes = spark.createDataFrame([("g", words[0])], "graph_id string, id string")
    assert pairs(similarity.CosineGraph(cells, 0.3).at(nodes)) == {k: v for k, v in want.items() if words[0] in k}


def test_classical_sentences_and_characters(spark):
    docs = spark.createDataFrame([(1, "仁者，人也。親親為大！"), (2, "a義b。!"), (3, "none")], "doc_id int, text string")
    s = vocab.sentences(docs, F.lit("zh"), split=T.classical_sentences, tokens=T.classical_tokens)
    assert sorted((r.doc_id, r.sent_id, "".join(r.tokens)) for r in s.collect()) == [(1, 0, "仁者人也"), (1, 1, "親親為大"), (2, 0, "義")]
    words = spark.createDataFrame([("仁義",), ("a仁",), ("",), ("𠀀",)], "s string").select(T.is_cjk(F.col("s"))).collect()
    assert [r[0] for r in words] == [True, False, False, False]


def test_network_of_all_batches(spark, tmp_path):
    """Each micro-batch's network is that of all sentences gathered; a batch that runs again counts once."""
    from termloom.streaming import counts

    out = []
    on_batch = counts.network_per_batch(term(spark, "a"), 2, 15, str(tmp_path / "gathered"), lambda net, epoch: out.append(pairs(net)))
    one, two = sents(spark, [["a", "b"], ["c", "d"]]), sents(spark, [["a", "b"], ["c", "d"], ["a", "c"]])
    on_batch(one, 0)
    on_batch(two, 1)
    on_batch(two, 1)
    assert out[0] == {} and ("a", "b") in out[1] and out[1] == out[2]
