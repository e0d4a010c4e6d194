from collections import defaultdict

import corpus_pipeline
from termloom.llm.common import staged
from tests.llm import brute
from tests.llm.test_decontaminate import brute as brute_leaks
from tests.llm.test_mixing import brute_targets
from tests.llm.test_quality import base


def test_stages_and_their_decisions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, after = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
        after.append({r.doc_id: r for r in docs.collect()})
        if name != "mix":
            assert docs.columns == columns
        assert after[-1] and docs.count() == len(after[-1])
    quality, lines, near, clean, mix = after
    assert all(not base(r.text)[-1] for r in quality.values())
    assert set(lines) <= set(quality) and all(len(r.text) == r.n_chars <= len(quality[d].text) for d, r in lines.items())
    groups = defaultdict(set)
    for d, (_, c) in brute.near([(d, r.text) for d, r in lines.items()]).items():
        groups[c].add(d)
    assert set(near) == {min(g) for g in groups.values()}
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    small = {d: r.text for d, r in near.items() if len(r.text) < 1200}
    assert set(small) - set(clean) == {d for d, _ in brute_leaks(small.items(), items)}
    size, taken = defaultdict(int), defaultdict(int)
    for r in clean.values():
        size[r.source] += len(brute.SPACE_WORD.findall(r.text))
    for r in mix.values():
        taken[r.source] += r.taken
        assert 0 < r.taken == r.copies * r.size <= 2 * r.size
    want = brute_targets(size)
    assert all(abs(taken[s] - want[s]) <= max(0.1 * want[s], 40) for s in size)


def test_rows_without_words_or_ids(spark, sf_dir):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text, None, None, 5), (1, text, "en", "s", 5), (1, text, "en", "s", 5), (2, text + " x", None, "s", None), (3, None, "en", "s", 0), (4, "", "en", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
        seen.append(sorted(r.doc_id or -1 for r in docs.collect()))
    assert seen[:4] == [[-1, 1, 1, 2], [-1, 1, 1, 2], [-1, 1], [-1, 1]]
    plan = corpus_pipeline.mixing.mixed(spark.createDataFrame([r for r in rows if r[0] in (None, 1)][:2], "doc_id long, text string, lang string, source string, n_chars long")).where("copies > 0")
    assert seen[4] == sorted(r.doc_id or -1 for r in plan.collect())
    empty = docs.sparkSession.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        empty = staged(stage(spark, empty, sf_dir), name)
    assert empty.count() == 0


def test_mix_keeps_rows_without_ids_and_repeated_ids(spark, sf_dir):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text, "en", "s", 5), (None, text + " y", None, "s", 6), (1, text + " x", "en", "s", 7), (7, "a b c", "en", "t", 8), (7, "a b c", "fr", "t", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.mix(spark, docs, sf_dir).collect()
    plan = corpus_pipeline.mixing.mixed(docs).where("copies > 0").collect()
    key = lambda r: (r.doc_id or -1, r.size, r.copies, r.taken)
    assert sorted(map(key, out)) == sorted(map(key, plan))
    got = [tuple(r[c] for c in docs.columns) for r in out]
    assert len(got) == len(set(got)) and set(got) <= set(rows)
    assert sum(r.doc_id is None for r in out) >= 1 and all(r.size == len(r.text.split()) for r in out)


def test_leaks_in_rows_without_ids_go(spark):
    items = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    rows = [(None, f"before {items[0]} after", "en", "s", 5), (None, "nothing of the kind", "en", "s", 6), (1, items[1], "en", "s", 7), (1, "clean", "en", "s", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.n_chars for r in corpus_pipeline.decontamination(spark, docs, "/root/testdata/sf0.001").collect()) == [6, 8]
