import math
from collections import Counter

from termloom.llm.lm_score import BACKOFF, MIN_COUNT, ORDER, op1_lm_score, scores
from tests.llm.brute import SPACE_WORD, lower_ascii


def brute(texts):
    docs = [SPACE_WORD.findall(lower_ascii(t or "")) for t in texts]
    count = Counter(tuple(w[i : i + n]) for w in docs for n in range(1, ORDER + 1) for i in range(len(w) - n + 1))
    total = sum(map(len, docs))
    out = []
    for w in docs:
        s, backed = 0.0, 0
        for i in range(len(w)):
            top = min(i + 1, ORDER)
            for n in range(top, 0, -1):
                g = tuple(w[i - n + 1 : i + 1])
                if count[g] >= (MIN_COUNT if n > 1 else 1):
                    s += math.log10(count[g] / (count[g[:-1]] if n > 1 else total) * BACKOFF ** (top - n))
                    backed += n < top
                    break
        out.append((len(w), backed, s))
    return out


def check(out, rows):
    want = sorted((d if d is not None else -1, *x) for (d, _), x in zip(rows, brute([t for _, t in rows]), strict=True))
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_backed_off, r.log10_sum) for r in out)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:3] == w[:3] and abs(g[3] - w[3]) <= 1e-4 * max(1, abs(w[3]))
    assert all((r.score is None) == (r.n_words == 0) for r in out)


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check(op1_lm_score(spark, sf_dir).collect(), rows)


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, "one"), (None, "a b c a b c"), (None, "a b c a b c"), (4, "A B c d"), (4, "A B c d"), (5, "x " * 30_000)]
    check(scores(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as block", "2 as score")).collect(), rows)
    assert scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
