import re

import duckdb

from termloom.llm.quality import OP8_SQL, judged, op8_quality_rules
from tests.llm.brute import SPACE_WORD


def base(text):
    text = text or ""
    w = SPACE_WORD.findall(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    seen = {}
    for x in windows:
        seen[x] = seen.get(x, 0) + 1
    covered = {j for i, x in enumerate(windows) if seen[x] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if SPACE_WORD.search(x)]
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_base_columns_and_defined_cases(spark):
    run = " ".join(f"w{i}" for i in range(12))
    texts = [None, "", " \t\n", "one", run, f"{run} {run}", f"{run} x {run} {run}\n\n a \n a \n\x0b\n", "a a a a a a a a a a", "é😀 # $% x y  z " * 9, " " + run * 3 + "\n" + run, "tok " * 30_000]
    rows = [(i, t, None if i % 3 else "en", "s" if i % 2 else None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:2], "doc_id long, text string, lang string, source string").selectExpr("*", "1 as n_words", "'k' as kept")
    out = judged(df.drop("n_words", "kept"), ["doc_id"]).collect()
    assert len(out) == len(rows) + 2
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(texts[r.doc_id])
        assert not (r.base_failed and r.kept)
    assert judged(df.limit(0).drop("n_words", "kept"), ["doc_id"]).count() == 0


def test_whole_table_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = con.sql(OP8_SQL)
    got = op8_quality_rules(spark, sf_dir).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_thresholds_follow_the_source(spark):
    plain = " ".join(f"word{i}" for i in range(60))
    coded = " ".join(f"v{i} %" for i in range(60))
    rows = [(i, f"{plain} {i}", "en", "prose") for i in range(100)] + [(100 + i, f"{coded} {i}", "en", "code") for i in range(100)] + [(200, coded, "en", "prose")]
    out = {r.doc_id: r.kept for r in judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), ["doc_id"]).collect()}
    assert all(out[i] for i in range(200)) and not out[200]


def test_limits_differ_between_groups_and_decide(spark):
    """Every ratio's limit follows its group: the same repeats, lines and capitals pass in one source only."""
    word = lambda k: f"{chr(97 + k % 23)}{chr(97 + k % 19)}{chr(97 + k % 17)}{k}".rstrip("0123456789") + chr(97 + k % 7)
    plain = lambda k: " ".join(word(k * 61 + j) for j in range(60))
    lined = lambda k: "\n".join(["same line"] * 3 + [plain(k)])
    upper = lambda k: " ".join(w.upper() if j % 3 == 0 else w for j, w in enumerate(plain(k).split()))
    rows = [(i, plain(i), "en", "prose") for i in range(300)]
    rows += [(1000 + i, lined(i), "en", "lists") for i in range(300)] + [(2000 + i, upper(i), "en", "titles") for i in range(300)]
    rows += [(3000, lined(7), "en", "prose"), (3001, upper(7), "en", "prose"), (3002, upper(9), "en", "lists")]
    out = {r.doc_id: r.kept for r in judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), ["doc_id"]).collect()}
    assert sum(out[i] for i in out if i < 3000) > 0.98 * 900
    assert not any(out[i] for i in (3000, 3001, 3002))
