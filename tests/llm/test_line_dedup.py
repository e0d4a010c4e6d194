import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from termloom.llm import line_dedup
from termloom.llm.line_dedup import components, op9_line_dedup, without_recurring
from tests.llm.brute import SPACE_WORD


def brute(rows, min_docs=3):
    """{doc_id: text} after line dedup, for distinct doc_ids."""

    def form(line):
        return tuple("<*>" if re.search("[0-9]", w) else w for w in SPACE_WORD.findall(line))

    docs_of = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if form(line):
                docs_of[form(line)].add(d)
    first = {f: min(ds) for f, ds in docs_of.items() if len(ds) >= min_docs}
    leaves = defaultdict(list)
    for f in docs_of:
        if len(f) >= 6:
            leaves[len(f), f[:3]].append(f)
    for fs in leaves.values():
        todo = sorted(fs)
        while todo:
            group, todo = [todo[0]], todo[1:]
            for f in group:
                near = [g for g in todo if 100 * sum(x == y for x, y in zip(f, g)) >= 80 * len(f)]
                group += near
                todo = [g for g in todo if g not in near]
            ds = set().union(*(docs_of[f] for f in group))
            if len(ds) >= min_docs and len(group) > 1:
                for f in group:
                    first[f] = min(first.get(f, min(ds)), min(ds))
    return {d: None if t is None else "\n".join(x for x in t.split("\n") if not (form(x) in first and d > first[form(x)])) for d, t in rows}


def test_against_brute_force(spark):
    rnd = random.Random(4)
    words = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    fixed = [" ".join(rnd.choice(words) for _ in range(k)) for k in (1, 2, 4, 9, 12, 60)]
    rows = []
    for d in range(80):
        lines = [" ".join(rnd.choice(words) for _ in range(rnd.randint(5, 15))) for _ in range(rnd.randint(0, 5))]
        lines += rnd.sample(fixed, rnd.randint(0, 3))
        if d % 4 == 0:
            lines.append(f"Posted on day {d} by user number one")
        if d % 5 == 0:
            lines.append(f"Read more from our {rnd.choice(['old', 'new', 'old', 'old'])} friends and partners over there today")
        rnd.shuffle(lines)
        rows.append((d, "\n".join(lines) + ("\n" if d % 7 == 0 else "") + ("\n \n" if d % 11 == 0 else "")))
    rows += [(100, None), (101, ""), (102, "\n\n")]
    want = brute(rows)
    out = without_recurring(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "7 as h", "text")).collect()
    assert {r.doc_id: r.text for r in out} == want
    assert sum(r.n_dropped for r in out) > 20 and all(r.h == 7 for r in out)


def test_defined_cases(spark):
    rows = [(None, "same line here"), (1, "same line here\nown"), (2, "same line here"), (2, "same line here"), (3, "x\nsame line here"), (4, "é " * 50_000 + "\nsame line here")]
    out = without_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = Counter((r.doc_id, r.text[:20], r.n_dropped) for r in out)
    assert got == Counter([(None, "same line here", 0), (1, "same line here\nown", 0), (2, "", 1), (2, "", 1), (3, "x", 1), (4, ("é " * 50_000)[:20], 1)])
    assert without_recurring(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_table(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = op9_line_dedup(spark, sf_dir).collect()
    assert {r.doc_id for r in out} == set(docs)
    for r in out:
        left = r.text.split("\n") if r.n_lines > r.n_dropped else []
        assert len(left) == r.n_lines - r.n_dropped and not Counter(left) - Counter(docs[r.doc_id].split("\n"))


def test_several_templates_in_a_leaf(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    families = [(f"click here to {a} the {b} ", f" {c} on our pages now") for a, b, c in (("read", "whole", "story"), ("see", "other", "offer"), ("join", "weekly", "letter"))]
    rows = []
    for d in range(24):
        head, tail = families[d % 3]
        rows.append((d, f"{head}{word()}{tail}\nown {word()} {word()}"))
    rows.append((99, f"click here to {' '.join(word() for _ in range(9))}"))
    out = {r.doc_id: r.text for r in without_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {d: t if d < 3 or d == 99 else t.split("\n")[1] for d, t in rows}


def test_components_are_those_of_all_pairs():
    for n, need in ((6, 5), (13, 11), (40, 32)):
        rnd = np.random.default_rng(n)
        sig = np.repeat(rnd.integers(0, 9, (12, n)), 8, axis=0).astype(np.uint16)
        sig[:, :3] = 7
        for row in sig:
            at = rnd.choice(n, rnd.integers(0, n // 5 + 2), replace=False)
            row[at] = rnd.integers(100, 999, len(at))
        sig[:, :3] = 7
        want = np.arange(len(sig))
        near = (sig[:, None] == sig[None]).sum(axis=2) >= need
        for _ in range(len(sig)):
            want = np.array([want[x].min() for x in near])
        assert components(sig).tolist() == want.tolist()


def test_long_lines_recur_from_two_documents(spark):
    line = lambda k: " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(k))
    varied = line(60).split()
    varied[10] = "other"
    rows = [(1, line(50)), (2, f"x\n{line(50)}"), (3, line(49)), (4, f"y\n{line(49)}"), (5, line(60)), (6, f"z\n{' '.join(varied)}")]
    out = {r.doc_id: r.text for r in without_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == dict(rows) | {2: "x", 6: "z"}


def test_equal_leading_bytes_are_not_equal_words(spark, monkeypatch):
    """Two bytes a word only choose candidates: here they are made to agree for all words."""
    monkeypatch.setattr(line_dedup, "_lines", lambda it: _blurred(it))
    rows = [(d, f"we say {a} {b} to all of {c} now") for d, (a, b, c) in enumerate([("old", "things", "you"), ("new", "words", "them"), ("odd", "news", "us"), ("big", "tales", "me")])]
    rows += [(10 + d, f"we give a lot of very good {w} for free to everyone") for d, w in enumerate(("books", "films", "songs"))]
    out = {r.doc_id: r.text for r in without_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == dict(rows) | {11: "", 12: ""}


def _blurred(it):
    for batch in it:
        for b in line_dedup._signed(batch, np.uint16):
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([bytes(len(x)) for x in b.column(4).to_pylist()], pa.binary())], names=b.schema.names)
