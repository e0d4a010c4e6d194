import hashlib
import random
from collections import Counter

import pyarrow as pa
import pyarrow.compute  # noqa: F401

from termloom.llm import suffix_dedup as sd
from termloom.llm.suffix_dedup import LENGTH, op4_suffix_dedup, without_repeats


def brute(texts):
    docs = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + LENGTH] for d in docs for i in range(len(d) - LENGTH + 1))
    out = []
    for d in docs:
        gone = bytearray(len(d) + 1)
        end = 0
        for i in range(len(d) - LENGTH + 1):
            if seen[d[i : i + LENGTH]] > 1:
                for j in range(max(i, end), i + LENGTH):
                    gone[j] = 1
                end = i + LENGTH
        kept = bytes(b for b, g in zip(d, gone, strict=False) if not g)
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(d)))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(out, rows):
    want = sorted((d if d is not None else -1, *x) for (d, _), x in zip(rows, brute([t for _, t in rows]), strict=True))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == want


def test_planted_repeats(spark):
    rnd = random.Random(8)
    text = lambda n: "".join(rnd.choice("abcdé fgh\n") for _ in range(n))
    shared = [text(n) for n in (150, 185, 200, 201, 260, 700, 1500)]
    rows = [(0, None), (1, ""), (2, "x" * 199), (3, "x" * 200), (4, "y" * 201), (5, "ab" * 300), (6, "abc" * 70)]
    for d in range(10, 90):
        t = text(rnd.randint(0, 600))
        for _ in range(rnd.randint(0, 3)):
            s = rnd.choice(shared)
            a = rnd.randrange(len(s))
            s = rnd.choice([s, s[a:], s[:a]])
            k = rnd.randint(0, len(t))
            t = t[:k] + s + t[k:]
        rows.append((d, t))
    rows += [(100 + k, rows[20 + k][1][: 900 - 5 * k]) for k in range(10)] + [(None, rows[15][1]), (15, rows[15][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as block", "2 as n")
    out = without_repeats(df).collect()
    check(out, rows)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in out)
    assert without_repeats(df.limit(0)).count() == 0


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check(op4_suffix_dedup(spark, sf_dir).collect(), rows)


def periodic(rnd):
    """A few texts of short periods, now and then with a byte put in: suffixes of all lengths tie."""
    texts = []
    for _ in range(rnd.randint(2, 5)):
        unit = "".join(rnd.choice("ab") for _ in range(rnd.randint(1, 6)))
        t = (unit * 600)[: rnd.randint(150, 600)]
        for _ in range(rnd.randint(0, 2)):
            k = rnd.randint(0, len(t))
            t = t[:k] + rnd.choice("abz") + t[k:]
        texts.append(t)
    return texts


def in_process(texts, n_blocks=3):
    """The operator's kernels without a session."""
    blocks = [pa.table({"doc_id": pa.array(range(k, len(texts), n_blocks), pa.int64()), "text": pa.array(texts[k::n_blocks], pa.string()), "block": pa.array([k] * len(texts[k::n_blocks]), pa.int64())}) for k in range(min(n_blocks, len(texts)))]
    counts = Counter()
    for b in blocks:
        c = sd._count(b)
        counts.update(dict(zip(c["h"].to_pylist(), c["n"].to_pylist(), strict=True)))
    known = [pa.table({"h": pa.array([h for h in sd._count(b)["h"].to_pylist() if counts[h] > 1], pa.int64())}) for b in blocks]
    splitters = [b"abab" * 25, b"b" * 100]
    runs = pa.concat_tables([sd._run_request(splitters)(b, k) for b, k in zip(blocks, known, strict=True)])
    parts = {p: runs.filter(pa.compute.equal(runs["part"], p)) for p in set(runs["part"].to_pylist())}
    marks = pa.concat_tables([sd._merge(t) for t in parts.values()]) if parts else None
    out = []
    for k, (b, own) in enumerate(zip(blocks, known, strict=True)):
        n = len(own)
        none = lambda t, m: pa.nulls(m, t)
        replies = pa.table({"h": own["h"], "part": none(pa.int64(), n), "first": none(pa.binary(), n), "last": none(pa.binary(), n)})
        if marks is not None:
            m = marks.filter(pa.compute.equal(marks["block"], k))
            replies = pa.concat_tables([replies, pa.table({"h": none(pa.int64(), len(m)), "part": m["part"], "first": m["first"], "last": m["last"]})])
        out += sd._cut(False)(b, replies).to_pylist()
    return [tuple(r[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in sorted(out, key=lambda r: r["doc_id"])]


def test_periodic_texts():
    rnd = random.Random(5)
    for _ in range(1000):
        texts = periodic(rnd)
        assert in_process(texts) == brute(texts), texts


def test_short_neighbours_hide_no_partner(spark):
    rows = [(k, "a" * z + "z" + "a" * (n - z - 1)) for k, (n, z) in enumerate([(244, 137), (210, 152), (232, 155)])]
    check(without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_long_run_of_one_byte():
    got = in_process(["x" * 300_000 + "y", "z" * 150, "q" + "x" * 250])
    assert [r[:3] for r in got] == [(300_001, 300_000, 1), (150, 0, 0), (251, 250, 1)]
