"""Stupid-backoff scores of every document under the corpus' own n-gram counts.

A word's score is count(n-gram) / count(its history) for the longest n-gram up to ORDER words that
the table holds, times BACKOFF for each step down; n-grams of two words and more enter the table
from MIN_COUNT occurrences. A document's score is the mean of the log10 scores of its words; words
are runs without white space with A-Z lower-cased, histories stay inside the document.

Plan. Documents are dealt into blocks by a hash of the row. A block explodes its n-grams (as 64-bit
hashes, the count of all words being the 0-gram) and pre-aggregates them; the distinct ones travel to
their hash partition, a bucket. Each bucket sums all blocks' counts into its part of the count table,
which holds what reaches MIN_COUNT, and the exploded n-grams are joined to it by hash. The counts
found go back to the blocks, which score their words and sum per document. Words and pairs are counted
first; an n-gram of more words is asked for only where both its parts of n - 1 words reach MIN_COUNT,
which loses none that could. A frequent n-gram is one entry per block, whatever its count.

A row of these steps is the n-grams of one block in one bucket, as a sorted difference-coded array;
there are never more such rows than n-grams. One row an n-gram was measured against: the words and
pairs of 0.17 GB of text are 22.6 million distinct in their blocks, whose first exchange alone takes
about 4 times the input on disk. Counts come back in the order in which a block asked.

The order of rows in a block plays no part, so a recomputed block gives and gets the same arrays.

Defined cases: null or wordless texts have n_words 0 and score null; repeated rows and rows with null
doc_id are scored each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import table

ORDER, MIN_COUNT, BACKOFF = 3, 2, 0.4
#: Text bytes of a block, at most about.
BLOCK_BYTES = 10_000_000
#: Blocks of small inputs.
LEAST_BLOCKS = 48
REQUEST = "block long, bucket long, n long, hashes binary, counts binary"
ANSWER = "block long, bucket long, n long, counts binary"
_ALL = np.uint64(0x243F6A8885A308D3)


def packed(x: np.ndarray) -> bytes:
    """Non-negative integers byte plane by byte plane, compressed."""
    x = np.ascontiguousarray(x, dtype="<u8")
    planes = x.view(np.uint8).reshape(-1, 8).T
    used = next((k for k in range(8, 0, -1) if planes[k - 1].any()), 1)
    return bytes([used]) + pa.compress(np.ascontiguousarray(planes[:used]).tobytes(), codec="zstd", asbytes=True)


def unpacked(raw: bytes, n: int) -> np.ndarray:
    used = raw[0]
    out = np.zeros((8, n), np.uint8)
    out[:used] = np.frombuffer(pa.decompress(raw[1:], decompressed_size=used * n, codec="zstd", asbytes=True), np.uint8).reshape(used, n)
    return np.ascontiguousarray(out.T).view("<u8").ravel()


def _ngrams(col: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """(words before each text, hashes of the n-gram that ends at each word for n = 1 to ORDER);
    0 where the text has too few words before."""
    parts, counts = [], []
    for _, _, data, off in tk.chunks(*tk.text_buffer(col)):
        s, e, woff = tk.word_spans(data, off, tk.SPACE)
        parts.append(tk.span_hash(tk.prefix_code(data, tk.FOLDED_CODE), s, e))
        counts.append(np.diff(woff))
    w = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    woff = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64) if counts else np.zeros(1, np.int64)
    place = np.arange(len(w)) - np.repeat(woff[:-1], np.diff(woff))
    out = []
    for n in range(1, ORDER + 1):
        h = np.zeros(len(w), np.uint64)
        if len(w) >= n:
            h[n - 1 :] = tk.ngram_hash(w, n) | np.uint64(1)
        h[place < n - 1] = 0
        out.append(h)
    return woff, out


def _counted(last: int, grams: list[np.ndarray], answers: pa.Table | None) -> list[np.ndarray]:
    """The corpus counts of the n-grams that end at each word, for n = 0 to last + 1, after
    round last. Round 1 has the words and pairs, round r the n-grams of r + 1 words."""
    counts: list[np.ndarray] = []
    if answers is None:
        return counts
    rounds, bucket = answers.column("round").to_numpy(), answers.column("bucket").to_numpy()
    sizes, raw = answers.column("n").to_pylist(), answers.column("counts").to_pylist()
    for r in range(1, last + 1):
        own = np.flatnonzero(rounds == r)
        own = own[np.argsort(bucket[own], kind="stable")]
        known = np.concatenate([np.zeros(0, np.uint64), *(unpacked(raw[k], sizes[k]) for k in own)])
        asked = _asked(r, grams, counts)
        flat = np.concatenate([g[m] for g, m in asked])
        unique, inverse = np.unique(flat, return_inverse=True)
        if r == 1:
            at = int(np.searchsorted(unique, _ALL))
            counts.append(np.full(len(grams[0]), float(known[at])))
            known = np.delete(known, at)
        known, at = known[inverse], 0
        for _, m in asked:
            c = np.zeros(len(m))
            c[m] = known[at : at + m.sum()]
            at += int(m.sum())
            counts.append(c)
    return counts


def _asked(r: int, grams: list[np.ndarray], counts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(n-grams, which of them are asked for) of a round. An n-gram can only reach MIN_COUNT if both
    its parts of n - 1 words do, so others are not asked for."""
    if r == 1:
        return [(g, g > 0) for g in grams[:2]]
    often = counts[r] >= MIN_COUNT
    before = np.concatenate([[False], often[:-1]]) if len(often) else often
    return [(grams[r], (grams[r] > 0) & often & before)]


def _request(n_buckets: int, r: int):
    def request(docs: pa.Table, answers: pa.Table | None) -> pa.Table:
        rows: dict[str, list] = {"block": [], "bucket": [], "n": [], "hashes": [], "counts": []}
        if docs.num_rows:
            woff, grams = _ngrams(docs.column("text").combine_chunks())
            asked = _asked(r, grams, _counted(r - 1, grams, answers))
            h, n = np.unique(np.concatenate([g[m] for g, m in asked]), return_counts=True)
            if r == 1:
                at = np.searchsorted(h, _ALL)
                h, n = np.insert(h, at, _ALL), np.insert(n, at, woff[-1])
            # equal parts of the hash range, so buckets follow the sorted order
            step = (1 << 64) // n_buckets + 1
            cut = np.searchsorted(h, np.array([k * step for k in range(n_buckets)], dtype=np.uint64)).tolist() + [len(h)]
            own = docs.column("block")[0].as_py()
            for k in range(n_buckets):
                part = h[cut[k] : cut[k + 1]]
                if len(part):
                    rows["block"].append(own)
                    rows["bucket"].append(k)
                    rows["n"].append(len(part))
                    rows["hashes"].append(packed(np.diff(part, prepend=np.uint64(0))))
                    rows["counts"].append(packed(n[cut[k] : cut[k + 1]]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(rows.items(), kinds, strict=True)})

    # the argument count tells grouped from cogrouped functions apart
    return (lambda docs: request(docs, None)) if r == 1 else (lambda docs, answers: request(docs, answers))


def _entries(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of all rows, one after the other."""
    sizes = rows.column("n").to_pylist()
    h = [np.cumsum(unpacked(x, n), dtype=np.uint64) for x, n in zip(rows.column("hashes").to_pylist(), sizes, strict=True)]
    c = [unpacked(x, n) for x, n in zip(rows.column("counts").to_pylist(), sizes, strict=True)]
    return np.concatenate([np.zeros(0, np.uint64), *h]), np.concatenate([np.zeros(0, np.uint64), *c])


def _summed(requests: pa.Table) -> pa.Table:
    """A bucket's part of the count table: n-grams that reach MIN_COUNT, and the number of all words."""
    h, c = _entries(requests)
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    total = np.add.reduceat(c, np.flatnonzero(new))
    h = h[new]
    keep = (total >= MIN_COUNT) | (h == _ALL)
    h, total = h[keep], total[keep]
    return pa.table(
        {
            "bucket": pa.array([requests.column("bucket")[0].as_py()], pa.int64()),
            "n": pa.array([len(h)], pa.int64()),
            "hashes": pa.array([packed(np.diff(h, prepend=np.uint64(0)))], pa.binary()),
            "counts": pa.array([packed(total)], pa.binary()),
        }
    )


def _joined(requests: pa.Table, counted: pa.Table) -> pa.Table:
    """The counts of each request's n-grams, in its order; what the table doesn't hold stands once."""
    known, count = _entries(counted)
    out = []
    for raw, n in zip(requests.column("hashes").to_pylist(), requests.column("n").to_pylist(), strict=True):
        h = np.cumsum(unpacked(raw, n), dtype=np.uint64)
        at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
        out.append(packed(np.where(known[at] == h, count[at], np.uint64(1)) if len(known) else np.ones(n, np.uint64)))
    return pa.table({"block": requests.column("block"), "bucket": requests.column("bucket"), "n": requests.column("n"), "counts": pa.array(out, pa.binary())})


def _answer(requests: pa.Table) -> pa.Table:
    """A bucket's part of the table, and the n-grams that were asked for joined to it, in one task: sent
    through an exchange of its own, the table took 0.3 times the input on disk."""
    return _joined(requests, _summed(requests))


def _score(docs: pa.Table, answers: pa.Table) -> pa.Table:
    if not docs.num_rows:
        return pa.table({k: pa.array([], t) for k, t in (("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_backed_off", pa.int64()), ("log10_sum", pa.float64()), ("score", pa.float64()))})
    woff, grams = _ngrams(docs.column("text").combine_chunks())
    c = _counted(ORDER - 1, grams, answers)
    n = len(grams[0])
    score, order_of = np.full(n, -np.inf), np.zeros(n, np.int64)
    place = np.arange(n) - np.repeat(woff[:-1], np.diff(woff))
    longest = np.minimum(place + 1, ORDER)
    for k in range(1, ORDER + 1):
        history = np.concatenate([[1.0], c[k - 1][:-1]]) if k > 1 else c[0]
        usable = c[k] >= (MIN_COUNT if k > 1 else 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            s = np.log10(c[k]) - np.log10(history)
        score = np.where(usable, s, score)
        order_of = np.where(usable, k, order_of)
    score += (longest - order_of) * np.log10(BACKOFF)
    words = np.diff(woff)
    per_doc = np.array([score[a:b].sum() for a, b in zip(woff[:-1], woff[1:], strict=True)])
    backed = np.concatenate([[0], np.cumsum(order_of < longest)])
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = np.where(words > 0, per_doc / words, np.nan)
    return pa.table(
        {
            "doc_id": docs.column("doc_id"),
            "n_words": pa.array(words.astype(np.int64)),
            "n_backed_off": pa.array((backed[woff[1:]] - backed[woff[:-1]]).astype(np.int64)),
            "log10_sum": pa.array(per_doc),
            "score": pa.array(mean, mask=words == 0),
        }
    )


def scores(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_backed_off, log10_sum, score) for every row of docs(doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = buckets = max(LEAST_BLOCKS, -(-size // BLOCK_BYTES))
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    # all uses of dealt share one exchange
    answers = None
    for r in range(1, ORDER):
        if answers is None:
            asked = dealt.groupBy("block").applyInArrow(_request(buckets, r), REQUEST)
        else:
            asked = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_request(buckets, r), REQUEST)
        new = asked.groupBy("bucket").applyInArrow(_answer, ANSWER).withColumn("round", F.lit(r).cast("long"))
        answers = new if answers is None else answers.unionByName(new)
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score, "doc_id long, n_words long, n_backed_off long, log10_sum double, score double")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums are rounded, as their last digits depend on the order of addition."""
    out = scores(table(spark, sf_dir, "documents"))
    return out.withColumns({"log10_sum": F.round("log10_sum", 4), "score": F.round("score", 6)})


OP1_SQL = rf"""
with d as (
  select row_number() over () as r, doc_id,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') as w
  from documents
), g as materialized (
  select r, i, w[i] as g1, case when i > 1 then w[i - 1] || ' ' || w[i] end as g2, case when i > 2 then w[i - 2] || ' ' || w[i - 1] || ' ' || w[i] end as g3,
    case when i > 1 then w[i - 1] end as h1, case when i > 2 then w[i - 2] || ' ' || w[i - 1] end as h2
  from (select r, w, unnest(range(1, len(w) + 1)) as i from d)
), c1 as (select g1 as x, count(*) as n from g group by 1),
c2 as (select g2 as x, count(*) as n from g where g2 is not null group by 1 having count(*) >= {MIN_COUNT}),
c3 as (select g3 as x, count(*) as n from g where g3 is not null group by 1 having count(*) >= {MIN_COUNT}),
s as (
  select r, least(i, {ORDER}) as top, case when c3.n is not null then 3 when c2.n is not null then 2 else 1 end as found,
    case when c3.n is not null then log10(c3.n) - log10(hh.n) when c2.n is not null then log10(c2.n) - log10(h.n) else log10(c1.n) - log10((select count(*) from g)) end as v
  from g join c1 on c1.x = g1 left join c2 on c2.x = g2 left join c3 on c3.x = g3 left join c1 h on h.x = h1 left join c2 hh on hh.x = h2
), t as (
  select r, sum(v + (top - found) * log10({BACKOFF})) as total, count(*) as n, count(*) filter (found < top) as backed from s group by r
)
select doc_id, cast(coalesce(n, 0) as bigint) as n_words, cast(coalesce(backed, 0) as bigint) as n_backed_off, round(coalesce(total, 0.0), 4) as log10_sum, round(total / n, 6) as score
from d left join t on t.r = d.r
"""
