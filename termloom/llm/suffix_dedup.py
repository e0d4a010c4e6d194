"""Removal of repeated 200-byte strings by a distributed merge sort of suffixes.

Every byte covered by a string of LENGTH bytes that also starts anywhere else is removed; texts are
UTF-8 bytes, strings never cross documents and are judged on the input.

Which suffixes are sorted. A window of LENGTH bytes is represented by its anchor, the leftmost of its
GRAM-byte pieces with the least hash; equal windows have equal pieces at equal offsets, and all windows
of one anchor lie in one stretch of under 1.5 LENGTH bytes. An anchor whose piece occurs once in the
corpus (by counts of 64-bit hashes, whose collisions only keep an anchor too many) has no repeated
window. The suffixes at all other anchors, from the anchor to the end of their stretch, are sorted; what
stands before the anchor goes with them as a field of its own. That is about one suffix in fifty bytes
of repeated text instead of one for each byte, and loses no window.

The sort. Each block of documents sorts its suffixes into a run, equal ones once with their number, and
front-codes it: a suffix is the length of the prefix shared with the one before it, and the rest. Runs
are exchanged by ranges of the first GRAM bytes (splitters from a sample, which decide balance only;
equal pieces are never parted) and merged by a loser tree that keeps each suffix's common prefix with
the last output: only suffixes with equal common prefix are compared, from its end on.

The windows. A window that begins o bytes before its anchor is repeated where another suffix agrees in
the first LENGTH - o bytes and in the o bytes before the anchor. In merged order suffixes that agree in
so many bytes stand together, by the merge's own prefix lengths; the bytes before the anchors are
ranked in the same way. For each o the two ranks are counted together, which is exact. For each
suffix the first and the last repeated window go back to its block in run order; as windows of one
anchor overlap, these two give the removed bytes.

Blocks depend on row hashes only and runs on their content, so recomputed parts agree. A block sends
one row to each range in which it has suffixes.

Defined cases: null text is empty; texts under LENGTH bytes lose nothing; repeated rows (and rows with
null doc_id) are documents of their own that repeat each other; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import n_shuffle, table
from .lm_score import packed, unpacked

LENGTH, GRAM = 200, 100
SPAN = LENGTH - GRAM + 1
#: Text bytes of a block, and those that a range of suffixes stands for, at most about.
BLOCK_BYTES, PART_BYTES = 7_000_000, 8_000_000
#: Pieces looked at for splitters, about, whatever the input.
SPLIT_SAMPLE = 4_000
#: Text bytes whose pieces are hashed at once.
CHUNK = 1 << 19
#: Anchors whose places are turned into Python numbers at once.
STRIDE = 100_000
NONE = 255
COUNTS = "block long, h long, n long"
RUN = "block long, part long, n long, size binary, shared binary, many binary, rest binary, before binary, back binary"
MARKS = "block long, part long, n long, first binary, last binary"
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, hash of its piece, first window, last window) of the texts in data."""
    n = len(data)
    windows = n - LENGTH + 1
    if windows < 1:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    at = np.arange(n - GRAM + 1)
    h = tk.mix(tk.span_poly(tk.prefix_code(data, tk.BYTE_CODE), at, at + GRAM))
    # least of each SPAN neighbours, from running minima of blocks in both directions
    rows = np.full((-(-len(h) // SPAN) + 1) * SPAN, np.iinfo(np.uint64).max, np.uint64)
    rows[: len(h)] = h
    rows = rows.reshape(-1, SPAN)
    up = np.minimum.accumulate(rows, axis=1).ravel()
    down = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(down[:windows], up[SPAN - 1 : SPAN - 1 + windows])
    inside = np.arange(windows) + LENGTH <= np.repeat(off[1:], np.diff(off))[:windows]
    same = np.zeros(windows + 1, bool)
    same[1:-1] = inside[1:] & inside[:-1] & (least[1:] == least[:-1])
    s = np.flatnonzero(inside & ~same[:-1])
    e = np.flatnonzero(inside & ~same[1:])
    place = np.empty(len(s), np.int64)
    for k in range(0, len(s), 20_000):
        place[k : k + 20_000] = h[s[k : k + 20_000, None] + np.arange(SPAN)].argmin(axis=1)
    a = s + place
    # equal pieces within a window: later windows of the stretch have a later anchor
    late = np.flatnonzero(e > a)
    if len(late):
        more = []
        for k in late.tolist():
            own = np.flatnonzero(h[s[k] : e[k] + SPAN] == least[s[k]]) + s[k]
            lo = np.concatenate([[s[k]], own[:-1] + 1])
            hi = np.minimum(own, e[k])
            ok = lo <= hi
            more.append(np.stack([own[ok], lo[ok], hi[ok]]))
        more = np.concatenate(more, axis=1)
        keep = e <= a
        a, s, e = (np.concatenate([x[keep], y]) for x, y in zip((a, s, e), more, strict=True))
    return a, h[a], s, e


def _anchored(docs: pa.Table) -> list[tuple]:
    """(bytes, offsets, anchors...) of the pieces of a block."""
    data, off = tk.text_buffer(docs.column("text").combine_chunks())
    return [(part, poff, *anchors(part, poff)) for _, _, part, poff in tk.chunks(data, off, CHUNK)]


def _count(docs: pa.Table) -> pa.Table:
    """The hashes of a block's anchors with their numbers."""
    found = [x[3] for x in _anchored(docs)]
    h, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
    return pa.table({"block": pa.array(np.full(len(h), docs.column("block")[0].as_py()), pa.int64()), "h": pa.array(tk.to_int64(h)), "n": pa.array(n, pa.int64())})


def _suffixes(docs: pa.Table, often: np.ndarray) -> tuple[list[tuple], list[np.ndarray], list[np.ndarray], list[tuple[bytes, bytes]]]:
    """The block's pieces, which of their anchors are among the hashes often, the number of each such
    anchor's suffix, and the distinct suffixes: (bytes from the anchor on, bytes before it backwards)."""
    pieces = _anchored(docs)
    often = np.sort(often.view(np.uint64))
    known: dict[tuple[bytes, bytes], int] = {}
    picked, numbers = [], []
    for part, _, a, h, s, e in pieces:
        at = np.minimum(np.searchsorted(often, h), max(0, len(often) - 1))
        own = np.flatnonzero(often[at] == h) if len(often) else np.zeros(0, np.int64)
        picked.append(own)
        raw, ids = part.tobytes(), np.empty(len(own), np.int64)
        for k in range(0, len(own), STRIDE):
            some = own[k : k + STRIDE]
            rows = zip(a[some].tolist(), s[some].tolist(), e[some].tolist(), strict=True)
            ids[k : k + STRIDE] = [known.setdefault((raw[x : hi + LENGTH], raw[lo:x][::-1]), len(known)) for x, lo, hi in rows]
        numbers.append(ids)
    return pieces, picked, numbers, list(known)


def shared_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix of a and b, known to be start at least."""
    m = min(len(a), len(b))
    if m <= start:
        return m
    x = int.from_bytes(a[start:m]) ^ int.from_bytes(b[start:m])
    return m - (x.bit_length() + 7) // 8


def _run_request(splitters: list[bytes]):
    def request(docs: pa.Table, often: pa.Table) -> pa.Table:
        rows: dict[str, list] = {k.split()[0]: [] for k in RUN.split(", ")}
        if docs.num_rows and often.num_rows:
            _, _, numbers, keys = _suffixes(docs, often.column("h").to_numpy())
            many = np.bincount(np.concatenate(numbers), minlength=len(keys)) > 1
            order = sorted(range(len(keys)), key=keys.__getitem__)
            own = docs.column("block")[0].as_py()
            i, part = 0, 0
            while i < len(order):
                while part < len(splitters) and keys[order[i]][0][:GRAM] >= splitters[part]:
                    part += 1
                limit = splitters[part] if part < len(splitters) else None
                last, j, shared, rest = b"", i, [], []
                while j < len(order) and (limit is None or keys[order[j]][0][:GRAM] < limit):
                    key = keys[order[j]][0]
                    lcp = shared_prefix(last, key)
                    shared.append(lcp)
                    rest.append(key[lcp:])
                    last = key
                    j += 1
                ids = order[i:j]
                size, before = (np.array([len(keys[x][c]) for x in ids]) for c in (0, 1))
                values = (
                    own, part, len(ids), packed(size), packed(np.array(shared)), many[ids].astype(np.uint8).tobytes(), pa.compress(b"".join(rest), codec="zstd", asbytes=True),
                    packed(before), pa.compress(b"".join(keys[x][1] for x in ids), codec="zstd", asbytes=True),
                )
                for k, v in zip(rows, values, strict=True):
                    rows[k].append(v)
                i = j
        return pa.table({k: pa.array(v, pa.int64() if k in ("block", "part", "n") else pa.binary()) for k, v in rows.items()})

    return request


class Run:
    """A front-coded run, read in order: the current suffix and its common prefix with the last one."""

    def __init__(self, n: int, size: bytes, shared: bytes, rest: bytes):
        self.n = n
        self.size, self.shared = (unpacked(x, n).tolist() for x in (size, shared))
        self.rest = pa.decompress(rest, decompressed_size=sum(self.size) - sum(self.shared), codec="zstd", asbytes=True)
        self.at, self.byte, self.key = -1, 0, b""

    def step(self) -> int:
        """Move on; the common prefix of the new suffix with the one before, or -1 at the end."""
        self.at += 1
        if self.at >= self.n:
            return -1
        lcp = self.shared[self.at]
        end = self.byte + self.size[self.at] - lcp
        self.key = self.key[:lcp] + self.rest[self.byte : end]
        self.byte = end
        return lcp


def merged(runs: list[Run]):
    """(run, common prefix with the suffix before) of all suffixes of the runs in order.

    A loser tree over the runs. Each run that is not the winner keeps the common prefix of its
    suffix with the suffix that beat it; as that is also its common prefix with the last output,
    the longer of two such prefixes is the smaller suffix without a look at any byte, and equal ones
    are compared from their ends on."""
    k = 1 << max(0, len(runs) - 1).bit_length()
    lcp = [0] * k  # with the last output
    key: list[bytes | None] = [None] * k
    for x, run in enumerate(runs):
        if run.step() >= 0:
            key[x] = run.key

    def play(x: int, y: int) -> tuple[int, int]:
        """(winner, loser), with the loser's prefix brought up to date."""
        a, b = key[x], key[y]
        if a is None or b is None:
            return (y, x) if a is None else (x, y)
        if lcp[x] != lcp[y]:
            return (x, y) if lcp[x] > lcp[y] else (y, x)
        h = shared_prefix(a, b, lcp[x])
        first = (a[h : h + 1], x) <= (b[h : h + 1], y)
        win, lose = (x, y) if first else (y, x)
        lcp[lose] = h
        return win, lose

    loser = [0] * k
    level = list(range(k))
    while len(level) > 1:
        nxt = []
        for j in range(0, len(level), 2):
            win, lose = play(level[j], level[j + 1])
            loser[len(level) // 2 + j // 2] = lose
            nxt.append(win)
        level = nxt
    win = level[0]
    while key[win] is not None:
        run = runs[win]
        yield win, lcp[win]
        own = run.step()
        key[win] = run.key if own >= 0 else None
        lcp[win] = own
        node = (k + win) // 2
        while node:
            win, loser[node] = play(win, loser[node])
            node //= 2


def _ranks(texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common prefix with the row before) of the sorted rows of texts[rows, bytes]."""
    order = np.argsort(np.ascontiguousarray(texts).view(f"S{texts.shape[1]}").ravel(), kind="stable")
    t = texts[order]
    differ = np.ones((len(t), t.shape[1] + 1), bool)
    differ[1:, :-1] = t[1:] != t[:-1]
    return order, differ.argmax(axis=1)


def repeated_windows(size: np.ndarray, lcp: np.ndarray, many: np.ndarray, backs: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix the most and the fewest bytes before its anchor at which a repeated window of its
    begins, -1 for none. Suffixes are in order, with their sizes and common prefixes with the one before;
    backs[suffix, byte] are the bytes before the anchors backwards, before their numbers."""
    m = len(size)
    most, least = np.full(m, -1), np.full(m, -1)
    if not m:
        return most, least
    # rows shorter than o bytes take no part in round o, so what pads them doesn't matter
    order, shared = _ranks(backs)
    for o in range(backs.shape[1] + 1):
        own = np.flatnonzero((size >= LENGTH - o) & (before >= o))
        if not len(own):
            continue
        front = np.cumsum(lcp < LENGTH - o)
        back = np.empty(m, np.int64)
        back[order] = np.cumsum(shared < o)
        key = front[own] * (m + 1) + back[own]
        by = np.argsort(key, kind="stable")
        ordered = key[by]
        new = np.ones(len(by), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        total = np.add.reduceat(1 + many[own][by].astype(np.int64), np.flatnonzero(new))
        hit = own[by[(total > 1)[np.cumsum(new) - 1]]]
        most[hit] = o
        least[hit[least[hit] < 0]] = o
    return most, least


def _merge(part: pa.Table) -> pa.Table:
    get = lambda name: part.column(name).to_pylist()
    ns = get("n")
    runs = [Run(*x) for x in zip(ns, get("size"), get("shared"), get("rest"), strict=True)]
    turn, lcp = [], []
    for run, shared in merged(runs):
        turn.append(run)
        lcp.append(shared)
    turn, lcp = np.array(turn, np.int64), np.array(lcp, np.int64)
    # the k-th suffix taken from a run is its k-th: from merged order to the order of the runs' rows
    to = np.empty(len(turn), np.int64)
    to[np.argsort(turn, kind="stable")] = np.arange(len(turn))
    size = np.concatenate([np.array(r.size) for r in runs])
    del runs
    befores = [unpacked(x, n).astype(np.int64) for x, n in zip(get("before"), ns, strict=True)]
    before = np.concatenate(befores)
    backs = np.zeros((len(before), max(1, int(before.max(initial=0)))), np.uint8)
    at = 0
    for raw, b in zip(get("back"), befores, strict=True):
        text = np.frombuffer(pa.decompress(raw, decompressed_size=int(b.sum()), codec="zstd", asbytes=True), np.uint8)
        row = np.repeat(np.arange(at, at + len(b)), b)
        backs[row, np.arange(len(text)) - np.repeat(np.cumsum(b) - b, b)] = text
        at += len(b)
    many = np.frombuffer(b"".join(get("many")), np.uint8)
    most, least = repeated_windows(size[to], lcp, many[to], backs[to], before[to])
    first, last = (np.full(len(before), NONE, np.uint8) for _ in range(2))
    hit = most >= 0
    first[to[hit]], last[to[hit]] = before[to[hit]] - most[hit], before[to[hit]] - least[hit]
    ends = np.cumsum(ns)
    cut = lambda x: pa.array([x[e - n : e].tobytes() for e, n in zip(ends, ns, strict=True)], pa.binary())
    return pa.table({"block": part.column("block"), "part": part.column("part"), "n": part.column("n"), "first": cut(first), "last": cut(last)})


def _cut(with_text: bool):
    def cut(docs: pa.Table, replies: pa.Table) -> pa.Table:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        names = [x.split()[0] for x in OUT.split(", ")]
        if not docs.num_rows:
            return pa.table({k: pa.array([], t) for k, t in zip(names, kinds, strict=True)})
        marks = replies.filter(pc.is_valid(replies.column("first")))
        often = replies.filter(pc.is_valid(replies.column("h"))).column("h").to_numpy()
        pieces, picked, numbers, keys = _suffixes(docs, often)
        order = np.argsort(marks.column("part").to_numpy(), kind="stable")
        place = np.empty(len(keys), np.int64)
        place[sorted(range(len(keys)), key=keys.__getitem__)] = np.arange(len(keys))
        lows, highs = (np.frombuffer(b"".join(marks.column(c).to_pylist()[k] for k in order), np.uint8).astype(np.int64) for c in ("first", "last"))
        out: dict[str, list] = {k: [] for k in names[1:]}
        for (part, poff, _, _, s, _), own, ids in zip(pieces, picked, numbers, strict=True):
            f, t = (x[place[ids]] if len(ids) else np.zeros(0, np.int64) for x in (lows, highs))
            some = f != NONE
            change = np.zeros(len(part) + 1, np.int64)
            np.add.at(change, s[own][some] + f[some], 1)
            np.add.at(change, s[own][some] + t[some] + LENGTH, -1)
            gone = np.cumsum(change)[:-1] > 0
            for a, b in zip(poff[:-1].tolist(), poff[1:].tolist(), strict=True):
                mask = gone[a:b]
                kept = part[a:b][~mask].tobytes()
                out["n_bytes"].append(b - a)
                out["n_removed"].append(int(mask.sum()))
                out["n_spans"].append(int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum()))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["kept"].append(kept if with_text else None)
        return pa.table({"doc_id": docs.column("doc_id")} | {k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds[1:], strict=True)})

    return cut


def without_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row of docs(doc_id, text);
    kept is the remaining bytes."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size, long = docs.agg(F.sum(F.octet_length("text")), F.count_if(F.length("text") >= GRAM)).first()
    size = size or 0
    blocks = max(n_shuffle(spark), -(-size // BLOCK_BYTES))
    parts = max(2 * n_shuffle(spark), -(-size // PART_BYTES))
    h = F.xxhash64("doc_id", "text")
    some = docs.where((F.length("text") >= GRAM) & (F.pmod(h, F.lit(-(-long // SPLIT_SAMPLE) or 1)) == 0))
    lead = some.select(F.substring("text", F.pmod(F.xxhash64(h), F.length("text") - GRAM + 1).cast("int") + 1, GRAM).alias("lead"))
    leads = sorted(r.lead.encode()[:GRAM] for r in lead.collect())
    splitters = sorted({leads[k * len(leads) // parts] for k in range(1, parts)}) if leads else []
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    # all uses of dealt share one exchange
    asked = dealt.groupBy("block").applyInArrow(_count, COUNTS)
    often = asked.withColumn("n", F.sum("n").over(W.partitionBy("h"))).where("n > 1").select("block", "h")
    runs = dealt.groupBy("block").cogroup(often.groupBy("block")).applyInArrow(_run_request(splitters), RUN)
    marks = runs.groupBy("part").applyInArrow(_merge, MARKS)
    nothing = F.lit(None)
    replies = often.select("block", "h", nothing.cast("long").alias("part"), nothing.cast("binary").alias("first"), nothing.cast("binary").alias("last")).unionByName(
        marks.select("block", nothing.cast("long").alias("h"), "part", "first", "last")
    )
    return dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_cut(with_text), OUT)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"), with_text=False).drop("kept")
