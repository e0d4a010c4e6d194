"""Main text of web pages by a recurrent block labeller.

A page is taken apart into its leaf blocks in page order: the text between block-level tags, with the
path of open tags and their class and id words. A bidirectional LSTM in numpy reads, for the whole
page, each block's hashed tag path, hashed words and a few lengths, and labels it as main text or
not. Comments, scripts, styles, frames, drawings and what stands in the head are markup and never become
blocks; the text inside formulas, objects and canvases belongs to the block around them.

The labeller is trained from a fixed seed, on the driver, on PAGES generated block sequences: page
layouts put together from the usual sectioning tags and class names, with random words, so it learns
structure and not a vocabulary. Nothing is read from the corpus. Weights are a few hundred kB.

Defined cases: null html is empty; a page without main blocks has an empty text; unclosed tags,
comments and scripts end where the next tag or the page ends them; repeated rows are read each;
extra columns are ignored.
"""

from __future__ import annotations

import functools
import html as entities
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import table

PATH_DIM, WORD_DIM, SIZE_DIM, HIDDEN = 96, 16, 8, 20
DIM = PATH_DIM + WORD_DIM + SIZE_DIM
PAGES, EPOCHS, BATCH = 500, 10, 32
TEXTS = "page_id long, url string, text string, n_chars long, n_blocks long, n_main long"

BLOCK_TAGS = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead tr ul".split()
)
VOID_TAGS = set("area base br col embed hr img input link meta param source track wbr".split())
#: A new one of these closes an open one of the same name, up to the nearest list or table.
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
CLOSES_P = BLOCK_TAGS - {"body", "html", "button", "label", "option", "select", "textarea"}

#: A value is quoted only where a quote follows the equals sign, and ends at the next one if what
#: follows there can follow a value; so an unbalanced quote costs its own tag and no text. A tag that is
#: never closed ends where the next one begins.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:=\s*+\"[^\"]*+\"(?=[\s/>])|=\s*+'[^']*+'(?=[\s/>])|[^<>])*+)(?:>|(?=<)|\Z)"
    r"|<[!?][^>]*>",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[A-Za-z]+")


@functools.lru_cache(100_000)
def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) % PATH_DIM


@functools.lru_cache(100_000)
def _marks(tag: str, attrs: str) -> tuple[int, int]:
    """(set of the slots of a tag and of the words of its class, id and role, as bits; their number)."""
    words = [tag]
    if "=" in attrs:
        for m in _NAMES.finditer(attrs):
            words += ["." + w.lower() for w in _PART.findall(m[1] or m[2] or m[3] or "")]
    bits = 0
    for w in words:
        bits |= 1 << _slot(w)
    return bits, len(words)


class _Stack:
    """Open tags, with the slots of the whole path in every entry, so that a block copies nothing."""

    def __init__(self):
        self.tags: list[str] = []
        self.paths: list[tuple[int, int]] = [(0, 0)]
        self.where: dict[str, list[int]] = {}

    def push(self, tag: str, attrs: str) -> None:
        bits, n = _marks(tag, attrs)
        above, count = self.paths[-1]
        self.where.setdefault(tag, []).append(len(self.tags))
        self.tags.append(tag)
        self.paths.append((above | bits, count + n))

    def cut(self, k: int) -> None:
        """Close the entries from k on."""
        while len(self.tags) > k:
            self.where[self.tags.pop()].pop()
            self.paths.pop()

    def close(self, tag: str) -> None:
        if self.where.get(tag):
            self.cut(self.where[tag][-1])


def blocks(page: str) -> list[tuple[tuple[int, int], str, int]]:
    """(path, text, characters inside links) of the page's leaf blocks in order; a path is the bits of its
    slots and their number. Time is linear in the page, however deep its tags are."""
    out, stack, buf, at, links, in_head = [], _Stack(), [], 0, 0, False
    open_links = 0

    def flush() -> None:
        nonlocal links
        if buf:
            text = " ".join(entities.unescape("".join(buf)).split())
            if text and not in_head:
                out.append((stack.paths[-1], text, min(links, len(text))))
            buf.clear()
        links = 0

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            buf.append(piece)
            if open_links:
                links += len(piece)
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m["raw"]:
                buf.append(" ")
            continue
        tag = tag.lower()
        if tag == "head":
            flush()
            in_head = not m["end"]
        elif tag == "body":
            flush()
            in_head = False
        if tag == "br":
            buf.append(" ")
        elif tag in BLOCK_TAGS:
            flush()
            if m["end"]:
                stack.close(tag)
            else:
                shut = SELF_CLOSING.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
                k = len(stack.tags) - 1
                # open paragraphs, and cells beside a cell, don't hide what a new tag closes
                while k >= 0 and stack.tags[k] not in shut and (stack.tags[k] == "p" or (tag in ("td", "th") and stack.tags[k] in ("td", "th"))):
                    k -= 1
                if k >= 0 and stack.tags[k] in shut:
                    stack.cut(k)
                if tag not in VOID_TAGS:
                    stack.push(tag, m["attrs"])
        elif tag == "a":
            open_links = 0 if m["end"] else 1
    if at < len(page):
        buf.append(page[at:])
    flush()
    return out


def features(pages: list[list[tuple[tuple[int, int], str, int]]]) -> np.ndarray:
    """One row a block of all pages."""
    flat = [b for p in pages for b in p]
    x = np.zeros((len(flat), DIM), np.float32)
    if not flat:
        return x
    raw = np.frombuffer(b"".join(b[0][0].to_bytes(PATH_DIM // 8, "little") for b in flat), np.uint8)
    x[:, :PATH_DIM] = np.unpackbits(raw.reshape(len(flat), -1), axis=1, bitorder="little")
    data, off = tk.text_buffer(pa.array([b[1] for b in flat], pa.large_string()))
    for i, j, part, poff in tk.chunks(data, off):
        s, e, woff = tk.word_spans(part, poff, tk.SPACE)
        h = tk.span_hash(tk.prefix_code(part, tk.FOLDED_CODE), s, e)
        n = np.diff(woff)
        cell = np.repeat(np.arange(j - i), n) * WORD_DIM + (h % np.uint64(WORD_DIM)).astype(np.int64)
        x[i:j, PATH_DIM : PATH_DIM + WORD_DIM] = np.bincount(cell, minlength=(j - i) * WORD_DIM).reshape(j - i, WORD_DIM) / np.maximum(n, 1)[:, None]
        x[i:j, -1] = np.log1p(n) / 5
    chars = np.array([len(b[1]) for b in flat], np.float32)
    x[:, -2] = np.array([b[2] for b in flat], np.float32) / chars
    x[:, -3] = np.log1p(chars) / 7
    x[:, -4] = [min(b[0][1], 20) / 20 for b in flat]
    size = np.array([len(p) for p in pages])
    first = np.repeat(np.cumsum(size) - size, size)
    x[:, -5] = (np.arange(len(flat)) - first) / np.repeat(np.maximum(size, 1), size)
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiLstm:
    """Labels of sequences from both directions' hidden states."""

    def __init__(self, seed: int = 5):
        rnd = np.random.default_rng(seed)
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"] = rnd.normal(0, 0.15, (DIM, 4 * HIDDEN)).astype(np.float32)
            self.p[f"h{d}"] = rnd.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            self.p[f"c{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)
        self.p["v"] = rnd.normal(0, 0.3, 2 * HIDDEN).astype(np.float32)
        self.p["c"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool = False):
        """Hidden states over x[T, B, DIM]; where mask is 0 the state stays."""
        t_max, n, _ = x.shape
        h = c = np.zeros((n, HIDDEN), np.float32)
        pre = x @ self.p[f"x{d}"] + self.p[f"c{d}"]
        out, saved = np.zeros((t_max, n, HIDDEN), np.float32), []
        for t in range(t_max):
            z = pre[t] + h @ self.p[f"h{d}"]
            i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            c_new = f * c + i * g
            tc = np.tanh(c_new)
            h_new, m = o * tc, mask[t][:, None]
            if keep:
                saved.append((i, f, o, g, c, tc, h))
            c, h = np.where(m, c_new, c), np.where(m, h_new, h)
            out[t] = h
        return out, saved

    def _back(self, x, mask, saved, dout, d, grad) -> None:
        dh = dc = np.zeros_like(dout[0])
        dz_all = np.zeros((*dout.shape[:2], 4 * HIDDEN), np.float32)
        for t in range(len(dout) - 1, -1, -1):
            i, f, o, g, c, tc, h = saved[t]
            m = mask[t][:, None]
            dh = dh + dout[t]
            dh_in, dc_in = dh * m, dc * m
            do = dh_in * tc
            dcn = dc_in + dh_in * o * (1 - tc**2)
            dz = np.concatenate([dcn * g * i * (1 - i), dcn * c * f * (1 - f), do * o * (1 - o), dcn * i * (1 - g**2)], axis=1)
            dz_all[t] = dz
            grad[f"h{d}"] += h.T @ dz
            dh = dz @ self.p[f"h{d}"].T + dh * (1 - m)
            dc = dcn * f + dc * (1 - m)
        grad[f"x{d}"] += np.einsum("tbd,tbz->dz", x, dz_all, optimize=True)
        grad[f"c{d}"] += dz_all.sum((0, 1))

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        f, sf = self._run(x, mask, "f", keep)
        b, sb = self._run(x[::-1], mask[::-1], "b", keep)
        both = np.concatenate([f, b[::-1]], axis=2)
        return both @ self.p["v"] + self.p["c"], both, sf, sb

    def train(self, sequences: list[tuple[np.ndarray, np.ndarray]], seed: int = 9) -> None:
        rnd = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(EPOCHS):
            order = rnd.permutation(len(sequences))
            for k in range(0, len(order), BATCH):
                x, mask, y = padded([sequences[j] for j in order[k : k + BATCH]])
                z, both, sf, sb = self.logits(x, mask, True)
                dz = ((_sigmoid(z) - y) * mask / mask.sum()).astype(np.float32)
                grad = {k: np.zeros_like(v) for k, v in self.p.items()}
                grad["v"] += np.einsum("tb,tbh->h", dz, both)
                grad["c"] += dz.sum()
                dh = dz[..., None] * self.p["v"]
                self._back(x, mask, sf, dh[..., :HIDDEN], "f", grad)
                self._back(x[::-1], mask[::-1], sb, dh[::-1, :, HIDDEN:], "b", grad)
                step += 1
                rate = 0.02 if epoch < EPOCHS * 0.7 else 0.005
                for name, g in grad.items():
                    m[name] = 0.9 * m[name] + 0.1 * g
                    s[name] = 0.99 * s[name] + 0.01 * g**2
                    self.p[name] -= rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(s[name] / (1 - 0.99**step)) + 1e-6)

    def label(self, pages: list) -> list[np.ndarray]:
        """Of each page's blocks whether they are main text."""
        x = features(pages)
        ends = np.cumsum([len(p) for p in pages]) if pages else np.zeros(0, int)
        out: list = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            # about 20000 cells at once, however long the longest page is
            n = max(1, min(256, 20_000 // max(1, len(pages[order[min(at + 255, len(order) - 1)]]))))
            ids = order[at : at + n]
            at += n
            seqs = [(x[ends[k] - len(pages[k]) : ends[k]], np.zeros(len(pages[k]), np.float32)) for k in ids]
            xs, mask, _ = padded(seqs)
            z = self.logits(xs, mask)[0]
            for col, k in enumerate(ids):
                out[k] = z[: len(pages[k]), col] > 0
        return out


def padded(sequences: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t = max(len(s[0]) for s in sequences)
    x = np.zeros((t, len(sequences), DIM), np.float32)
    mask, y = np.zeros((t, len(sequences)), np.float32), np.zeros((t, len(sequences)), np.float32)
    for k, (a, b) in enumerate(sequences):
        x[: len(a), k], mask[: len(a), k], y[: len(a), k] = a, 1, b
    return x, mask, y


#: Sectioning of generated pages; each noise section as path of tag and class words.
MAIN_PATHS = [["article"], ["main"], ["main", "article"], ["div.content"], ["div.main"], ["div.article"], ["div.post"], ["section.story"], ["div.entry content"], ["div.container", "article"], ["div.wrapper", "div.article body"], ["div.page", "main.content", "article.post"]]
MAIN_LEAVES = ["p", "p", "p", "p", "p", "p", "h2", "h3", "blockquote", "ul/li", "ol/li", "pre", "figure/figcaption", "table/tbody/tr/td", "div", "section/p"]
NOISE_BEFORE = [["nav", "ul", "li"], ["header"], ["header", "nav", "ul", "li"], ["div.nav", "ul", "li"], ["div.menu", "ul", "li"], ["div.header"], ["div.banner"], ["div.ad"], ["div.breadcrumb"], ["div.cookie notice", "p"], ["div.notice"], ["div.alert"], ["div.consent", "p"], ["form.search", "label"], ["ul.menu", "li"], ["div.topbar"], ["div.ads"], ["div.advert"], ["aside.ad"]]
NOISE_AFTER = [["footer"], ["footer", "p"], ["footer", "ul", "li"], ["aside", "p"], ["aside", "ul", "li"], ["aside.sidebar", "h3"], ["div.sidebar", "ul", "li"], ["div.sidebar", "p"], ["div.footer"], ["section.comments", "p"], ["div.comments", "div.comment", "p"], ["section.comments", "h2"], ["ol.comment list", "li.comment", "p"], ["div.related", "ul", "li"], ["form", "p"], ["form.newsletter", "label"], ["form", "button"], ["form.comment form", "label"], ["div.ad"], ["div.sponsored", "p"], ["div.promo"], ["div.newsletter", "p"], ["div.share", "a"], ["div.social"], ["nav.pagination"], ["div.copyright"], ["div.widget", "p"], ["aside"], ["div.cookie banner", "p"], ["div.subscribe", "p"], ["div.notice", "p"]]
NOISE_INSIDE = [["div.ad"], ["aside", "p"], ["div.related", "ul", "li"], ["div.share"], ["section.comments", "p"], ["div.comments", "p"], ["div.comment", "p"], ["form", "p"], ["div.advert"], ["aside.sidebar", "p"], ["div.newsletter", "p"], ["nav", "ul", "li"], ["header", "nav", "a"], ["footer", "p"], ["div.promo"], ["div.notice"]]


def _path(steps: list[str]) -> tuple[int, int]:
    stack = _Stack()
    for s in steps:
        tag, _, names = s.partition(".")
        stack.push(tag, f'class="{names}"' if names else "")
    return stack.paths[-1]


def generated(n: int, seed: int = 1) -> list[tuple[list, np.ndarray]]:
    """n pages as (blocks, labels)."""
    rnd = np.random.default_rng(seed)
    pick = lambda x: x[int(rnd.integers(len(x)))]

    def words(lo: int, hi: int) -> str:
        k = int(rnd.integers(lo, hi + 1))
        return " ".join("".join(chr(97 + c) for c in rnd.integers(0, 26, int(rnd.integers(2, 9)))) for _ in range(k))

    def noise(paths: list, base: list[str]) -> list:
        path, k = pick(paths), int(rnd.integers(1, 6))
        listed = "li" in path
        text = [words(1, 4) if listed else words(1, int(pick([4, 15, 60]))) for _ in range(k if listed or path[-1] == "p" else 1)]
        linked = listed or rnd.random() < 0.2
        return [(_path(["html", "body", *base, *path]), t, len(t) if linked else 0, 0) for t in text]

    out = []
    for _ in range(n):
        page = []
        for _ in range(int(rnd.integers(0, 4))):
            page += noise(NOISE_BEFORE, [])
        # now and then the page is wrapped, with its noise beside the main part
        base = pick(MAIN_PATHS)
        if rnd.random() < 0.9:
            page.append((_path(["html", "body", *base, *pick([["h1"], ["h1"], ["header", "h1"]])]), words(1, 12), 0, 1))
        for _ in range(int(pick([0, 1, 3, 6, 10, 20]))):
            leaf = pick(MAIN_LEAVES).split("/")
            t = words(1, int(pick([3, 12, 60, 120])))
            page.append((_path(["html", "body", *base, *leaf]), t, len(t) // 3 if rnd.random() < 0.1 else 0, 1))
            if rnd.random() < 0.08:
                page += noise(NOISE_INSIDE, base)
        if rnd.random() < 0.3:
            page += noise(NOISE_INSIDE, base)
        for _ in range(int(rnd.integers(0, 5))):
            page += noise(NOISE_AFTER, [])
        if page:
            out.append(([b[:3] for b in page], np.array([b[3] for b in page], np.float32)))
    return out


@functools.cache
def labeller() -> BiLstm:
    model = BiLstm()
    made = generated(PAGES)
    x = features([p for p, _ in made])
    ends = np.cumsum([len(p) for p, _ in made])
    model.train([(x[e - len(y) : e], y) for e, (_, y) in zip(ends, made, strict=True)])
    return model


def main_text(model: BiLstm, pages: list[str]) -> list[tuple[str, int, int]]:
    """(text, blocks, main blocks) of each page."""
    parsed = [blocks(p) for p in pages]
    return [("\n\n".join(b[1] for b, m in zip(p, own, strict=True) if m), len(p), int(own.sum())) for p, own in zip(parsed, model.label(parsed), strict=True)]


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_main) for every row of pages(page_id, url, html)."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    model = pages.sparkSession.sparkContext.broadcast(labeller())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, 400):
                part = batch.slice(at, 400)
                got = main_text(model.value, [h or "" for h in part.column(2).to_pylist()])
                cols = [pa.array([g[0] for g in got], pa.string()), pa.array([len(g[0]) for g in got], pa.int64())]
                cols += [pa.array([g[k] for g in got], pa.int64()) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols], names=["page_id", "url", "text", "n_chars", "n_blocks", "n_main"])

    return pages.mapInArrow(run, TEXTS)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
