"""Vectorised kernels over Arrow string columns: word spans and 64-bit hashes straight from
the UTF-8 buffer, without a Python object per word. Null texts count as empty."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a single longer text is still handled whole.
CHUNK = 1 << 21

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes outside words of letters and digits: all ASCII but 0-9, A-Z, a-z.
PUNCT = np.ones(256, bool)
PUNCT[128:] = False
for _lo, _hi in ((48, 57), (65, 90), (97, 122)):
    PUNCT[_lo : _hi + 1] = False
#: As PUNCT, with the digits outside too.
NOT_LETTER = PUNCT.copy()
NOT_LETTER[48:58] = True

_G = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x + _G
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


BYTE_CODE = mix(np.arange(256, dtype=np.uint64) * np.uint64(7919))
FOLDED_CODE = BYTE_CODE.copy()
FOLDED_CODE[65:91] = BYTE_CODE[97:123]

_BASE = 0x5851F42D4C957F2D
_INV = np.uint64(pow(_BASE, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        for k, base in enumerate((np.uint64(_BASE), _INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def prefix_code(data: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Prefix sums from which span_hash() takes the polynomial of any span."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(code[data] * powers(len(data))[1], out=out[1:])
    return out


def span_poly(prefix: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return (prefix[e] - prefix[s]) * powers(len(prefix))[0][s]


def span_hash(prefix: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return mix(span_poly(prefix, s, e) + (e - s).astype(np.uint64) * _M2)


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def chunks(data: np.ndarray, off: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about limit bytes: (first row, row after the last, bytes, offsets)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1))
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def word_spans(data: np.ndarray, off: np.ndarray, outside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text and, last, the number of words). Words are
    maximal runs of bytes not in outside, and never cross texts."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~outside[data]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    s = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    e = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    return s, e, np.searchsorted(s, off)


_MULT = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def ngram_hash(w: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive entries of w, len(w) - n + 1 of them."""
    m = max(0, len(w) - n + 1)
    h = np.full(m, n, np.uint64)
    for k in range(n):
        h += w[k : k + m] * _MULT[k]
    return mix(h)


def starts_within(woff: np.ndarray, n: int) -> np.ndarray:
    """Positions at which n words of one text begin."""
    total = int(woff[-1])
    ok = np.zeros(total + 1, np.int32)
    first, last = woff[:-1], np.maximum(woff[1:] - n + 1, woff[:-1])
    np.add.at(ok, first, 1)
    np.add.at(ok, last, -1)
    return np.flatnonzero(np.cumsum(ok)[:total] > 0)


def to_int64(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
