"""Word and shingle hashes of whole Arrow string columns, vectorised over their buffers.

Words are hashed by a polynomial over their bytes, taken from prefix sums modulo 2**64, so
no Python object is made for a word. Texts are worked through in segments that end at a
break; temporaries are bounded by the segment, not by the text or the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SEGMENT = 1 << 18
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: All ASCII but digits and letters: what is left are words of a-z, 0-9 and non-ASCII characters.
NON_WORD = np.zeros(256, bool)
NON_WORD[:128] = True
NON_WORD[48:58] = NON_WORD[65:91] = NON_WORD[97:123] = False
_BASE = 0x9E3779B97F4A7C15
_pow = _inv = np.ones(1, U)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit integers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, SEGMENT + (1 << 16))
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            a = np.full(size, U(base))
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        _pow, _inv = out
    return _pow, _inv


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets; null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    if not wide and not pa.types.is_string(col.type):
        col, wide = col.cast(pa.large_string()), True
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if offs else np.zeros(len(col) + 1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), o


def _end(buf: np.ndarray, offs: np.ndarray, at: int, breaks: np.ndarray) -> int:
    """The first break at ``at`` or later: a break character or the start of a row."""
    row = int(offs[np.searchsorted(offs, at)])
    while at < row:
        hit = np.flatnonzero(breaks[buf[at : min(at + 65536, row)]])
        if len(hit):
            return at + int(hit[0])
        at = min(at + 65536, row)
    return row


def word_hashes(buf: np.ndarray, offs: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased (A-Z) words in order, and the number of words before each row."""
    first, last = int(offs[0]), int(offs[-1])
    hashes, rows, s = [], [], first
    while s < last:
        e = last if last - s <= SEGMENT else _end(buf, offs, s + SEGMENT, breaks)
        b = buf[s:e]
        n = len(b)
        inside = ~breaks[b]
        fresh = np.zeros(n + 1, bool)
        fresh[0] = fresh[n] = True
        fresh[offs[np.searchsorted(offs, s) : np.searchsorted(offs, e)] - s] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | fresh[1:n]
        ends = inside
        ends[:-1] &= ~inside[1:] | fresh[1:n]
        st, en = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        power, inverse = _powers(n)
        total = np.empty(n + 1, U)
        total[0] = 0
        np.cumsum((LOWER[b].astype(U) + U(1)) * power[:n], out=total[1:])
        hashes.append(mix((total[en] - total[st]) * inverse[st]))
        rows.append(np.searchsorted(offs, s + st, "right") - 1)
        s = e
    h = np.concatenate(hashes) if hashes else np.zeros(0, U)
    r = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    return h, np.concatenate([[0], np.cumsum(np.bincount(r, minlength=len(offs) - 1))]).astype(np.int64)


def shingle_hashes(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``width`` words, row by row; a row with fewer words is one window.

    Returns them with the number of windows before each row.
    """
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    starts = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(int(starts[-1]), U)
    if len(out):
        at = np.repeat(first[:-1] - starts[:-1], count) + np.arange(len(out))
        for j in range(width):
            idx = at + j
            ok = idx < np.repeat(first[1:], count)
            word = np.where(ok, h[np.minimum(idx, len(h) - 1)], U(0x5851F42D4C957F2D))
            out = mix(out * U(0x2545F4914F6CDD1D) + word + U(j + 1))
    return out, starts


def blocks(col: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``size`` bytes: first row, end row, bytes, offsets."""
    buf, offs = raw(col)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        j = min(j, n)
        yield i, j, buf, offs[i : j + 1]
        i = j
