"""Vectorised words and word hashes over a column of texts.

A word is a run of ASCII letters, ASCII digits, ``_`` and non-ASCII characters, after Unicode lower-casing; Latin-1
signs (U+0080 to U+00BF but for the letters ª µ º), general punctuation (U+2000 to U+206F) and CJK signs (U+3000 to
U+303F) part words. Characters of three-byte CJK and kana blocks are words of their own. Words get 64-bit hashes:
a polynomial over the bytes, modulo 2**64, taken from one running sum, then mixed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from textloom.llm._common import offsets_of

U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_PI = pow(_P, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (three xor-shifts and two products)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
_WORD = np.zeros(256, bool)
for _c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_":
    _WORD[_c] = True
_WORD[128:] = True
_pow = [np.ones(1, U), np.ones(1, U)]
_KEPT = 1 << 19  # powers that a worker keeps


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) >= n:
        return _pow[0][:n], _pow[1][:n]
    both = []
    for p in (_P, _PI):
        a = np.full(n, p, U)
        a[0] = 1
        both.append(np.multiply.accumulate(a, out=a))
    if n <= _KEPT:  # those of a longer text go with it
        _pow[:] = both
    return both[0], both[1]


def text_bytes(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column (null: empty) and the offsets of its rows."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if lower:
        column = pc.utf8_lower(column)
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = offsets_of(column)
    return np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]], off - off[0]


@dataclass
class Words:
    """Words in order; ``ptr[i]:ptr[i+1]`` are those of unit i; starts and ends are byte places in ``data``."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ptr: np.ndarray
    data: np.ndarray
    inside: np.ndarray  # which bytes belong to words

    def unit(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))


def words_of(data: np.ndarray, off: np.ndarray) -> Words:
    """Words of the units data[off[i]:off[i+1]]; no word spans two units."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(np.zeros(0, U), z, z, np.zeros(len(off), np.int64), data, np.zeros(0, bool))
    w = _WORD[data]
    i = np.flatnonzero(data[: n - 1] == 0xC2)
    if len(i):
        bad = i[~np.isin(data[i + 1], (0xAA, 0xB5, 0xBA))]
        w[bad] = w[bad + 1] = False
    i = np.flatnonzero((data[: max(0, n - 2)] == 0xE2) | (data[: max(0, n - 2)] == 0xE3))
    if len(i):
        b1, b2 = data[i + 1], data[i + 2]
        bad = i[np.where(data[i] == 0xE2, (b1 == 0x80) | ((b1 == 0x81) & (b2 <= 0xAF)), b1 == 0x80)]
        w[bad] = w[bad + 1] = w[bad + 2] = False
    edge = off[(off > 0) & (off < n)]
    first = w.copy()
    first[1:] &= ~w[:-1]
    first[edge] = w[edge]
    last = w.copy()
    last[:-1] &= ~w[1:]
    last[edge - 1] = w[edge - 1]
    cjk = np.flatnonzero((data >= 0xE3) & (data <= 0xE9) & w)
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if len(cjk):
        first[cjk] = True
        after = cjk[cjk + 3 < n] + 3
        first[after] |= w[after]
        start = np.flatnonzero(first)
        end = np.minimum(end[np.searchsorted(end, start, "right")], np.append(start[1:], n))
    p, q = _powers(n + 1)
    v = _BYTE[data]
    v *= p[:n]
    run = np.empty(n + 1, U)
    run[0] = 0
    np.cumsum(v, out=run[1:])
    h = mix((run[end] - run[start]) * q[start])
    return Words(h, start, end, np.searchsorted(start, off, "left"), data, w)


K = 5
_MUL = U(0xA0761D6478BD642F)


def shingles_of(w: Words, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k words running, in order, and the unit of each. A unit of 1 to k-1 words has one shingle of them all."""
    unit, h, n = w.unit(), w.hash, len(w.hash)
    count = np.diff(w.ptr)
    if n >= k:
        s = h[: n - k + 1].copy()
        for j in range(1, k):
            s *= _MUL
            s += h[j : n - k + 1 + j]
        ok = unit[: n - k + 1] == unit[k - 1 :]
        s, u = mix(s[ok]), unit[: n - k + 1][ok]
    else:
        s, u = np.zeros(0, U), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        t = np.zeros(len(short), U)
        for j in range(k - 1):
            has = count[short] > j
            t[has] = t[has] * _MUL + h[w.ptr[short[has]] + j] + U(1)
        s, u = np.concatenate([s, mix(t)]), np.concatenate([u, short])
        order = np.argsort(u, kind="stable")
        s, u = s[order], u[order]
    return s, u
