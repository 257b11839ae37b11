"""Vectorised helpers over the bytes of Arrow string columns, used inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x = x ^ (x >> U64(27))
    x = x * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, BLOCK)
        fresh = []
        for b in (U64(_BASE), U64(_INV)):
            x = np.full(n, b, U64)
            x[0] = 1
            fresh.append(np.cumprod(x, dtype=U64))
        _powers[:] = fresh
    return _powers[0], _powers[1]


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty."""
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = col.buffers()[2] if len(col) else None
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def blocks(off: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``size`` bytes; a longer row stands alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _hash_words(d: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words in d; first marks where a new row begins."""
    nd = ~_SPACE[d]
    st, en = nd.copy(), nd.copy()
    st[1:] &= ~nd[:-1] | first[1:]
    en[:-1] &= ~nd[1:] | first[1:]
    s, e = np.flatnonzero(st), np.flatnonzero(en) + 1
    p, q = _pow(len(d) + 1)
    cs = np.zeros(len(d) + 1, U64)
    np.cumsum(_BYTE[_LOWER[d]] * p[: len(d)], out=cs[1:])
    return mix64((cs[e] - cs[s]) * q[s] + (e - s).astype(U64)), s, e


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ASCII-lowered words: (hash, byte start, byte end, first word index of each row + total).

    Works through blocks of about a MB, so scratch memory does not follow a row's length.
    """
    hs, ss, es = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j in blocks(off):
        pos, stop = int(off[i]), int(off[j])
        marks = off[i:j]
        while pos < stop:
            end = min(stop, pos + 2 * BLOCK)
            if end < stop:  # only inside a single long row: cut at white space
                sp = np.flatnonzero(_SPACE[data[pos:end]])
                if len(sp):
                    end = pos + int(sp[-1]) + 1
                else:
                    more = np.flatnonzero(_SPACE[data[end:stop]])
                    end = end + int(more[0]) + 1 if len(more) else stop
            first = np.zeros(end - pos, bool)
            m = marks[(marks >= pos) & (marks < end)] - pos
            first[m] = True
            h, s, e = _hash_words(data[pos:end], first)
            hs.append(h), ss.append(s + pos), es.append(e + pos)
            pos = end
    start = np.concatenate(ss)
    return np.concatenate(hs), start, np.concatenate(es), np.searchsorted(start, off)


def shingle_set(w: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles; with fewer words the whole sequence is one."""
    if not len(w):
        return w
    if len(w) < k:
        x = np.full(1, 0xA0761D6478BD642F, U64)
        for h in w:
            x = mix64(x * U64(0xE7037ED1A0B428DB) + h)
        return x
    x = w[: len(w) - k + 1].copy()
    for i in range(1, k):
        x = mix64(x * U64(0xD6E8FEB86659FD93) + w[i : len(w) - k + 1 + i])
    return np.unique(x)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if not len(a) or not len(b):
        return 0
    if len(a) > len(b):
        a, b = b, a
    i = np.searchsorted(b, a)
    i[i == len(b)] = 0
    return int((b[i] == a).sum())


def min_hashes(s: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """Minimum of each of len(mul) hash functions over the set s."""
    best = np.full(len(mul), np.iinfo(np.uint64).max, U64)
    for i in range(0, len(s), 1024):
        x = (s[i : i + 1024, None] ^ add[None, :]) * mul[None, :]
        np.minimum(best, x.min(axis=0), out=best)
    return best


def hash_family(m: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    g = np.random.default_rng(seed)
    return g.integers(0, 1 << 63, m, dtype=np.uint64) * U64(2) + U64(1), g.integers(0, 1 << 63, m, dtype=np.uint64)
