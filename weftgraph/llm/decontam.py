"""Benchmark decontamination: CGK embeddings of item-sized windows, bit-sampling LSH, exact edit verification."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import kernels as K
from weftgraph.llm.common import map_batches
from weftgraph.runtime import materialize

#: Most bytes of benchmark text that travel to the tasks at once; a larger benchmark takes several passes.
ITEM_BYTES = 8 << 20
_WORDY = np.zeros(256, bool)
_WORDY[48:58] = _WORDY[65:91] = _WORDY[97:123] = _WORDY[128:] = True
_KEEP = _WORDY | K._SPACE
_END = K.U64(0x9E6C63D0876A9A47)


@dataclass(frozen=True)
class Limits:
    """``edits``: most word edits, as a share of the item's words. ``tables`` keys of ``samples`` embedded positions each.

    ``tables`` is set from measured recall: items with the most edits allowed, of 8 to 120 words, are found by 24 keys
    of two positions in all of 200 trials a length; 32 leave some room. Positions lie within the first
    2 * ``reach`` * n steps of a walk over n words, which is where a walk ends.
    """

    edits: float = 0.2
    tables: int = 32
    samples: int = 2
    reach: float = 0.9


def normal_words(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, byte start, byte end, first word of each text + total, bytes, offsets of the texts) of words without marks and case.

    Punctuation inside or around a word is dropped, letters are lowered in ASCII and Latin-1. Positions count from the first text.
    """
    data, off = K.text_bytes(col)
    keep = np.flatnonzero(_KEEP[data])
    d = data[keep]
    if len(d) > 1:
        up = (d[:-1] == 0xC3) & (d[1:] >= 0x80) & (d[1:] <= 0x9E)
        d[1:][up] += 0x20
    new = np.searchsorted(keep, off)
    h, s, e, first = K.words(d, new)
    return h, keep[s] if len(s) else s, keep[e - 1] + 1 if len(e) else e, first, data, off


#: A cost above a start: both are below 2^31, the bytes of a text.
_START = np.int64(1 << 32)


def best_places(items: np.ndarray, texts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edits, start, end) of the cheapest place of each row of ``items`` (P, n) within its row of ``texts`` (P, m).

    Word edits: one for each word replaced, added or left out. Ties: the smallest start, then the smallest end. All
    rows advance together; a cell holds its cost and, below it, where its place starts. Rows above ``most`` get most + 1.
    """
    p, n = items.shape
    m = texts.shape[1]
    column = np.arange(m + 1, dtype=np.int64)
    cell = np.broadcast_to(column, (p, m + 1))
    for i in range(n):
        new = cell + _START  # the item's word is left out
        np.minimum(new[:, 1:], cell[:, :-1] + np.where(texts == items[:, i : i + 1], 0, _START), out=new[:, 1:])
        step = column * _START  # words added: the cheapest cell to the left, one edit a step
        cell = np.minimum.accumulate(new - step, axis=1) + step
    end = cell.argmin(axis=1)
    best = cell[np.arange(p), end]
    return np.minimum(best // _START, most + 1), best % _START, end


class Items:
    """Benchmark items of one block: CGK keys of every item, and the word n-grams that a window of an item's size must hold.

    Candidates come from the keys alone: a window of a text and an item of the window's size are compared
    if one of the tables' keys is equal. Windows are not embedded where no item of their size can match: an item of n words with at
    most e edits keeps at least n - g + 1 - g * e of its g-grams (each edit spoils g at most), and a window
    must hold so many grams of items of its size. That screen names no item and loses nothing.
    """

    def __init__(self, ids: list[int | None], col: pa.Array, limits: Limits):
        self.limits = limits
        h, _, _, first, _, _ = normal_words(col)
        n = np.diff(first)
        rows = np.flatnonzero(n > 0)
        self.ids, self.size = [ids[i] for i in rows], n[rows]
        self.words = [h[first[i] : first[i + 1]] for i in rows]
        g = np.random.default_rng(11)
        self.longest = int(self.size.max()) if len(rows) else 0
        self.coin = g.integers(1, 1 << 63, (limits.tables, 2 * self.longest), dtype=np.uint64) | K.U64(1)
        self.at = g.random((limits.tables, limits.samples)) * limits.reach
        one = lambda n: np.array([n], np.int64)
        keys = [self.keys(w, one(0), one(len(w)), one(len(w)))[0] for w in self.words]
        key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(key, kind="stable")
        self.key, self.of = key[order], np.repeat(np.arange(len(self.words)), limits.tables)[order]
        # for each size: the longest gram, up to three words, of which at least one must stay
        self.grams = {}
        found: dict[int, list] = {1: [], 2: [], 3: []}
        for size in np.unique(self.size):
            k, _, _ = self.rule(int(size))
            code = np.unique(np.concatenate([grams(self.words[i], k) for i in np.flatnonzero(self.size == size)]))
            found[k].append((code, np.full(len(code), size)))
        for k, parts in found.items():
            if parts:
                code, size = (np.concatenate(x) for x in zip(*parts))
                order = np.lexsort((size, code))
                seen = np.zeros(1 << 20, bool)
                seen[(code & K.U64((1 << 20) - 1)).astype(np.int64)] = True
                self.grams[k] = code[order], size[order], seen

    def rule(self, n: int) -> tuple[int, int, int]:
        """(words of a gram, grams that stay, most edits) of an item of n words."""
        e = int(n * self.limits.edits + 1e-9)
        k = 3 if n - 2 - 3 * e >= 1 else 2 if n - 1 - 2 * e >= 1 else 1
        return k, max(n - k + 1 - k * e, 1), e

    def keys(self, words: np.ndarray, start: np.ndarray, size: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """(P, tables) keys of the windows of ``size`` words from ``start``, which end at ``stop`` where the text is shorter.

        CGK walk: step j of a table copies the current word and moves on if the coin of (table, j, word) says so;
        beyond the window it copies an end mark. Two steps a word. A table's key takes the words copied at its sampled steps.
        Windows of one start share the walk, which does not depend on the window's end.
        """
        t = self.limits.tables
        out = np.zeros((len(start), t), np.uint64)
        begin, which = np.unique(start, return_inverse=True)
        take = np.floor(self.at[None] * (2 * size)[:, None, None]).astype(np.int64)  # (P, tables, samples)
        longest = np.zeros(len(begin), np.int64)
        np.maximum.at(longest, which, size)
        stop = np.minimum(stop, start + size)
        many = max(1, min(256, (1 << 20) // max(1, self.longest * t)))  # bounds the paths that are held at once
        for lo in range(0, len(begin), many):
            b = begin[lo : lo + many]
            steps = int(2 * longest[lo : lo + many].max())
            pos = np.repeat(b[:, None], t, axis=1)
            path = np.empty((steps, len(b), t), np.int64)
            for j in range(steps):
                path[j] = pos
                pos = pos + ((words[np.minimum(pos, len(words) - 1)] * self.coin[:, j]) >> K.U64(63)).astype(np.int64)
            rows = np.flatnonzero((which >= lo) & (which < lo + many))
            column = np.arange(t)
            for r in range(0, len(rows), 4096):
                q = rows[r : r + 4096]
                key = np.repeat(K.mix64(size[q].astype(np.uint64) * K.U64(0x9E3779B97F4A7C15))[:, None], t, axis=1) + column.astype(np.uint64)
                for s in range(take.shape[2]):
                    at = path[take[q, :, s], which[q, None] - lo, column]
                    c = np.where(at < stop[q][:, None], words[np.minimum(at, len(words) - 1)], _END)
                    key = K.mix64(key * K.U64(0xD6E8FEB86659FD93) + c + K.U64(s))
                out[q] = key
        return out

    def windows(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, start word, size) of the windows that hold enough grams of items of their size."""
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        out = []
        for k, (code, sizes, seen) in self.grams.items():
            if len(h) < k:
                continue
            g = grams(h, k)
            at = np.flatnonzero(seen[(g & K.U64((1 << 20) - 1)).astype(np.int64)] & (row[: len(g)] == row[k - 1 :]))
            lo, hi = np.searchsorted(code, g[at], "left"), np.searchsorted(code, g[at], "right")
            many = hi - lo
            size = sizes[np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())]
            at = np.repeat(at, many)
            order = np.lexsort((at, size))
            at, size = at[order], size[order]
            for n in np.unique(size):
                _, need, e = self.rule(int(n))
                p = at[np.searchsorted(size, n, "left") : np.searchsorted(size, n, "right")]
                if len(p) < need:
                    continue
                a, z = p[: len(p) - need + 1], p[need - 1 :]
                # a place of n + e words at most that holds all of a..z starts no earlier than ``from_`` and no later than a
                from_ = np.maximum(z - (n + e - k), first[row[a]])
                ok = (row[a] == row[z]) & (from_ <= a)
                a, from_ = a[ok], from_[ok]
                if len(a):
                    from_[1:] = np.maximum(from_[1:], np.minimum(a[:-1] + 1, a[1:] + 1))  # a rises: no start twice
                    many = np.maximum(a - from_ + 1, 0)
                    start = np.repeat(from_ - (np.cumsum(many) - many), many) + np.arange(many.sum())
                    out.append((row[start], start, np.full(len(start), n)))
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out))

    def candidates(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, start word), sorted and distinct: windows and items with an equal key in one of the tables."""
        r, start, size = self.windows(h, first)
        found = []
        for p in range(0, len(r), 8192):
            key = self.keys(h, start[p : p + 8192], size[p : p + 8192], first[r[p : p + 8192] + 1]).ravel()
            lo, hi = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
            many = hi - lo
            w = p + np.repeat(np.arange(len(key)) // self.limits.tables, many)
            item = self.of[np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())]
            found.append(np.unique((r[w] * len(self.words) + item) * len(h) + start[w]))
        c = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return c // len(h) // len(self.words), c // len(h) % len(self.words), c % len(h)

    def find(self, col: pa.Array) -> list[tuple[int, int, int, int, int]]:
        """(text, item, edits, start, end) of the best place of each item in each text; code points of the text, end exclusive."""
        h, s, e, first, data, off = normal_words(col)
        if not len(h) or not len(self.words):
            return []
        r, item, start = self.candidates(h, first)
        most = np.floor(self.size[item] * self.limits.edits + 1e-9).astype(np.int64)
        # a place is looked for up to ``most`` words around a candidate, which covers the candidates that follow it closely
        keep, last = [], (-1, -1, 0)
        for c in zip(r.tolist(), item.tolist(), start.tolist(), most.tolist()):
            if c[:2] != last[:2] or c[2] - last[2] > c[3]:
                keep.append(c)
                last = c[:3]
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        by_size: dict[int, list] = {}
        for c in keep:
            by_size.setdefault(int(self.size[c[1]]), []).append(c)
        for n, group in by_size.items():
            step = max(1, min(512, (1 << 15) // n))
            for p in range(0, len(group), step):
                part = group[p : p + step]
                text, it, at, most = (np.array(x) for x in zip(*part))
                left = np.maximum(at - most, first[text])
                place = left[:, None] + np.arange(n + 3 * int(most[0]))
                inside = place < first[text + 1][:, None]
                words = np.where(inside, h[np.minimum(place, len(h) - 1)], _END)
                cost, a, z = best_places(np.stack([self.words[i] for i in it]), words, int(most[0]))
                z = np.minimum(z, first[text + 1] - left)
                for t, i, c, u, v in zip(text.tolist(), it.tolist(), cost.tolist(), (left + a).tolist(), (left + z).tolist()):
                    if c <= most[0] and v > u and (c, u, v) < best.get((t, i), (1 << 30, 0, 0)):
                        best[t, i] = (c, u, v)
        lead = (data & 0xC0) != 0x80
        out = []
        for (t, i), (c, u, v) in sorted(best.items()):
            lo = int(lead[off[t] : s[u]].sum())
            out.append((t, i, c, lo, lo + int(lead[s[u] : e[v - 1]].sum())))
        return out


def grams(h: np.ndarray, k: int) -> np.ndarray:
    x = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        x = K.mix64(x * K.U64(0xE7037ED1A0B428DB) + h[j : len(h) - k + 1 + j])
    return x


def item_blocks(benchmark: DataFrame, limits: Limits = Limits()) -> Iterator[Items]:
    """The benchmark in blocks of at most ITEM_BYTES of text; a block is read when the one before it has been used."""
    b = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-2 * total // ITEM_BYTES))
    for k in range(blocks):
        rows = sorted((r["item_id"] is None, r["item_id"] or 0, r["text"]) for r in b.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect())
        if rows:
            yield Items([None if r[0] else r[1] for r in rows], pa.array([r[2] for r in rows]), limits)


def contaminated(docs: DataFrame, benchmark: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(doc_id, item_id, edits, item_words, start, end): the best place of each benchmark item in each document.

    A match has at most ``limits.edits`` of the item's words edited, in words without case and marks. Best: fewest
    edits, then the smallest start, then the smallest end. Positions are code points of the text, end exclusive. Null and empty
    texts, and items without words, match nothing; repeated rows repeat their matches, also rows of the benchmark; null
    ids of documents and items are kept; other columns are ignored. Each block of the benchmark is a pass over the documents, written
    before the next block is read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, edits int, item_words int, start long, end long"
    out = None
    for items in item_blocks(benchmark, limits):
        shared = spark.sparkContext.broadcast(items)

        def fn(b: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            it = shared.value
            got = [(b.column(0)[t].as_py(), it.ids[i], n, int(it.size[i]), lo, hi) for t, i, n, lo, hi in it.find(b.column(1))]
            cols = list(zip(*got)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "item_id", "edits", "item_words", "start", "end"])

        part = materialize(map_batches(rows, fn, schema), "matches")
        shared.destroy()
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows whose text holds no benchmark item, with all their columns.

    Null and empty texts hold none and stay; repeated rows stay or go together; null ids make no difference; items without
    words match nothing, and an empty benchmark keeps every row. Works in place, without a shuffle.
    """
    at = docs.columns.index("text")
    for k, items in enumerate(item_blocks(benchmark, limits)):
        if k:
            docs = materialize(docs, "clean")
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def fn(b: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            keep = np.ones(b.num_rows, bool)
            for m in shared.value.find(b.column(at)):
                keep[m[0]] = False
            return b.filter(pa.array(keep))

        docs = map_batches(docs, fn, docs.schema)
    return docs
