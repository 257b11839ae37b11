"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import kernels as K
from weftgraph.llm.common import bounded_sample, fold, labelled_ids, map_batches, map_groups, pieces, sampled_texts
from weftgraph.runtime import ship_package

#: Examples in a block, and neighbours that vote.
BLOCK_DOCS, NEIGHBOURS = 64, 15
#: A term held by more than this share of the examples has its postings stored as dense rows.
DENSE = 0.05
#: Least log-likelihood gain for a term to weigh more; chance gives none of a hundred thousand terms this much.
LEAST_GAIN = 11
#: Such a term's share of toxic examples is also so many times its share of the others: long texts hold every common word.
LEAST_ODDS = 20
#: Terms of a chunk of the document counts.
COUNT_CHUNK = 1 << 16
_MARKS = np.zeros(256, bool)
_MARKS[list(b".,;:!?\"'()[]{}*#$%&|<>-_")] = True


def terms(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(term hashes, first term of each text + total).

    The terms of a word are the word and, if it is longer, its first four and first five bytes: stems
    of inflected words. Case and marks do not count. A missing stem is 0.
    """
    data, off = K.text_bytes(col)
    keep = np.flatnonzero(~_MARKS[data])
    d = data[keep]
    h, s, e, first = K.words(d, np.searchsorted(keep, off))
    out = np.zeros((len(h), 3), np.uint64)
    out[:, 0] = h
    if len(h):
        stem = np.zeros(len(h), np.uint64)
        for i in range(5):
            stem = (stem << K.U64(8)) | K._LOWER[d[np.minimum(s + i, len(d) - 1)]].astype(np.uint64)
            if i >= 3:
                out[:, i - 2] = np.where(e - s > i + 1, K.mix64(stem + K.U64((i + 1) << 56)), 0)
    return out.ravel(), first * 3


def _counts(h: np.ndarray, first: np.ndarray, vocabulary: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term number, count) of the vocabulary's terms in each text; ``seen``: see ``_marks``."""
    if not len(vocabulary) or not len(h):
        return (np.zeros(0, np.int64),) * 3
    hit = np.flatnonzero(seen[(h & K.U64(len(seen) - 1)).astype(np.int64)])
    at = np.minimum(np.searchsorted(vocabulary, h[hit]), len(vocabulary) - 1)
    same = vocabulary[at] == h[hit]
    hit, at = hit[same], at[same]
    row = np.searchsorted(first, hit, "right") - 1
    key, n = np.unique(row * np.int64(len(vocabulary)) + at, return_counts=True)
    return key // len(vocabulary), key % len(vocabulary), n


def _marks(vocabulary: np.ndarray) -> np.ndarray:
    """Which low 22 bits occur among the vocabulary's hashes: spares a search for most unknown terms."""
    seen = np.zeros(1 << 22, bool)
    seen[(vocabulary & K.U64((1 << 22) - 1)).astype(np.int64)] = True
    return seen


class BlockMaxIndex:
    """Postings of unit-length TF-IDF vectors over all terms of the examples, in blocks of examples with the largest weight of each term.

    ``rows, terms, weights``: entries of the examples' vectors. Rare terms have posting lists, whose products are summed
    exactly; the postings of terms that many examples hold are dense rows of each block. A block is visited only if its largest
    sum over rare terms plus the sum of query weight times block maximum over the others can beat the worst of
    the best k: the k best cosines are exact.
    """

    def __init__(self, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray, n_rows: int, n_terms: int):
        held = np.bincount(terms, minlength=n_terms)
        self.n = n_rows
        self.common = np.flatnonzero(held > max(DENSE * n_rows, 8))
        number = np.full(n_terms, -1, np.int32)
        number[self.common] = np.arange(len(self.common))
        self.number = number
        dense = np.zeros((len(self.common), n_rows), np.float32)
        is_common = number[terms] >= 0
        dense[number[terms[is_common]], rows[is_common]] = weights[is_common]
        self.cut = np.append(np.arange(0, n_rows, BLOCK_DOCS), n_rows)
        self.blocks = [np.ascontiguousarray(dense[:, a:b]) for a, b in zip(self.cut, self.cut[1:])]
        self.top = np.stack([b.max(axis=1) for b in self.blocks], 1) if len(self.blocks) else np.zeros((len(self.common), 0), np.float32)
        order = np.lexsort((rows[~is_common], terms[~is_common]))
        self.doc, self.weight = rows[~is_common][order].astype(np.int32), weights[~is_common][order].astype(np.float32)
        self.start = np.searchsorted(terms[~is_common][order], np.arange(n_terms + 1))

    def nearest(self, row: np.ndarray, t: np.ndarray, w: np.ndarray, queries: int, k: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(queries, k) positions and cosines of the nearest examples, by falling cosine, ties by position; -1 and 0 beyond the last.

        ``row, t, w``: entries of the query vectors. ``skip``: an example that each query passes over.
        """
        common = self.number[t] >= 0
        q = np.zeros((queries, len(self.common)), np.float32)
        q[row[common], self.number[t[common]]] = w[common]
        r, t, w = row[~common], t[~common], w[~common]
        many = self.start[t + 1] - self.start[t]
        at = np.repeat(self.start[t] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        rare = np.bincount(np.repeat(r, many) * self.n + self.doc[at], np.repeat(w, many) * self.weight[at], minlength=queries * self.n).reshape(queries, self.n).astype(np.float32)
        if skip is not None:
            rare[np.arange(queries), skip] = -np.inf
        bound = q @ self.top + np.maximum.reduceat(rare, self.cut[:-1], axis=1)
        best_s, best_i = np.zeros((queries, k), np.float32), np.full((queries, k), -1, np.int64)
        for b in np.argsort(-bound.sum(axis=0, where=np.isfinite(bound)), kind="stable"):
            go = np.flatnonzero((bound[:, b] > 0) & (bound[:, b] * (1 + 1e-6) >= best_s[:, -1]))
            if not len(go):
                continue
            lo, hi = self.cut[b], self.cut[b + 1]
            s = np.concatenate([best_s[go], rare[go, lo:hi] + q[go] @ self.blocks[b]], 1)
            i = np.concatenate([best_i[go], np.broadcast_to(np.arange(lo, hi), (len(go), hi - lo))], 1)
            i = np.where(s > 0, i, -1)
            order = np.lexsort((np.where(i < 0, self.n, i), -s), axis=1)[:, :k]
            best_s[go], best_i[go] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        return best_i, np.where(best_i >= 0, best_s, 0)


class ToxicityModel:
    """Vocabulary, term weights, the index of labelled examples, and a calibration curve."""

    def __init__(self, vocabulary: np.ndarray, idf: np.ndarray, rows: np.ndarray, terms: np.ndarray, counts: np.ndarray, y: np.ndarray, ids: np.ndarray, k: int = NEIGHBOURS):
        """``rows, terms, counts``: entries of the examples' term counts, by row. ``y, ids``: label and doc_id of each example."""
        self.vocabulary, self.seen, self.k = vocabulary, _marks(vocabulary), k
        self.factor = idf * relevance(terms, y[rows], y, len(vocabulary))
        self.prior = float(y.mean()) if len(y) else 0.0
        # examples of equal heaviest term share blocks, which makes the bounds tight
        w = self.weights(rows, terms, counts, len(y))
        heavy = np.zeros(len(y), np.int64)
        order = np.lexsort((-w, rows))
        lead = order[np.append(True, rows[order][1:] != rows[order][:-1])] if len(order) else order
        heavy[rows[lead]] = terms[lead]
        order = np.lexsort((ids, heavy))
        place = np.argsort(order)
        self.y, self.ids = y[order].astype(float), ids[order]
        rows = place[rows]
        self.index = BlockMaxIndex(rows, terms, w, len(y), len(vocabulary))
        raw = np.zeros(len(y))
        order = np.argsort(rows, kind="stable")
        rows, terms, w = rows[order], terms[order], w[order]
        at = np.searchsorted(rows, np.arange(len(y) + 1))
        for lo in range(0, len(y), 256):
            hi = min(lo + 256, len(y))
            part = slice(at[lo], at[hi])
            raw[lo:hi] = self.vote(*self.index.nearest(rows[part] - lo, terms[part], w[part], hi - lo, k, np.arange(lo, hi)))
        bare = np.isnan(raw)
        self.none = float(self.y[bare].mean()) if bare.any() else 0.0
        self.grid = np.linspace(0, 1, 11)
        self.value = self._calibrate(raw[~bare], self.y[~bare])

    def weights(self, row: np.ndarray, t: np.ndarray, n: np.ndarray, rows: int) -> np.ndarray:
        """Entries of unit vectors: (1 + ln count) * idf * relevance.

        Words that no example holds have no part in a cosine's numerator and make all cosines of a text smaller alike: neither
        its neighbours nor their relative closeness, which is what votes, depend on them, so they are left out of the length.
        """
        w = (1 + np.log(n)) * self.factor[t]
        return w / np.sqrt(np.maximum(np.bincount(row, w * w, minlength=rows), 1e-30))[row]

    def vote(self, i: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Share of toxic neighbours, each weighted by its squared cosine; nan without neighbours."""
        w = np.where(i >= 0, s.astype(float) ** 2, 0)
        total = w.sum(axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            return (w * self.y[i]).sum(axis=1) / total

    def _calibrate(self, raw: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Observed share of toxic examples by leave-one-out vote, monotone, with two pseudo-examples a bin at its middle."""
        b = np.clip(np.rint(raw * 10).astype(int), 0, 10)
        n = np.bincount(b, minlength=11)
        p = (np.bincount(b, y, minlength=11) + 2 * self.grid) / (n + 2)
        level = [[v, w, 1] for v, w in zip(p, n + 2.0)]
        i = 0
        while i + 1 < len(level):  # pool adjacent violators
            if level[i][0] > level[i + 1][0]:
                (a, m, c), (v, w, d) = level[i], level.pop(i + 1)
                level[i] = [(a * m + v * w) / (m + w), m + w, c + d]
                i = max(i - 1, 0)
            else:
                i += 1
        return np.concatenate([np.full(c, v) for v, _, c in level])

    def score(self, col: pa.Array) -> tuple[np.ndarray, list[list[int]]]:
        h, first = terms(col)
        row, t, n = _counts(h, first, self.vocabulary, self.seen)
        w = self.weights(row, t, n, len(col))
        cut = np.searchsorted(row, np.arange(len(col) + 1))
        out, evidence = np.full(len(col), self.none), [[] for _ in range(len(col))]
        if not len(self.y):
            return out, evidence
        for lo in range(0, len(col), 256):
            hi = min(lo + 256, len(col))
            part = slice(cut[lo], cut[hi])
            i, s = self.index.nearest(row[part] - lo, t[part], w[part], hi - lo, self.k)
            v = self.vote(i, s)
            known = ~np.isnan(v)
            out[lo:hi][known] = np.interp(v[known], self.grid, self.value)
            for q in np.flatnonzero(known).tolist():
                evidence[lo + q] = self.ids[i[q, :5][i[q, :5] >= 0]].tolist()
        return np.clip(out, 0, 1), evidence


def relevance(terms: np.ndarray, of: np.ndarray, y: np.ndarray, n_terms: int) -> np.ndarray:
    """Factor of each term's weight: 1, and more for terms that mark toxic examples beyond chance.

    1 + the log-likelihood gain of the term's presence above LEAST_GAIN, if the term is commoner among toxic examples by
    LEAST_ODDS. Plain TF-IDF lets whole long texts resemble each other by their ordinary words: on 1,344 held-out
    documents its neighbours found 36 of 144 toxic ones at a vote of 0.7, with this factor 123 (3 of 1,200 others).
    """
    pos, neg = float((y == 1).sum()), float((y == 0).sum())
    k = np.bincount(terms, minlength=n_terms).astype(float)
    a = np.bincount(terms, of, minlength=n_terms)
    if not pos or not neg:
        return np.ones(n_terms)
    b, expect = k - a, k * pos / (pos + neg)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = a * np.log((a + 1e-9) / expect) + b * np.log((b + 1e-9) / (k - expect))
    marks = (k > 0) & (a / pos > LEAST_ODDS * (b + 0.5) / neg)
    return 1 + np.where(marks, np.maximum(gain - LEAST_GAIN, 0), 0)


def _terms_of(df: DataFrame) -> DataFrame:
    """(doc_id, y, terms, counts) of each text: 64-bit hashes and 32-bit counts, as bytes."""

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        h, first = terms(b.column(2))
        t, n = [], []
        for r in range(b.num_rows):
            u, c = np.unique(h[first[r] : first[r + 1]], return_counts=True)
            t.append(u[u != 0].tobytes()), n.append(c[u != 0].astype(np.int32).tobytes())
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(t, pa.binary()), pa.array(n, pa.binary())], ["doc_id", "y", "t", "n"])

    return map_batches(df, fn, "doc_id long, y int, t binary, n binary")


def document_counts(docs: DataFrame, vocabulary: np.ndarray) -> tuple[int, np.ndarray]:
    """(documents, documents that hold each term), over every row of docs.

    A task counts all its texts and returns its counts in chunks of COUNT_CHUNK terms; the chunks are
    added up in Spark, so the driver gets one number a term of the bounded vocabulary.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows, seen = np.zeros(len(shared.value), np.int64), 0, _marks(shared.value)
        for batch in it:
            for b in pieces(batch):
                h, first = terms(b.column(0))
                total += np.bincount(_counts(h, first, shared.value, seen)[1], minlength=len(total))
                rows += b.num_rows
        if rows:
            cut = range(0, len(total), COUNT_CHUNK)
            chunks = [np.array([rows]).tobytes(), *(total[i : i + COUNT_CHUNK].tobytes() for i in cut)]
            yield pa.RecordBatch.from_arrays([pa.array([-1, *(i // COUNT_CHUNK for i in cut)], pa.int32()), pa.array(chunks, pa.binary())], ["chunk", "n"])

    def add(t: pa.Table) -> pa.RecordBatch:
        sums: dict[int, np.ndarray] = {}
        for c, n in zip(t.column("chunk").to_pylist(), t.column("n").to_pylist()):
            n = np.frombuffer(n, np.int64)
            sums[c] = sums[c] + n if c in sums else n
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["chunk", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text"))
    got = dict(map_groups(rows.mapInArrow(count, "chunk int, n binary"), ["chunk"], add, "chunk int, n binary").collect())
    out = np.zeros(len(vocabulary), np.int64)
    for c, n in got.items():
        if c >= 0:
            out[c * COUNT_CHUNK : c * COUNT_CHUNK + len(n) // 8] = np.frombuffer(n, np.int64)
    return int(np.frombuffer(got[-1], np.int64)[0]) if -1 in got else 0, out


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1500, modulus: int = 3, held: int = 1) -> ToxicityModel:
    """Index about ``per_class`` labelled documents of each class from outside the held-out fold (the bound).

    The vocabulary is every term of those examples. Document frequencies behind the weights are counted over every document.
    """
    chosen = bounded_sample(labelled_ids(labels, "toxic", modulus, held), "y", "doc_id", per_class)
    got = sorted((r["doc_id"], r["y"], bytes(r["t"]), bytes(r["n"])) for r in _terms_of(sampled_texts(docs, chosen).select("doc_id", "y", "text")).collect())
    ids, y = np.array([r[0] for r in got], np.int64), np.array([r[1] for r in got], float)
    if len(set(y.tolist())) < 2:
        model = ToxicityModel(*(np.zeros(0, k) for k in (np.uint64, float, np.int64, np.int64, np.int64, float, np.int64)))
        model.none = 1.0 if len(y) and y[0] else 0.0
        return model
    rows = np.repeat(np.arange(len(got)), [len(r[2]) // 8 for r in got])
    t, n = np.frombuffer(b"".join(r[2] for r in got), np.uint64), np.frombuffer(b"".join(r[3] for r in got), np.int32)
    del got
    vocabulary, t = np.unique(t, return_inverse=True)
    total, freq = document_counts(docs, vocabulary)
    return ToxicityModel(vocabulary, np.log((1 + total) / (1 + freq)) + 1, rows, t, n, y, ids)


def score_toxicity(docs: DataFrame, labels: DataFrame | None = None, model: ToxicityModel | None = None, threshold: float = 0.7, modulus: int = 3, held: int = 1, **bounds) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) for every row; evidence: the nearest examples' ids.

    A text without any term of an example (null and empty ones too) has no neighbour; it gets the share of toxic
    among such examples, 0 if there is none. Repeated rows get equal results, null ids are kept, labels other
    than 0 and 1 are ignored; with one class of labels only, that class is the score. Other columns are ignored.
    """
    model = model or train(docs, labels, modulus=modulus, held=held, **bounds)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), modulus) == held).alias("held_out"), F.col("text").cast("string").alias("text"))

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        s, ev = shared.value.score(b.column(2))
        cols = [b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32)), pa.array(ev, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "score", "predicted", "evidence"])

    return map_batches(rows, fn, "doc_id long, held_out boolean, score double, predicted int, evidence array<bigint>")
