"""Document quality from a linear-chain CRF over lines.

Every line is labelled good or bad from its own shape and that of its neighbours. The line labels are
latent: a document's label is seen through the share of its length on good lines, the sum of the
forward-backward marginals by line length, which also gives its score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import kernels as K
from weftgraph.llm.common import bounded_sample, fold, labelled_ids, map_batches, sampled_texts

N_SHAPE = 17
N_FEATURES = 3 * N_SHAPE + 3
#: Steepness of the document's probability over the share of its length on good lines.
SHARPNESS = 12.0


def _mask(chars: bytes) -> np.ndarray:
    m = np.zeros(256, bool)
    m[list(chars)] = True
    return m


_UPPER, _LOW = _mask(bytes(range(65, 91))), _mask(bytes(range(97, 123)))
_DIGIT, _END = _mask(b"0123456789"), _mask(b".!?:;")
_SYMBOL = _mask(b"#$%&*|<>{}[]~^=_+\\/@")
_BANG, _COMMA = _mask(b"!?"), _mask(b",;:.'\"()-")


def _ratio(mask: np.ndarray, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.add.reduceat(mask, lo, dtype=np.float64) / size


def line_shapes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shape features of each line, line length in bytes, first line of each text + total).

    Lines end at LF; an empty text has one empty line. Rows of ``data`` should hold a few MB at most
    together (a longer single text is fine, it only takes memory in proportion).
    """
    n = len(off) - 1
    row = np.repeat(np.arange(n), np.diff(off))
    nl = np.flatnonzero(data == 10)
    # a text that ends in LF gives an empty last line, which starts where the next text does
    owner = np.concatenate([np.arange(n), row[nl]])
    order = np.argsort(owner, kind="stable")
    starts, owner = np.concatenate([off[:-1], nl + 1])[order], owner[order]
    first = np.searchsorted(owner, np.arange(n + 1))
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    last = first[1:] - 1
    ends[last] = off[1:]
    ends = np.maximum(ends, starts)
    size = (ends - starts).astype(np.float64)
    full = size > 0
    f = np.zeros((len(starts), N_SHAPE), np.float32)
    f[:, 0] = np.log1p(size) / 6
    f[:, 1] = ~full
    if full.any():
        # line feeds never count: each line's sums run from its start to the next line's start
        lo, s = starts[full], size[full]
        space = K._SPACE[data]
        after = np.concatenate([[True], space[:-1]])
        after[lo] = True
        nw = np.add.reduceat(~space & after, lo, dtype=np.float64)
        nw = np.maximum(nw, 1)
        upper, low = _UPPER[data], _LOW[data]
        up = _ratio(upper, lo, s)
        f[full, 2] = up / np.maximum(up + _ratio(low, lo, s), 1e-9)
        f[full, 3] = up
        f[full, 4] = _ratio(_DIGIT[data], lo, s)
        f[full, 5] = np.minimum(np.add.reduceat(_BANG[data], lo, dtype=np.float64) / nw, 2)
        f[full, 6] = np.minimum(np.add.reduceat(_SYMBOL[data], lo, dtype=np.float64) / nw, 4)
        f[full, 7] = np.minimum(np.add.reduceat(data == 124, lo, dtype=np.float64) / nw, 1)
        f[full, 8] = np.minimum(np.add.reduceat(_COMMA[data], lo, dtype=np.float64) / nw, 2)
        f[full, 9] = np.minimum(s / nw / 10, 5)
        f[full, 10] = _ratio(data >= 128, lo, s)
        same = np.zeros(len(data), bool)
        same[1:] = data[1:] == data[:-1]
        same[lo] = False
        f[full, 11] = _ratio(same & ~space, lo, s)
        f[full, 12] = _END[data[ends[full] - 1]]
        # repeated words inside the line, repeated lines inside the text
        h, ws, _, _ = K.words(data, off)
        line = np.searchsorted(starts, ws, "right") - 1
        key = K.mix64(h + line.astype(np.uint64) * K.U64(0x9E3779B97F4A7C15))
        _, at = np.unique(key, return_index=True)
        f[:, 13] = np.bincount(line[at], minlength=len(starts)) / np.maximum(np.bincount(line, minlength=len(starts)), 1)
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
        f[:, 16] = np.bincount(line[again], minlength=len(starts)) / np.maximum(np.bincount(line, minlength=len(starts)), 1)
        total = np.zeros(len(starts), np.uint64)
        np.add.at(total, line, K.mix64(h + (np.arange(len(h)) - np.searchsorted(line, line)).astype(np.uint64)))
        pair = K.mix64(total + owner.astype(np.uint64) * K.U64(0xD6E8FEB86659FD93))
        _, inv, cnt = np.unique(pair, return_inverse=True, return_counts=True)
        f[:, 14] = (cnt[inv] > 1) & full
        f[:, 15] = np.log1p(np.bincount(line, minlength=len(starts))) / 5
    return f, np.maximum(size, 1), first


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own shape, shape of the line before and after (zero beyond the text), border marks and a constant."""
    f, size, first = line_shapes(data, off)
    x = np.zeros((len(f), N_FEATURES), np.float32)
    x[:, :N_SHAPE] = f
    head, tail = np.zeros(len(f), bool), np.zeros(len(f), bool)
    head[first[:-1]], tail[first[1:] - 1] = True, True
    x[1:, N_SHAPE : 2 * N_SHAPE] = f[:-1]
    x[:-1, 2 * N_SHAPE : 3 * N_SHAPE] = f[1:]
    x[head, N_SHAPE : 2 * N_SHAPE] = 0
    x[tail, 2 * N_SHAPE : 3 * N_SHAPE] = 0
    x[:, -3], x[:, -2], x[:, -1] = head, tail, 1
    return x, size, first


def _chains(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    return order, n[order]


def marginals(emit: np.ndarray, trans: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over all chains at once.

    ``emit``: (lines, 2) log potentials; ``trans``: (2, 2). Returns P(state) of each line,
    the summed pair marginals (2, 2), and each chain's log partition function.
    """
    order, n = _chains(first)
    base = first[:-1][order]
    alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
    t = 0
    while t < (n[0] if len(n) else 0):
        k = int(np.searchsorted(-n, -t, "left"))  # chains longer than t
        i = base[:k] + t
        alpha[i] = emit[i] if t == 0 else emit[i] + np.logaddexp(alpha[i - 1][:, :1] + trans[0], alpha[i - 1][:, 1:] + trans[1])
        t += 1
    for t in range(int(n[0]) - 2 if len(n) else -1, -1, -1):
        k = int(np.searchsorted(-n, -(t + 1), "left"))
        i = base[:k] + t
        g = beta[i + 1] + emit[i + 1]
        beta[i] = np.logaddexp(trans[:, 0] + g[:, :1], trans[:, 1] + g[:, 1:])
    end = first[1:] - 1
    z = np.logaddexp(alpha[end, 0], alpha[end, 1])
    zl = np.repeat(z, np.diff(first))
    p = np.exp(alpha + beta - zl[:, None])
    inner = np.ones(len(emit), bool)
    inner[first[:-1]] = False
    i = np.flatnonzero(inner)
    pair = np.array([[np.exp(alpha[i - 1, a] + trans[a, b] + emit[i, b] + beta[i, b] - zl[i]).sum() for b in (0, 1)] for a in (0, 1)])
    return p, pair, z


def link(share: np.ndarray, middle: float) -> np.ndarray:
    """Probability that a document is good, from the share of its length on good lines."""
    return 1 / (1 + np.exp(-SHARPNESS * (share - middle)))


class QualityModel:
    """Emission weights of the good state (the bad state's are their negative), transitions, and the share of good lines that is even odds."""

    def __init__(self, w: np.ndarray, trans: np.ndarray, middle: float = 0.5):
        self.w, self.trans, self.middle = w, trans, middle

    def line_probabilities(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, size, first = features(data, off)
        e = x @ self.w
        p, _, _ = marginals(np.stack([-e, e], 1).astype(np.float64), self.trans, first)
        return p[:, 1], size, first

    def score(self, col: pa.Array) -> np.ndarray:
        data, off = K.text_bytes(col)
        out = np.zeros(len(off) - 1)
        for i, j in K.blocks(off):
            lo, hi = int(off[i]), int(off[j])
            p, size, first = self.line_probabilities(data[lo:hi], off[i : j + 1] - lo)
            out[i:j] = np.add.reduceat(p * size, first[:-1]) / np.add.reduceat(size, first[:-1])
        return link(np.clip(out, 0, 1), self.middle)


def fit(x: np.ndarray, size: np.ndarray, first: np.ndarray, owner: np.ndarray, y: np.ndarray, rounds: int = 250, l2: float = 1e-4) -> QualityModel:
    """Adam steps over documents whose lines have no labels of their own.

    ``first``: first line of each chain + total; ``owner``: document of each chain; ``y``: label of each document. A document
    is seen only through ``link`` of its length-weighted marginals, both classes weighing alike, so a bad document's ordinary
    lines are free to stay good. The share's gradient is a covariance under the chain, which two
    forward-backward passes give: one with each good state a little likelier by its line's weight, one with it less likely.
    """
    w, step = np.zeros(x.shape[1]), 1e-4
    if not len(y) or y.min() == y.max():
        w[-1] = 3.0 if not len(y) or y[0] == 1 else -3.0
        return QualityModel(w, np.zeros((2, 2)))
    doc = np.repeat(owner, np.diff(first))
    weight = size / np.bincount(doc, size)[doc]
    balance = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    theta = np.concatenate([w, np.zeros(4), [0.5]])
    rate = np.append(np.full(len(theta) - 1, 0.1), 0.005)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        w, trans, middle = theta[:-5], theta[-5:-1].reshape(2, 2), theta[-1]
        e = x @ w
        emit = np.stack([-e, e], 1)
        p, _, _ = marginals(emit, trans, first)
        pull = (y - link(np.bincount(doc, p[:, 1] * weight), middle)) * SHARPNESS * balance
        most = np.abs(pull).max() + 1e-300
        nudge = np.stack([np.zeros(len(x)), step * (pull / most)[doc] * weight], 1)
        (up, up2, _), (down, down2, _) = marginals(emit + nudge, trans, first), marginals(emit - nudge, trans, first)
        scale = most / (2 * step)
        g = np.concatenate([2 * scale * ((up - down)[:, 1] @ x), scale * (up2 - down2).ravel(), [-pull.sum()]]) - l2 * np.append(theta[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return QualityModel(theta[:-5].copy(), theta[-5:-1].reshape(2, 2).copy(), float(theta[-1]))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1500, max_lines: int = 64, modulus: int = 5, held: int = 0) -> QualityModel:
    """Fit on about ``per_class`` labelled documents of each class from outside the held-out fold.

    Both bounds are parameters: the number of documents, and the lines that one document lends
    (when it has more, three runs of neighbouring lines: a third of ``max_lines`` from its start, middle and end, each a
    chain of its own). Line labels are latent: see ``fit``.
    """
    chosen = bounded_sample(labelled_ids(labels, "quality", modulus, held), "y", "doc_id", per_class)
    texts = sampled_texts(docs, chosen).select("doc_id", "y", "text")

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        data, off = K.text_bytes(b.column(2))
        x, size, first = features(data, off)
        out, sizes = [], []
        ids, y = [], []
        for k in range(b.num_rows):
            n, third = int(first[k + 1] - first[k]), max(1, max_lines // 3)
            runs = [(0, n)] if n <= max_lines else [(0, third), ((n - third) // 2, (n + third) // 2), (n - third, n)]
            for lo, hi in runs:
                ids.append(b.column(0)[k]), y.append(b.column(1)[k])
                out.append(x[first[k] + lo : first[k] + hi].astype(np.float16).tobytes())
                sizes.append(size[first[k] + lo : first[k] + hi].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(y, pa.int32()), pa.array(out, pa.binary()), pa.array(sizes, pa.binary())], ["doc_id", "y", "x", "size"])

    got = sorted((r["doc_id"], r["y"], bytes(r["x"]), bytes(r["size"])) for r in map_batches(texts, fn, "doc_id long, y int, x binary, size binary").collect())
    xs = [np.frombuffer(r[2], np.float16).reshape(-1, N_FEATURES).astype(np.float64) for r in got]
    first = np.concatenate([[0], np.cumsum([len(a) for a in xs])]).astype(int)
    x = np.concatenate(xs) if xs else np.zeros((0, N_FEATURES))
    _, at, owner = np.unique(np.array([r[0] for r in got], np.int64), return_index=True, return_inverse=True)
    return fit(x, np.frombuffer(b"".join(r[3] for r in got)), first, owner, np.array([r[1] for r in got], float)[at])


def score_quality(docs: DataFrame, labels: DataFrame | None = None, model: QualityModel | None = None, threshold: float = 0.3, modulus: int = 5, held: int = 0, **bounds) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Null text counts as empty; an empty text is one empty line and gets that line's probability.
    Repeated rows get equal results, null ids are kept, labels other than 0 and 1 are ignored,
    and without any labels every text scores as good. Other columns are ignored.
    """
    model = model or train(docs, labels, modulus=modulus, held=held, **bounds)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), modulus) == held).alias("held_out"), F.col("text").cast("string").alias("text"))

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        s = shared.value.score(b.column(2))
        cols = [b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "score", "predicted"])

    return map_batches(rows, fn, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame | None = None, model: QualityModel | None = None, threshold: float = 0.3, **fit_args) -> DataFrame:
    """The rows whose text scores at least ``threshold``, with all their columns.

    A null text counts as empty, and an empty one has the score of one empty line. Null ids are kept, repeated rows stay or go
    together, and without any labels every row stays.
    """
    model = model or train(docs, labels, **fit_args)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array(shared.value.score(b.column(at)) >= threshold))

    return map_batches(docs, fn, docs.schema)
