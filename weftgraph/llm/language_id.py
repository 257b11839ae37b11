"""Language identification: language family first, then linear SVMs within the family."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import kernels as K
from weftgraph.llm.common import bounded_sample, fold, map_batches, sampled_texts

#: Language families of common ISO 639-1 codes.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "baltic": ("lt", "lv"),
    "turkic": ("az", "kk", "tr", "uz"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
}
DIM = 4096


def family_of(lang: str, families: Mapping[str, tuple[str, ...]] = FAMILIES) -> str:
    """The family that lists the language; a language nobody lists is its own family."""
    return next((f for f, members in families.items() if lang in members), f"={lang}")


def _codes(data: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Hashed trigram at each byte; lower case in ASCII and Latin-1. Before each of ``heads`` stands white space."""
    d = K._LOWER[data]
    if len(d) > 1:
        up = (d[:-1] == 0xC3) & (d[1:] >= 0x80) & (d[1:] <= 0x9E)
        d[1:][up] += 0x20
    d[K._SPACE[d]] = 32
    one, two = np.full(len(d), 32, np.uint32), np.full(len(d), 32, np.uint32)
    one[1:], two[2:] = d[:-1], d[:-2]
    one[heads] = two[heads] = 32
    two[heads[heads + 1 < len(d)] + 1] = 32
    x = d.astype(np.uint32) * np.uint32(0x9E3779B1) + one * np.uint32(0x85EBCA6B) + two * np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    return (x >> np.uint32(20)).astype(np.int64)


def profiles(col: pa.Array) -> np.ndarray:
    """Relative trigram frequencies, one row of DIM values for each text."""
    data, off = K.text_bytes(col)
    out = np.zeros((len(off) - 1, DIM), np.float32)
    for i, j in K.blocks(off):
        for r in range(i, j):
            if off[r + 1] > off[r]:
                n = np.zeros(DIM)
                for p in range(int(off[r]), int(off[r + 1]), K.BLOCK):
                    n += np.bincount(_codes(data[p : min(p + K.BLOCK, int(off[r + 1]))], np.zeros(1, int)), minlength=DIM)
                out[r] = n / n.sum()
    return out


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 80) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM by accelerated gradient steps; y is +1 or -1. Returns (weights, bias)."""
    s = np.sqrt(x.mean(axis=0) + 1e-7).astype(np.float32)
    z = x / s
    mean = z.mean(axis=0)
    z -= mean
    scale = np.sqrt((z * z).sum(axis=1).mean()) + 1e-9
    z /= scale
    n = len(y)
    cost = c * n / (2 * np.where(y > 0, max((y > 0).sum(), 1), max((y < 0).sum(), 1))) / n
    cost = cost.astype(np.float32)
    y = y.astype(np.float32)
    v = np.ones(x.shape[1], np.float32)
    for _ in range(8):
        v = z.T @ (cost * (z @ v))
        v /= np.linalg.norm(v) + 1e-12
    top = float(v @ (z.T @ (cost * (z @ v)))) + float(cost.sum())
    step = 1.0 / (1.0 + 2.2 * top)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    pw, pb = w, b
    for t in range(rounds):
        m = t / (t + 3.0)
        qw, qb = w + m * (w - pw), b + m * (b - pb)
        slack = np.maximum(0, 1 - y * (z @ qw + np.float32(qb))) * cost * y
        pw, pb = w, b
        w = (qw - step * (qw - 2 * (z.T @ slack))).astype(np.float32)
        b = qb + step * 2 * float(slack.sum())
    weights = w / (s * scale)
    return weights, b - float((mean * s) @ weights)


class LanguageModel:
    """Trained weights: one separating plane for each pair of families and of languages in a family."""

    def __init__(self, x: np.ndarray, langs: list[str], families: Mapping[str, tuple[str, ...]] = FAMILIES):
        self.langs = sorted(set(langs))
        fam = {g: family_of(g, families) for g in self.langs}
        self.families = sorted(set(fam.values()))
        self.members = {f: [g for g in self.langs if fam[g] == f] for f in self.families}
        self.planes: list[tuple[str, str]] = []
        w, b = [], []
        of = np.array(langs, dtype=object)
        of_family = np.array([fam[g] for g in langs], dtype=object)
        jobs = [(of_family, p) for p in combinations(self.families, 2)]
        jobs += [(of, p) for f in self.families for p in combinations(self.members[f], 2)]
        for tags, (p, q) in jobs:
            rows = (tags == p) | (tags == q)
            wi, bi = linear_svm(x[rows], np.where(tags[rows] == p, 1.0, -1.0).astype(np.float32))
            self.planes.append((p, q)), w.append(wi), b.append(bi)
        self.w = np.array(w, np.float32).reshape(len(w), DIM).T.copy()
        self.b = np.array(b)

    def _choose(self, names: list[str], margins: dict, n: int) -> tuple[np.ndarray, np.ndarray]:
        """One-versus-one vote among names: index of the winner and a logistic score of its weakest margin."""
        if len(names) == 1:
            return np.zeros(n, int), np.ones(n)
        votes, least = np.zeros((n, len(names))), np.full((n, len(names)), np.inf)
        for i, j in combinations(range(len(names)), 2):
            m = margins[names[i], names[j]]
            votes[:, i] += (m >= 0) + 1e-3 * np.tanh(m)
            votes[:, j] += (m < 0) - 1e-3 * np.tanh(m)
            least[:, i], least[:, j] = np.minimum(least[:, i], m), np.minimum(least[:, j], -m)
        won = votes.argmax(axis=1)
        return won, 1 / (1 + np.exp(-3 * np.clip(least[np.arange(n), won], -10, 10)))

    def predict(self, col: pa.Array) -> tuple[list[str], np.ndarray]:
        data, off = K.text_bytes(col)
        n = len(off) - 1
        margin = np.zeros((n, len(self.planes)))
        letters = np.zeros(n, bool)
        is_letter = np.zeros(256, bool)
        is_letter[65:91] = is_letter[97:123] = True
        for i, j in K.blocks(off):
            for p in range(int(off[i]), int(off[j]), K.BLOCK):
                stop = min(p + K.BLOCK, int(off[j]))
                d = data[p:stop]
                rows = np.arange(i, j)
                lo, hi = np.clip(off[i:j], p, stop) - p, np.clip(off[i + 1 : j + 1], p, stop) - p
                some = hi > lo
                rows, lo = rows[some], lo[some]
                if len(rows):
                    c = _codes(d, lo)
                    letters[rows] |= np.logical_or.reduceat(is_letter[d], lo)
                    for k in range(len(self.planes)):
                        margin[rows, k] += np.add.reduceat(self.w[:, k].take(c), lo, dtype=np.float64)
        margin = margin / np.maximum(np.diff(off), 1)[:, None] + self.b
        for r in np.flatnonzero(~letters & (np.diff(off) > 0)):
            letters[r] = any(ch.isalpha() for ch in col[int(r)].as_py())
        named = {pair: margin[:, k] for k, pair in enumerate(self.planes)}
        if not self.langs:
            return ["und"] * n, np.zeros(n)
        fam, score = self._choose(self.families, named, n)
        pred = np.empty(n, dtype=object)
        for k, f in enumerate(self.families):
            rows = np.flatnonzero(fam == k)
            won, s = self._choose(self.members[f], {p: m[rows] for p, m in named.items()}, len(rows))
            pred[rows] = np.array(self.members[f], dtype=object)[won] if len(rows) else None
            score[rows] *= s
        pred[~letters], score[~letters] = "und", 0.0
        return list(pred), score


def train(docs: DataFrame, per_lang: int = 600, families: Mapping[str, tuple[str, ...]] = FAMILIES, modulus: int = 3, held: int = 1) -> LanguageModel:
    """Fit on about ``per_lang`` documents of each language from outside the held-out fold (the bound)."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"))
    ids = ids.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), modulus) != held))
    chosen = bounded_sample(ids, "lang", "doc_id", per_lang).dropDuplicates(["doc_id"])
    texts = sampled_texts(docs, chosen).where("text is not null").select("lang", "text")

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        p = profiles(b.column(1)).astype(np.float16)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in p], pa.binary())], ["lang", "x"])

    got = map_batches(texts, fn, "lang string, x binary").collect()
    got = sorted((r["lang"], bytes(r["x"])) for r in got)
    x = np.array([np.frombuffer(r[1], np.float16) for r in got], np.float32).reshape(len(got), DIM)
    return LanguageModel(x, [r[0] for r in got], families)


def identify(docs: DataFrame, model: LanguageModel | None = None, modulus: int = 3, held: int = 1, **fit) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row.

    Null texts and texts without a letter are ``und`` with score 0. A null id is kept and counts as
    held out only if the empty text's fold is; repeated rows give repeated results; without any
    learned language everything is ``und``. Other columns are ignored.
    """
    spark = docs.sparkSession
    model = model or train(docs, modulus=modulus, held=held, **fit)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), modulus) == held).alias("held_out"), F.col("text").cast("string").alias("text"))

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        pred, score = shared.value.predict(b.column(2))
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return map_batches(rows, fn, "doc_id long, held_out boolean, lang_pred string, score double")
