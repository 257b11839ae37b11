"""Exact search and clustering of vectors, and token alignment, against plain versions."""

import hashlib
import json
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import alignment, centroids, impact_search
from weftgraph.llm.queries import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


def plain_top(rows, is_query, k, scale):
    """(query_id, rank, vec_id, score) with Python integers."""
    import math

    ok = [(i, v, [math.floor(scale * x) for x in e]) for i, (v, e) in enumerate(rows) if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, q, x in ok:
        if is_query(q):
            best = sorted(((-sum(a * b for a, b in zip(x, y)), c is None, c or 0, c) for j, c, y in ok if j != i))[:k]
            out += [(q, r + 1, c, -s) for r, (s, _, _, c) in enumerate(best)]
    return sorted(out, key=str)


SHAPES = {
    "gauss": lambda g: g.normal(size=(300, 12)),
    "ties": lambda g: g.integers(-1, 2, (300, 6)).astype(float),
    "copies": lambda g: np.repeat(g.normal(size=(3, 8)), 100, axis=0),
    "positive": lambda g: g.random((300, 20)),
    "sparse": lambda g: g.normal(size=(300, 30)) * (g.random((300, 30)) < 0.1),
    "large": lambda g: g.normal(size=(300, 16)) * 100_000,
}


@pytest.mark.parametrize("shape", sorted(SHAPES))
def test_a_shard_equals_all_scores(shape):
    v = np.floor(64 * SHAPES[shape](np.random.default_rng(5))).astype(np.int64)
    shard = impact_search.Shard(np.arange(len(v)), list(range(len(v))), v)
    for i in range(0, len(v), 7):
        r, s = shard.best(i, v[i], 20)
        want = sorted(((-int(x), j) for j, x in enumerate(v @ v[i]) if j != i))[:20]
        assert [(-int(x), int(j)) for j, x in zip(r, s)] == want


def test_search_over_shards_equals_plain(spark, monkeypatch):
    monkeypatch.setattr(impact_search, "SHARD", 50)
    g = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.float32(g.normal(size=8))]) for i in range(300)]
    rows += [(20, rows[20][1]), (40, rows[40][1]), (None, rows[1][1]), (60, None), (80, [1.0, None, 2.0]), (100, [float("nan")] * 8), (120, [float("inf")] * 8), (140, []), (160, [1.0, 2.0]), (180, [0.0] * 8), (200, [1.0] * 11)]
    df = spark.createDataFrame([(v, e, "x", 1, 2, 3) for v, e in rows], "vec_id long, embedding array<float>, query string, rid int, shard int, score int")
    got = [tuple(r) for r in impact_search.top_products(df, F.col("vec_id") % 20 == 0, k=20, scale=64).collect()]
    assert sorted(got, key=str) == plain_top(rows, lambda q: q is not None and q % 20 == 0, 20, 64)
    assert impact_search.top_products(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    few = impact_search.top_products(df.where("vec_id in (40, 41)"), F.col("vec_id") % 20 == 0).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in few) == [(40, 1, 40), (40, 1, 40), (40, 2, 41), (40, 2, 41)]


def test_proof_stops_before_the_last_entry():
    """A clear winner ends the search early, and only few rows are scored again."""
    g = np.random.default_rng(1)
    v = np.floor(64 * np.vstack([g.normal(size=(2000, 32)) * 0.1, np.tile(g.normal(size=32), (25, 1)) + g.normal(size=(25, 32)) * 0.01])).astype(np.int64)
    shard, decided = impact_search.Shard(np.arange(len(v)), list(range(len(v))), v), []
    plain = impact_search.Shard._decide
    shard._decide = lambda rows, *a: decided.append(len(rows)) or plain(shard, rows, *a)
    r, _ = shard.best(2001, v[2001], 20)
    assert set(r) <= set(range(2000, 2025)) and decided[0] < 100


@pytest.mark.parametrize("shape", sorted(SHAPES))
def test_nearest_is_exact(shape):
    x = np.floor(256 * SHAPES[shape](np.random.default_rng(9))).astype(np.int64)
    c = np.vstack([x[:30], x[:5], x[10:20] + 1])  # equal and almost equal centroids
    d = ((x[:, None, :] - c[None, :, :]) ** 2).sum(2)
    assert centroids.nearest(x, c).tolist() == d.argmin(1).tolist()


def test_float32_alone_would_err():
    """Distances that differ by less than a float32's gap are still told apart."""
    c = np.full((2, 64), 1 << 20)
    c[0, 0] += 1
    x = np.full((3, 64), 1 << 20)
    x[1, 0] += 1
    x[2, 0] += 5
    assert centroids.nearest(x, c).tolist() == [1, 0, 0]


def plain_clusters(rows, k, rounds, scale=256):
    x = [(v, np.array([int(np.floor(scale * float(y))) for y in e], object)) for v, e in rows if e is not None and len(e) == 64 and all(y is not None and np.isfinite(y) for y in e)]
    c = [v for _, v in sorted(x, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1].tolist()))[:k]]
    near = lambda v: min((int(((v - y) ** 2).sum()), j) for j, y in enumerate(c))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in x]
        new = list(c)
        for j in range(len(c)):
            own = [v for (_, v), a in zip(x, at) if a == j]
            if own:
                new[j] = np.array([int(s) // len(own) for s in sum(own[1:], own[0])], object)
        c = new
    out = [(i, *near(v)) for i, v in x]
    inertia = Counter()
    for _, d, j in out:
        inertia[j] += d
    names = [hashlib.sha256(",".join(map(str, y.tolist())).encode()).hexdigest() for y in c]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), names[j]) for i, d, j in out), key=str)


def test_clusters_equal_plain(spark):
    g = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.float32(g.normal(size=64) * 0.1)]) for i in range(200)]
    rows += [(5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1]), (900, None), (901, [0.5] * 63), (902, [None] + [0.5] * 63), (903, [float("nan")] * 64), (904, [float("-inf")] * 64), (905, []), *((1000 + i, rows[0][1]) for i in range(60))]
    df = spark.createDataFrame([(v, e, 7, 8) for v, e in rows], "vec_id long, embedding array<float>, cluster int, n int")
    cols = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    for k in (7, 40):
        out = centroids.cluster(df, k=k)
        assert out.columns == cols
        assert sorted((tuple(r) for r in out.collect()), key=str) == plain_clusters(rows, k, 5)
    assert centroids.cluster(df.where("false")).count() == 0
    assert centroids.cluster(df.where("vec_id < 3")).select("cluster").distinct().count() == 3


def plain_alignment(rows):
    """The contract's columns, from whole texts, one token at a time."""
    import re

    import sentencepiece
    from tokenizers import Tokenizer

    ta, tb = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    ta.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    a_of = {i: bytes(letter[c] for c in t) for t, i in json.load(open(A))["model"]["vocab"].items() if all(c in letter for c in t)}

    def b_of(i):
        p = tb.id_to_piece(i)
        m = re.fullmatch("<0x(..)>", p)
        return bytes([int(m[1], 16)]) if m else p.replace("▁", " ").encode()

    docs, counts = [], Counter()
    for d, t in rows:
        groups, links = [], []
        a = ta.encode(" " + t, add_special_tokens=False).ids if t else []
        b = tb.encode(t) if t else []
        if t and b"".join(map(a_of.get, a)) == (" " + t).encode() == b"".join(map(b_of, b)):
            ea, eb = np.cumsum([len(a_of[i]) for i in a]).tolist(), np.cumsum([len(b_of(i)) for i in b]).tolist()
            i = j = 0
            for e in sorted(set(ea) & set(eb)):
                x, y = ea.index(e, i), eb.index(e, j)
                groups.append((a[i : x + 1], b[j : y + 1]))
                links.append((a[x], b[y]))
                i, j = x + 1, y + 1
        else:
            a, b = [], []
        counts.update(links)
        docs.append((d, len(a), len(b), groups, links))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    out = []
    for d, na, nb, groups, links in docs:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((d, na, nb, len(groups), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), sha))
    return sorted(out, key=str)


HARD = [
    "a  b   c \n d\t e", " lead", "trail  ", " ", "  ", "\n", "don't we'll I'd it's", "x▁y", "▁", "naïve café déjà vu ñandú", "日本語 テキスト 😀 👩‍👩‍👧", "a b   c   d é  f é g", "tab\t\tx \r\n y\x0b z\x1c w\x00 v",
    "<|endoftext|> is <s> plain </s> <unk> <0x41>", "1234567890 12,345.67 -- ... !!", "é é é", "\u0085 a   b", "word" * 800 + " " + "=" * 5000 + " end", " " * 3000 + "x", "　x 　 y",
]


def test_alignment_of_hard_texts_equals_plain(spark):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(None, "a b"), (3, None), (4, ""), (5, "a b c"), (5, "a b c")]
    df = spark.createDataFrame([(d, t, 1, "b") for d, t in rows], "doc_id long, text string, block int, codes string")
    assert sorted((tuple(r) for r in alignment.align(df, A, B).collect()), key=str) == plain_alignment(rows)
    assert alignment.align(df.where("false"), A, B).count() == 0
    assert [tuple(r) for r in alignment.align(df.where("doc_id = 4 and text = ''"), A, B).collect()] == [(4, 0, 0, 0, 0, 0, 0, "")]


def test_alignment_of_texts_that_end_in_a_space(spark):
    ends = ["a", "ab 12", "é", "日本", "x!", "a\n", "a\u3000", "x\x00", "don't", "a  b"]
    rows = [(i, t + s) for i, (t, s) in enumerate((t, s) for s in (" ", "  ", " \n ", "") for t in ends)] + [(100, " "), (101, "a "), (102, "a "), (103, "a"), (104, None), (105, "b ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 5):  # what follows a text in its block does not matter
        assert sorted((tuple(r) for r in alignment.align(df.coalesce(1).repartition(parts), A, B).collect()), key=str) == plain_alignment(rows)


def test_alignment_of_documents_equals_plain(spark, docs, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in alignment.align(docs, A, B).collect()), key=str) == plain_alignment(rows)


def test_groups_are_components():
    g = np.random.default_rng(0)
    for _ in range(50):
        n = int(g.integers(1, 40))
        cuts = [np.append(np.flatnonzero(g.random(n - 1) < p) + 1, n) for p in g.random(2)]
        ga, gb, i, j = alignment.align_tokens(*cuts)
        both = sorted(set(cuts[0]) & set(cuts[1]))
        assert ga.tolist() == np.searchsorted(both, cuts[0]).tolist() and gb.tolist() == np.searchsorted(both, cuts[1]).tolist()
        assert cuts[0][i].tolist() == cuts[1][j].tolist() == both


def test_a_long_text_without_spaces(spark):
    t = "abc" * 100_000
    df = spark.createDataFrame([(1, t), (2, t + " x")], "doc_id long, text string")
    assert sorted((tuple(r) for r in alignment.align(df, A, B).collect()), key=str) == plain_alignment([(1, t), (2, t + " x")])
