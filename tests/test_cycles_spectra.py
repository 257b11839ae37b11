"""Cycle spaces, reductions, stationary distributions and eigenvectors against plain versions."""

import itertools
import math

import numpy as np
import pytest

from weftgraph.graph import Graph, GraphError
from weftgraph.operators import cycles as C
from weftgraph.operators import spectral as E


def graph(spark, edges, n):
    return Graph.build(spark.range(n), spark.createDataFrame(edges, "src long, dst long")).kept()


def simple_cycles(edges):
    """All simple cycles as sorted tuples of edges."""
    out, near = set(), {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)

    def walk(path):
        for x in near[path[-1]]:
            if x == path[0] and len(path) > 2:
                out.add(tuple(sorted(tuple(sorted(p)) for p in zip(path, [*path[1:], path[0]]))))
            elif x > path[0] and x not in path:
                walk([*path, x])

    for v in sorted(near):
        walk([v])
    return sorted(out, key=lambda c: (len(c), c))


class Span:
    def __init__(self):
        self.rows = {}

    def rest(self, x):
        while x and (p := x.bit_length()) in self.rows:
            x ^= self.rows[p]
        return x

    def add(self, x):
        x = self.rest(x)
        if x:
            self.rows[x.bit_length()] = x
        return bool(x)


def plain_cycle_facts(edges):
    """(lengths of a minimum basis, relevant cycles, essential cycles)"""
    bit = {e: 1 << i for i, e in enumerate(sorted(edges))}
    every = [(len(c), sum(bit[e] for e in c), c) for c in simple_cycles(edges)]
    basis, lengths = Span(), []
    for n, x, _ in every:
        if basis.add(x):
            lengths.append(n)
    relevant = []
    for n, x, c in every:
        s = Span()
        for m, y, _ in every:
            if m < n:
                s.add(y)
        if s.rest(x):
            relevant.append((n, x, c))
    essential = []
    for n, x, c in relevant:
        s = Span()
        for m, y, d in relevant:
            if m <= n and d != c:
                s.add(y)
        if s.rest(x):
            essential.append(c)
    return lengths, [c for _, _, c in relevant], essential


def told(df):
    return sorted(tuple((e["src"], e["dst"]) for e in r["edges"]) for r in df.collect())


def test_cycle_spaces(spark):
    """Side by side: a wheel, a prism, K4, K33, a square with a chord, a theta of three paths, a tree, and a random graph."""
    g = np.random.default_rng(3)
    parts = [
        [(0, i) for i in range(1, 6)] + [(i, i % 5 + 1) for i in range(1, 6)], [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (0, 3), (1, 4), (2, 5)], list(itertools.combinations(range(4), 2)), [(i, j) for i in range(3) for j in range(3, 6)],
        [(0, 1), (1, 2), (2, 3), (0, 3), (0, 2)], [(0, 1), (1, 9), (0, 2), (2, 9), (0, 3), (3, 4), (4, 9)], [(0, 1), (1, 2), (1, 3)], sorted({tuple(sorted(map(int, x))) for x in g.integers(0, 9, (16, 2)) if x[0] != x[1]}),
    ]
    edges = sorted({tuple(sorted((10 * k + a, 10 * k + b))) for k, part in enumerate(parts) for a, b in part})
    lengths, relevant, essential = plain_cycle_facts(edges)
    h = graph(spark, edges, 80)
    basis = C.minimum_cycle_basis(h).collect()
    assert sorted(r["length"] for r in basis) == sorted(lengths) and all(len(r["edges"]) == r["length"] for r in basis)
    e, rel, ess = C._relevant(h)
    assert told(C._told(rel, e)) == sorted(relevant)
    assert told(C._told(rel.join(ess, "cid", "left_semi"), e)) == sorted(essential)


def test_no_cycles_and_refusals(spark):
    tree = graph(spark, [(0, 1), (1, 2)], 4)
    assert C.minimum_cycle_basis(tree).count() == 0
    assert C.relevant_cycles(tree).count() == C.essential_cycles(tree).count() == 0
    with pytest.raises(GraphError):
        C.minimum_cycle_basis(graph(spark, [(0, 0)], 1))


def plain_k4(edges):
    """By single steps of the reduction."""
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    while low := next((v for v, x in near.items() if len(x) <= 2), None) if near else None:
        x = near.pop(low)
        for y in x:
            near[y].discard(low)
        if len(x) == 2:
            a, b = x
            near[a].add(b)
            near[b].add(a)
    return bool(near)


def has_k4_minor(edges, n):
    """By trying all ways to merge vertices along edges; small graphs only."""
    sets = {frozenset(map(frozenset, edges))}
    while sets:
        nxt = set()
        for s in sets:
            v = sorted(set().union(*s)) if s else []
            if any(all(frozenset(p) in s for p in itertools.combinations(q, 2)) for q in itertools.combinations(v, 4)):
                return True
            for e in s:
                a, b = sorted(e)
                nxt.add(frozenset(frozenset(a if x == b else x for x in f) for f in s if f != e))
        sets = {frozenset(f for f in s if len(f) == 2) for s in nxt}
    return False


def test_k4(spark):
    """Random graphs of 7 vertices side by side: what is left of each agrees with merging edges in all ways."""
    g = np.random.default_rng(0)
    parts = [[e for e in itertools.combinations(range(1, 7), 2) if g.random() < p] for p in np.linspace(0.3, 0.75, 24)]
    parts += [[(1, 2), (2, 3), (3, 4), (4, 5), (1, 5)], list(itertools.combinations(range(1, 5), 2)), [(i, i + 1) for i in range(1, 9)]]
    want = {k for k, part in enumerate(parts) if has_k4_minor([(a, b) for a, b in part], 7)}
    assert want == {k for k, part in enumerate(parts) if plain_k4(part)} and 3 < len(want) < len(parts) - 3
    rest = C.k4_cores(graph(spark, [(10 * k + a, 10 * k + b) for k, part in enumerate(parts) for a, b in part], 10 * len(parts))).collect()
    assert {r["src"] // 10 for r in rest} == want
    assert C.has_k4_homeomorph(graph(spark, [(0, 0), (0, 1)], 2)).first()["has_k4"] is False


def matrix(spark, m, name="value"):
    return spark.createDataFrame([(i, j, float(x)) for i, row in enumerate(m) for j, x in enumerate(row)], f"src long, dst long, {name} double")


def test_stationary_distributions(spark):
    g = np.random.default_rng(1)
    dense = g.random((7, 7)) * (g.random((7, 7)) < 0.6) + np.eye(7, k=1) + np.eye(7, k=-6)
    dense /= dense.sum(1, keepdims=True)
    for m in ([[1.0]], [[0.1, 0.9], [0.6, 0.4]], dense):
        got = {r["id"]: r["probability"] for r in E.stationary_distribution(matrix(spark, m)).collect()}
        x = np.array([got[i] for i in range(len(m))])
        assert abs(x.sum() - 1) < 1e-12 and np.abs(x @ np.array(m) - x).sum() < 1e-12
    # two closed classes: that of the smallest id counts, and transient states have 0
    m = [[0.5, 0.25, 0.25, 0, 0], [0, 0.2, 0, 0.8, 0], [0, 0, 1, 0, 0], [0, 0.6, 0, 0.4, 0], [1, 0, 0, 0, 0]]
    got = {r["id"]: r["probability"] for r in E.stationary_distribution(matrix(spark, m)).collect()}
    assert all(math.isclose(got[i], w, abs_tol=1e-12) for i, w in enumerate([0, 3 / 7, 0, 4 / 7, 0]))


def test_refused_chains(spark):
    for m in ([[0.5, 0.4], [0.5, 0.5]], [[-0.1, 1.1], [0.5, 0.5]], [[math.nan, 1.0], [0.5, 0.5]]):
        with pytest.raises(GraphError):
            E.stationary_distribution(matrix(spark, m))
    with pytest.raises(GraphError):
        E.stationary_distribution(matrix(spark, [[1.0]]).where("false"))
    with pytest.raises(GraphError):
        E.stationary_distribution(matrix(spark, [[1.0]]), tolerance=math.nan)


def test_rounds_meet_every_pair_once():
    for n in range(1, 9):
        rounds = E._rounds(n)
        assert sorted(p for r in rounds for p in r) == list(itertools.combinations(range(n), 2))
        assert all(len({x for p in r for x in p}) == 2 * len(r) for r in rounds)


def test_eigenvectors(spark):
    g = np.random.default_rng(2)
    a = g.normal(size=(5, 5))
    a = a + a.T
    values, vectors = E.eigen(matrix(spark, a))
    w = [r["value"] for r in values.orderBy("k").collect()]
    assert np.allclose(w, sorted(np.linalg.eigvalsh(a), reverse=True), atol=1e-9)
    u = np.zeros((5, 5))
    for r in vectors.collect():
        u[r["id"], r["k"]] = r["x"]
    assert np.allclose(u.T @ u, np.eye(5), atol=1e-9) and np.allclose(a @ u, u * w, atol=1e-6)
    for m in ([[1.0, 2.0], [3.0, 1.0]], [[math.inf]]):
        with pytest.raises(GraphError):
            E.eigen(matrix(spark, m))
    one, vec = E.eigen(matrix(spark, [[3.0]]))
    assert one.first()["value"] == 3.0 and vec.first()["x"] == 1.0


def test_scaling_finds_points_of_a_plane(spark):
    g = np.random.default_rng(5)
    x = g.normal(size=(5, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    points, off = E.classical_mds(matrix(spark, d, "weight"))
    y = np.array([r["x"] for r in points.orderBy("id").collect()])
    assert np.allclose(np.sqrt(((y[:, None] - y[None]) ** 2).sum(2)), d, atol=1e-6) and off.first()["stress"] < 1e-6
    with pytest.raises(GraphError):
        E.classical_mds(matrix(spark, [[0.0, -1.0], [-1.0, 0.0]], "weight"))
