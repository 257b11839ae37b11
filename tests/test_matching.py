"""Matching, flows and assignments against plain versions and by their certificates."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.graph import GraphError
from weftgraph.operators import assignment as S
from weftgraph.operators import flows as W


def pairs_of(spark, rows, schema="src long, dst long"):
    return spark.createDataFrame(rows, schema)


def plain_matching(edges):
    mate = {}

    def grow(l, seen):
        for a, r in edges:
            if a == l and r not in seen:
                seen.add(r)
                if r not in mate or grow(mate[r], seen):
                    mate[r] = l
                    return True
        return False

    return sum(grow(l, set()) for l in sorted({l for l, _ in edges}))


def check_matching(spark, edges):
    e = pairs_of(spark, edges)
    got, cover = W.matching_with_cover(e)
    rows = [tuple(r) for r in got.collect()]
    cover = {tuple(r) for r in cover.collect()}
    assert set(rows) <= set(edges) and len({l for l, _ in rows}) == len({r for _, r in rows}) == len(rows)
    assert len(rows) == plain_matching(sorted(set(edges))) == len(cover)
    assert all(("left", l) in cover or ("right", r) in cover for l, r in edges)


def test_matching(spark):
    """Named and random graphs side by side, as one graph of many components."""
    path = [(i, j) for i in range(6) for j in (i, i + 1) if j < 6]  # greedy choices block it
    g = np.random.default_rng(0)
    parts = [[(0, 0)], [(0, 0), (0, 1), (1, 0)], [(0, 0), (1, 0), (2, 0)], path, [(i, j) for i in range(3) for j in range(4)], [(0, 0), (0, 0), (5, 7)]]
    parts += [[tuple(map(int, x)) for x in g.integers(0, n, (int(n * 1.6), 2))] for n in (12, 25)]
    check_matching(spark, [(100 * k + l, 100 * k + r) for k, part in enumerate(parts) for l, r in part])
    assert W.hopcroft_karp(pairs_of(spark, [(None, 1), (1, None)])).count() == 0


def plain_flow(edges, budgets, costs=None):
    """(largest flow, its least cost) by Bellman-Ford on the residual network."""
    arcs = []

    def add(u, v, c, w):
        arcs.extend([[u, v, c, w], [v, u, 0, -w]])

    left = {u for u, v, _ in edges}
    for u in left:
        add("s", ("l", u), budgets.get(u, 0), 0)
    for v in {v for _, v, _ in edges}:
        add(("r", v), "t", budgets.get(v, 0), 0)
    for i, (u, v, c) in enumerate(edges):
        add(("l", u), ("r", v), c, costs[i] if costs else 0)
    flow = cost = 0
    while True:
        d, by = {"s": 0}, {}
        for _ in range(len(arcs)):
            moved = False
            for k, (u, v, c, w) in enumerate(arcs):
                if c and u in d and d[u] + w < d.get(v, math.inf):
                    d[v], by[v], moved = d[u] + w, k, True
            if not moved:
                break
        if "t" not in d:
            return flow, cost
        x = "t"
        while x != "s":
            arcs[by[x]][2] -= 1
            arcs[by[x] ^ 1][2] += 1
            x = arcs[by[x]][0]
        flow, cost = flow + 1, cost + d["t"]


def flow_case(seed):
    g = np.random.default_rng(seed)
    cells = sorted({(int(a), int(b)) for a, b in zip(g.integers(0, 6, 15), g.integers(100, 106, 15))})
    edges = [(a, b, int(g.integers(1, 5))) for a, b in cells]
    budgets = {v: int(g.integers(0, 7)) for v in [*range(6), *range(100, 106)]}
    return edges, budgets, [int(x) for x in g.integers(-1, 3, len(edges))]


def check_flow(rows, edges, budgets):
    caps = {(a, b): c for a, b, c in edges}
    used = {}
    for a, b, f in rows:
        assert a < b and 0 < f <= caps[a, b]
        for v in (a, b):
            used[v] = used.get(v, 0) + f
    assert all(x <= budgets[v] for v, x in used.items())
    return sum(f for _, _, f in rows)


def test_flows_equal_plain(spark):
    edges, budgets, costs = flow_case(2)
    b = spark.createDataFrame(sorted(budgets.items()), "id long, budget long")
    sides = b.select("id", (F.col("id") >= 100).cast("long").alias("color"))
    e = spark.createDataFrame([(*x, c) if i % 2 else (x[1], x[0], x[2], c) for i, (x, c) in enumerate(zip(edges, costs))], "src long, dst long, capacity long, cost long")
    most, _ = plain_flow(edges, budgets)
    rows = [tuple(r) for r in W.balanced_flow(e.drop("cost"), b, sides).collect()]
    assert check_flow(rows, edges, budgets) == most
    # a flow to start from keeps what its vertices carry
    first = [r for r in rows if r[2] > 0][:2]
    again = [tuple(r) for r in W.balanced_flow(e.drop("cost"), b, sides, spark.createDataFrame(first, "src long, dst long, flow long")).collect()]
    assert check_flow(again, edges, budgets) == most
    cheap = [tuple(r) for r in W.minimum_cost_balanced_flow(e, b, sides).collect()]
    by = {(a, b): c for (a, b, _), c in zip(edges, costs)}
    assert check_flow(cheap, edges, budgets) == most
    assert (most, sum(by[a, b] * f for a, b, f in cheap)) == plain_flow(edges, budgets, costs)


def test_flow_refusals(spark):
    b = spark.createDataFrame([(0, 1), (1, 1), (2, 1)], "id long, budget long")
    sides = spark.createDataFrame([(0, 0), (1, 1), (2, 0)], "id long, color long")
    edge = lambda *rows: spark.createDataFrame(list(rows), "src long, dst long, capacity long")
    start = lambda *rows: spark.createDataFrame(list(rows), "src long, dst long, flow long")
    for bad in (edge((0, 2, 1)), edge((0, 9, 1)), edge((0, 1, 0)), edge((0, 1, None)), edge((0, 1, 1), (1, 0, 2))):
        with pytest.raises(GraphError):
            W.balanced_flow(bad, b, sides)
    with pytest.raises(GraphError):
        W.balanced_flow(edge((0, 1, 1)), spark.createDataFrame([(0, -1), (1, 1)], "id long, budget long"), sides)
    for bad in (start((1, 0, 1)), start((0, 1, 3)), start((0, 1, 0)), start((0, 2, 1)), start((0, 1, 1), (0, 1, 1)), start((0, 1, 1), (1, 2, 1))):
        with pytest.raises(GraphError):
            W.balanced_flow(edge((0, 1, 2), (2, 1, 2)), b, sides, bad)
    assert W.balanced_flow(edge(), b, sides).count() == 0
    assert [tuple(r) for r in W.balanced_flow(edge((0, 1, 2), (1, 0, 2)), b, sides).collect()] == [(0, 1, 1)]


def ids(spark, n):
    return spark.range(n)


def cost_rows(m):
    return [(i, j, float(x)) for i, row in enumerate(m) for j, x in enumerate(row) if x is not None]


def entries(spark, m):
    return spark.createDataFrame(cost_rows(m), "src long, dst long, weight double")


def plain_assignment(m):
    n = len(m)
    return min((sum(m[i][p[i]] for i in range(n)) for p in itertools.permutations(range(n)) if all(m[i][p[i]] is not None for i in range(n))), default=None)


def test_assignments_of_least_cost(spark):
    g = np.random.default_rng(3)
    for n, share in ((5, 0.6),):
        m = [[float(x) if g.random() < share or i == j else None for j, x in enumerate(row)] for i, row in enumerate(g.integers(1, 40, (n, n)))]
        out = S.lapmod(entries(spark, m), ids(spark, n), ids(spark, n), 100.0, decimals=0)
        p = out.proof().first()
        assert p["size"] == n and p["gap"] == p["violations"] == 0 and math.isclose(p["cost"], plain_assignment(m))


def best_pairs(m, padding):
    """Least cost of the pairs plus padding for what min(rows, columns) lacks, over all partial assignments."""
    cells = cost_rows(m)
    best = (0.0, 0)
    for k in range(1, min(len(m), len(m[0])) + 1):
        for x in itertools.combinations(cells, k):
            if len({i for i, _, _ in x}) == len({j for _, j, _ in x}) == k:
                best = min(best, (sum(c for _, _, c in x) - k * padding, -k))
    return best[0], -best[1]


def test_rectangular_assignments(spark):
    g = np.random.default_rng(1)
    m = [[float(x) if g.random() < 0.5 else None for x in row] for row in g.integers(1, 9, (4, 5))]
    m[2] = [None] * 5  # a row without entries
    assert S.sparse_lapjv is S.crouse and S.sparse_hungarian is S.crouse
    for run, padding in ((S.crouse, 9.5),):
        out = run(entries(spark, m), padding, 1000.0, decimals=1)
        rows = out.pairs.collect()
        want, size = best_pairs(m, padding)
        assert len({r["src"] for r in rows}) == len({r["dst"] for r in rows}) == len(rows)
        assert math.isclose(sum(r["weight"] for r in rows) - padding * len(rows), want) and len(rows) == size
        p = out.proof().first()
        assert p["gap"] == p["violations"] == 0
    none = spark.createDataFrame([], "src long, dst long, weight double")
    assert S.crouse(none, 9.5, 100.0).pairs.count() == 0 and S.jaqaman(none, 9.5, 100.0).pairs.count() == 0


def test_refused_matrices(spark):
    one = lambda w: spark.createDataFrame([(0, 0, w)], "src long, dst long, weight double")
    n = ids(spark, 1)

    def kind(f):
        with pytest.raises(S.AssignmentError) as e:
            f()
        return e.value.kind

    for w, want in ((0.0, "ZeroValues"), (-1.0, "NegativeValues"), (math.nan, "NonFiniteValues"), (math.inf, "NonFiniteValues"), (None, "NonFiniteValues"), (10.0, "ValueTooLarge")):
        assert kind(lambda w=w: S.lapmod(one(w), n, n, 10.0)) == want
    assert kind(lambda: S.lapmod(one(1.0), n, ids(spark, 2), 10.0)) == "NonSquareMatrix"
    assert kind(lambda: S.lapmod(one(1.0), ids(spark, 2), ids(spark, 2), 10.0)) == "InfeasibleAssignment"
    assert kind(lambda: S.lapmod(one(1.0), n, n, math.inf)) == "MaximalCostNotFinite"
    assert kind(lambda: S.lapmod(one(1.0), n, n, 0.0)) == "MaximalCostNotPositive"
    assert kind(lambda: S.lapjv(one(1.0).where("false"), ids(spark, 0), ids(spark, 0), 1.0)) == "EmptyMatrix"
    assert kind(lambda: S.jaqaman(one(5.0), 10.0, 100.0)) == "PaddingCostTooSmall"
    assert kind(lambda: S.crouse(one(1.0), 100.0, 100.0)) == "ValueTooLarge"
    assert kind(lambda: S.crouse(one(1.0), math.nan, 100.0)) == "PaddingValueNotFinite"
    assert kind(lambda: S.crouse(one(1.0), 0.0, 100.0)) == "PaddingValueNotPositive"
