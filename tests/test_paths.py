"""Paths, circuits, orders, chordality and matrix edits against plain versions on small graphs."""

import itertools
import random
from collections import deque

import pytest

from weftgraph.graph import Graph, GraphError
from weftgraph.operators import matrices, paths
from weftgraph.sources import generators


def _graph(spark, n, edges, directed=False):
    return Graph.build(spark.range(n), spark.createDataFrame(edges, "src long, dst long"), directed)


def _near(n, edges):
    out = {v: set() for v in range(n)}
    for a, b in edges:
        if a != b:
            out[a].add(b), out[b].add(a)
    return out


def test_circuits_equal_permutations(spark):
    r = random.Random(2)
    edges = r.sample([(a, b) for a in range(6) for b in range(6)], 17)
    want = {p for k in range(2, 7) for p in itertools.permutations(range(6), k) if p[0] == min(p) and all(e in edges for e in zip(p, p[1:] + p[:1]))}
    got = [tuple(x[0]) for x in paths.circuits(_graph(spark, 6, edges, True)).collect()]
    assert len(got) == len(want) and set(got) == want
    assert paths.circuits(_graph(spark, 3, [(0, 0), (0, 1), (1, 2)], True)).count() == 0


def test_unique_paths_and_lines(spark):
    one = spark.range(1).withColumnRenamed("id", "src")
    dag = _graph(spark, 6, [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (5, 4)], True)
    assert sorted(tuple(x[0]) for x in paths.unique_paths(dag, one).collect()) == [(0, 1, 3, 4), (0, 2, 3, 4)]
    assert [tuple(x[0]) for x in paths.unique_paths(_graph(spark, 2, [], True), one).collect()] == [(0,)]
    with pytest.raises(GraphError):
        paths.unique_paths(_graph(spark, 3, [(0, 1), (1, 2), (2, 1)], True), one)
    for n, edges, line in ((3, [(2, 0), (0, 1)], True), (1, [], True), (0, [], False), (4, [(0, 1), (2, 3)], False), (4, [(1, 2), (2, 3), (3, 1)], False), (3, [(0, 1), (0, 2)], False), (1, [(0, 0)], False)):
        assert paths.is_simple_path(_graph(spark, n, edges, True)).first()[0] is line


@pytest.mark.parametrize("seeds", ["max_degree", "smallest_id"])
def test_breadth_first_order_equals_a_queue(spark, seeds):
    r = random.Random(4)
    n = 24
    edges = r.sample([(a, b) for a in range(16) for b in range(a + 1, 16)], 19) + [(17, 18), (18, 19), (20, 20)]
    near, deg = _near(n, edges), {v: sum(v in e for e in edges) for v in range(n)}
    want, seen = [], set()
    for root in sorted(range(n), key=lambda v: (-deg[v], v) if seeds == "max_degree" else v):
        todo = deque([] if root in seen else [root])
        seen.add(root)
        while todo:
            v = todo.popleft()
            want.append(v)
            for u in sorted(near[v] - seen):
                seen.add(u), todo.append(u)
    rows = paths.breadth_first_order(_graph(spark, n, edges), seeds).orderBy("position").collect()
    assert [x["id"] for x in rows] == want and [x["position"] for x in rows] == list(range(n))
    with pytest.raises(GraphError):
        paths.breadth_first_order(_graph(spark, 2, [(0, 1)], True))


def test_degeneracy_order_keeps_its_bound(spark):
    r = random.Random(6)
    n, edges = 30, r.sample([(a, b) for a in range(26) for b in range(a + 1, 26)], 90) + [(3, 3)]
    near = _near(n, edges)
    core, left, k = {}, dict(near), 0
    while left:  # plain cores: take a vertex of smallest rest degree at a time
        v = min(left, key=lambda x: len(left[x] & left.keys()))
        k = max(k, len(left[v] & left.keys()))
        core[v] = k
        del left[v]
    rows = paths.degeneracy_order(_graph(spark, n, edges)).collect()
    place = {x["id"]: x["position"] for x in rows}
    assert sorted(place.values()) == list(range(n)) and {x["id"]: x["core"] for x in rows} == core
    assert all(sum(place[u] > place[v] for u in near[v]) <= core[v] for v in range(n))
    assert paths.degeneracy_order(_graph(spark, 0, [])).count() == 0


def test_chordal_components_equal_hole_search(spark):
    """Thirty graphs side by side: all vertices of one leave if no set of four or more of its vertices induces a ring."""
    r, n, parts = random.Random(9), 6, 30
    edges, whole = [], {}
    for p in range(parts):
        mine = r.sample([(a, b) for a in range(n) for b in range(a + 1, n)], r.randint(6, 12))
        near = _near(n, mine)
        ring = False
        for k in range(4, n + 1):
            for c in itertools.combinations(range(n), k):
                inner = {v: near[v] & set(c) for v in c}
                if all(len(x) == 2 for x in inner.values()):
                    seen, todo = set(), [c[0]]
                    while todo:
                        v = todo.pop()
                        if v not in seen:
                            seen.add(v), todo.extend(inner[v])
                    ring = ring or len(seen) == k
        whole[p] = not ring
        edges += [(p * n + a, p * n + b) for a, b in mine]
    rows = paths.elimination_rounds(_graph(spark, n * parts, edges)).collect()
    left = {x["id"]: x["round"] for x in rows}
    assert {p: all(p * n + v in left for v in range(n)) for p in range(parts)} == whole and {*whole.values()} == {True, False}
    near = _near(n * parts, edges)
    for v, turn in left.items():  # later neighbours are joined to each other
        later = [u for u in near[v] if (left.get(u, 99), u) > (turn, v)]
        assert all(b in near[a] for a, b in itertools.combinations(later, 2))
    assert paths.is_chordal(_graph(spark, 3, [(0, 1)])).first()[0] and not paths.is_chordal(_graph(spark, 2, [(0, 0), (0, 1)])).first()[0]


def test_matrix_edits_and_their_errors(spark):
    m = spark.createDataFrame([(0, 1, 2.0), (1, 0, 3.0)], "src long, dst long, weight double")
    with pytest.raises(GraphError):
        matrices.with_values(m, spark.createDataFrame([(0, 1.0)], "position long, weight double"))
    with pytest.raises(GraphError):
        matrices.extended(m, m)
    dense = matrices.from_dense(spark.createDataFrame([(0, [1.0, None]), (1, [])], "src long, values array<double>"))
    assert [tuple(x) for x in dense.collect()] == [(0, 0, 1.0)]
    change = spark.createDataFrame([(0, 1, 9.0), (5, 5, 1.0)], "src long, dst long, weight double")
    assert {tuple(x) for x in matrices.updated(m, change).collect()} == {(0, 1, 9.0), (1, 0, 3.0)}
    triangle = spark.createDataFrame([(0, 1), (1, 2), (0, 2)], "src long, dst long")
    claw = spark.createDataFrame([(0, 1), (0, 2), (0, 3)], "src long, dst long")
    assert matrices.has_delta_y_exchange(triangle, claw).first()[0] and not matrices.has_delta_y_exchange(claw, claw).first()[0]


def test_random_graphs_keep_their_degrees(spark):
    g = generators.random_regular(spark, 20, 2, 1)
    assert {x["count"] for x in g.edges.groupBy("src").count().collect()} == {2} and g.edges.count() == 40
    for n, k in ((5, 3), (4, 4)):
        with pytest.raises(GraphError):
            generators.random_regular(spark, n, k)
    with pytest.raises(GraphError):
        generators.configuration_model(spark, spark.createDataFrame([(0, 1), (1, 2)], "id long, degree int"))
    assert generators.random_geometric(spark, 30, 2.0).edges.count() == 30 * 29
