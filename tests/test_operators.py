"""Small graphs with known answers, edge cases included."""

import numpy as np
import pytest

from weftgraph.graph import Graph, GraphError
from weftgraph.operators import access as A
from weftgraph.operators import iterative as I
from weftgraph.operators import motifs as M
from weftgraph.sources import generators as N


def graph(spark, n, edges, directed=False, **kw):
    return Graph.build(spark.range(n), spark.createDataFrame([(a, b) for a, b in edges], "src long, dst long"), directed, **kw)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_build_refuses_repeats_and_strangers(spark):
    with pytest.raises(GraphError):
        graph(spark, 3, [(0, 1), (1, 0)], check=True)
    with pytest.raises(GraphError):
        graph(spark, 2, [(0, 5)], check=True)
    assert graph(spark, 3, [(0, 1), (1, 0)], ignore_duplicates=True, check=True).edges.count() == 2


def test_loops_count_once(spark):
    g = graph(spark, 3, [(0, 0), (0, 1)])
    assert rows(A.out_degree(g), "id", "degree") == [(0, 2), (1, 1), (2, 0)]


def test_roots_sinks_singletons(spark):
    g = graph(spark, 4, [(0, 1), (1, 2)], True)
    assert rows(A.root_nodes(g), "id") == [(0,), (3,)]
    assert rows(A.sink_nodes(g), "id") == [(2,)]
    assert rows(A.singleton_nodes(g), "id") == [(3,)]


def test_triangles_of_known_families(spark):
    assert M.triangles(N.complete(spark, 6)).count() == 20
    assert M.triangles(N.grid(spark, 4, 4)).count() == 0
    assert M.triangles(N.friendship(spark, 5)).count() == 5


def test_squares_of_a_cycle(spark):
    assert {s for _, s in rows(M.square_count(N.cycle(spark, 4)), "id", "squares")} == {1}
    assert {s for _, s in rows(M.square_count(N.cycle(spark, 5)), "id", "squares")} == {0}


def test_core_numbers(spark):
    g = graph(spark, 6, [(0, 1), (0, 2), (1, 2), (2, 3), (4, 4)])
    assert rows(I.core_numbers(g), "id", "core") == [(0, 2), (1, 2), (2, 2), (3, 1), (4, 1), (5, 0)]


def test_components_and_trees(spark):
    g = graph(spark, 5, [(0, 1), (3, 4)])
    assert rows(I.connected_components(g), "id", "component") == [(0, 0), (1, 0), (2, 2), (3, 3), (4, 3)]
    assert I.tree_facts(g).first().asDict() == {"components": 3, "is_forest": True, "is_tree": False, "cycle_rank": 0}
    assert I.tree_facts(N.path(spark, 4)).first()["is_tree"]
    assert I.tree_facts(N.cycle(spark, 4)).first()["cycle_rank"] == 1


def test_odd_cycles_are_not_bipartite(spark):
    assert {c for _, c in rows(I.bipartite_coloring(N.cycle(spark, 6)), "id", "color")} == {0, 1}
    assert {r["color"] for r in I.bipartite_coloring(N.cycle(spark, 5)).collect()} == {None}


def test_cycles_and_layers(spark):
    assert I.has_cycle(graph(spark, 2, [(0, 1), (1, 0)], True)).first()[0]
    g = graph(spark, 4, [(0, 1), (0, 2), (1, 3), (2, 3), (0, 3)], True)
    assert rows(I.kahn_layers(g), "id", "layer") == [(0, 0), (1, 1), (2, 1), (3, 2)]


def test_strong_components(spark):
    g = graph(spark, 6, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3), (4, 5)], True)
    assert rows(I.strongly_connected_components(g), "id", "component") == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 3), (5, 5)]


def test_distances(spark):
    e = spark.createDataFrame([(0, 1, 4.0), (0, 2, 1.0), (2, 1, 2.0), (1, 3, 1.0)], "src long, dst long, weight double")
    g = Graph.build(spark.range(4), e, True)
    src = spark.createDataFrame([(0,)], "src long")
    assert rows(I.shortest_distances(g, src), "id", "distance") == [(0, 0.0), (1, 3.0), (2, 1.0), (3, 4.0)]
    bad = Graph.build(spark.range(2), spark.createDataFrame([(0, 1, -1.0), (1, 0, 0.5)], "src long, dst long, weight double"), True)
    with pytest.raises(GraphError):
        I.shortest_distances(bad, src)
    with pytest.raises(GraphError):
        I.all_pairs_shortest(bad)


def test_diameter_needs_a_connected_graph(spark):
    assert I.diameter(N.path(spark, 5)).first()[0] == 4
    with pytest.raises(GraphError):
        I.diameter(graph(spark, 3, [(0, 1)]))


def test_pagerank_sums_to_one(spark):
    s = I.pagerank(graph(spark, 4, [(0, 1), (1, 2)]), rounds=10).collect()
    assert abs(sum(r["score"] for r in s) - 1) < 1e-6


def test_empty_graph(spark):
    g = graph(spark, 0, [])
    assert A.out_degree(g).count() == 0 and M.triangles(g).count() == 0 and I.connected_components(g).count() == 0


def test_random_generators_repeat(spark):
    assert rows(N.gnp(spark, 7, 20, 0.3).edges, "src", "dst") == rows(N.gnp(spark, 7, 20, 0.3).edges, "src", "dst")
    assert I.tree_facts(N.random_tree(spark, 3, 15)).first()["is_tree"]


def test_entry_imports_and_registers():
    import __spark_entry__ as e

    assert "triangles_copart" in e.queries() and set(e.oracle_sql()) <= set(e.queries())


def test_scores_run_to_convergence_or_fail(spark):
    g = graph(spark, 5, [(0, 1), (1, 2), (2, 3), (3, 4)])
    score = {r["id"]: r["score"] for r in I.eigenvector_centrality(g).collect()}
    exact = np.sin(np.arange(1, 6) * np.pi / 6)
    assert np.allclose([score[i] for i in range(5)], exact / np.linalg.norm(exact), atol=1e-4)
    for f in (I.pagerank, I.katz, I.eigenvector_centrality):
        with pytest.raises(GraphError):
            f(g, most=1)


def test_diameter_searches_where_sweeps_do_not_settle_it(spark):
    """In an odd cycle the bound of the sweeps stays above the longest distance found."""
    assert I.diameter(graph(spark, 5, [(i, (i + 1) % 5) for i in range(5)]).kept(), batch=1).first()[0] == 2


def test_closeness_in_batches(spark):
    g = graph(spark, 4, [(0, 1), (1, 2), (0, 2), (2, 3)]).kept()
    assert rows(I.closeness(g, pairs=8), "id", "score") == [(0, 0.75), (1, 0.75), (2, 1.0), (3, 0.6)]
