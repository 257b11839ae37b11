"""Ordered partitions, layered orders, bigraphs and further accessors on small graphs."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from weftgraph.functions.set_similarity import graph_similarities
from weftgraph.graph import Bigraph, Graph, GraphError
from weftgraph.operators import access as A
from weftgraph.operators import iterative as I
from weftgraph.operators import motifs as M
from weftgraph.operators import refinement as R


def graph(spark, edges, n, directed=False, schema="src long, dst long"):
    return Graph.build(spark.range(n), spark.createDataFrame(edges, schema), directed)


def cells(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["cell"], set()).add(r["id"])
    return out


def test_equitable_partitions(spark):
    """A path, a triangle and an isolated vertex: cells by their place, whatever the ids are."""
    g = graph(spark, [(0, 1), (1, 2), (2, 3), (4, 5), (5, 6), (4, 6)], 8)
    got = cells(R.equitable_partition(g))
    assert sorted(map(sorted, got.values())) == [[0, 3], [1, 2], [4, 5, 6], [7]]
    sizes = sorted((c, len(v)) for c, v in got.items())
    assert [c for c, _ in sizes] == list(itertools.accumulate([0, *[n for _, n in sizes[:-1]]]))
    turned = Graph.build(spark.range(8), g.edges.select((7 - F.col("src")).alias("src"), (7 - F.col("dst")).alias("dst")).distinct().where("src < dst"))
    assert {c: {7 - x for x in v} for c, v in cells(R.equitable_partition(turned)).items()} == got
    start = spark.createDataFrame([(4, "b"), (0, "b")], "id long, cell string")  # others have none, and come first
    assert sorted(map(sorted, cells(R.equitable_partition(g, start)).values())) == [[0], [1], [2], [3], [4], [5, 6], [7]]
    heavy = graph(spark, [(0, 1, 1.0), (1, 2, 2.0)], 3, schema="src long, dst long, weight double")
    assert len(cells(R.equitable_partition(heavy))) == 2 and len(cells(R.equitable_partition(heavy, edge_labels=True))) == 3
    assert R.equitable_partition(graph(spark, [], 0)).count() == 0


def test_layered_labels_bring_neighbours_together(spark):
    """Two cliques whose ids alternate: each comes to stand together."""
    edges = [(2 * a + s, 2 * b + s) for s in (0, 1) for a, b in itertools.combinations(range(4), 2)]
    g = graph(spark, edges, 8).kept()
    order = {r["id"]: r["position"] for r in R.layered_label_propagation(g, gammas=(0.25, 0.0), updates=3).collect()}
    assert sorted(order.values()) == list(range(8))
    assert {x % 2 for x in order if order[x] < 4} in ({0}, {1})
    for bad in (lambda: R.layered_label_propagation(g, gammas=()), lambda: R.layered_label_propagation(g, gammas=(math.inf,)), lambda: R.layered_label_propagation(g, updates=0), lambda: R.layered_label_propagation(graph(spark, [(0, 0)], 1))):
        with pytest.raises(GraphError):
            bad()


def test_bigraphs(spark):
    side = lambda *x: spark.createDataFrame([(s,) for s in x], "symbol string")
    edges = lambda *x: spark.createDataFrame(list(x), "src string, dst string, weight double")
    b = Bigraph.build(side("b", "a", "a"), side("x"), edges(("b", "x", 2.0), ("b", "x", 1.0)), ignore_duplicates=True)
    assert [tuple(r) for r in b.edges.collect()] == [(1, 0, 1.0)] and b.left.count() == 2
    with pytest.raises(GraphError):
        Bigraph.build(side("a"), side("x"), edges(("a", "x", 2.0), ("a", "x", 1.0)))
    with pytest.raises(GraphError):
        Bigraph.build(side("a"), side("x"), edges(("a", "y", 2.0)))
    lines = A.dot_document(Graph(b.left.select("id"), b.edges), b.left, b.right).orderBy("part", "line").collect()
    assert [r["line"] for r in lines] == ["graph {", "  L0;", "  L1;", "  R0;", "  L1 -- R0;", "}"]


def test_orders(spark):
    g = graph(spark, [(2, 1), (1, 0), (2, 0)], 4, True)
    assert sorted((r["position"], r["id"]) for r in I.kahn_order(g).collect()) == [(0, 2), (1, 3), (2, 1), (3, 0)]
    for bad in ([(0, 0), (1, 1), (2, 2)], [(0, 0), (1, 1), (2, 2), (3, 2)], [(0, 0), (1, 1), (2, 2), (3, 4)], [(0, 0), (1, 1), (2, 2), (9, 3)]):
        with pytest.raises(GraphError):
            A.applied_order(g, spark.createDataFrame(bad, "id long, position long"))
    assert I.safe_katz_alpha(graph(spark, [(0, 1), (0, 2), (0, 3)], 4)) == 0.3 and I.safe_katz_alpha(graph(spark, [], 2)) == 0.1
    raw = I.katz(graph(spark, [(0, 1)], 2), normalized=False).collect()
    assert all(math.isclose(r["score"], 1 / 0.9, abs_tol=1e-5) for r in raw)


def test_labelled_product(spark):
    shape = "src long, dst long, weight double"
    g, h = graph(spark, [(0, 1, 1.0)], 2, schema=shape), graph(spark, [(0, 1, 2.0)], 2, schema=shape)
    pairs = spark.createDataFrame([(u, v) for u in (0, 1) for v in (0, 1)], "u long, v long")
    assert M.modular_product(pairs, g, h).count() == 2 and M.modular_product(pairs, g, h, labelled=True).count() == 0
    assert M.modular_product(pairs, g, g, labelled=True).count() == 2


def test_similarities_without_anything_in_common(spark):
    row = spark.createDataFrame([(0, 0, 0, 0, 0, 0), (1, 2, 1, 2, 1, 2), (0, 0, 1, 2, 0, 0)], "common_edges long, common_vertices long, first_edges long, first_vertices long, second_edges long, second_vertices long").withColumns(graph_similarities())
    none, same, apart = row.collect()
    names = [c for c in row.columns if c.startswith(("edge_", "vertex_", "johnson"))]
    assert len(names) == 19
    assert all(none[c] == same[c] == 1.0 for c in names)
    assert all(apart[c] == 0.0 for c in names if c != "johnson") and apart["johnson"] == 1.0  # a product of sizes of 0 counts as equal
