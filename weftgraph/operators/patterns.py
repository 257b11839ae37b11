"""Subgraph matching, cliques, products and labelled line graphs, compiled to chains of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import Graph, GraphError
from weftgraph.operators.access import out_degree
from weftgraph.operators.neighbourhoods import clique_rows
from weftgraph.runtime import materialize

MODES = ("monomorphism", "induced", "isomorphism")


def match_pattern(g: Graph, pattern: list[tuple[int, int]], mode: str = "monomorphism", labels: DataFrame | None = None, want: dict[int, str] | None = None) -> DataFrame:
    """Embeddings (v0, v1, ..) of a small pattern with vertices 0..k-1: one equi-join for each pattern edge.

    ``mode``: monomorphism asks for the pattern's edges, induced also forbids all others between the matched
    vertices, isomorphism is induced on a graph with as many vertices. ``labels(id, label)`` and ``want`` (pattern vertex ->
    label) restrict vertices. The pattern must be connected. Pattern edges follow the graph's direction. Loops of g match nothing.
    """
    if mode not in MODES:
        raise GraphError(f"mode is one of {MODES}")
    order, left = [pattern[0][0]] if pattern else [], sorted({v for e in pattern for v in e})
    if left != list(range(len(left))) or not pattern:
        raise GraphError("a pattern has edges between vertices 0..k-1")
    k = len(left)
    edges = g.edges.where("src <> dst").select("src", "dst").distinct()
    if mode == "isomorphism" and g.vertices.count() != k:
        return g.vertices.sparkSession.createDataFrame([], ", ".join(f"v{i} long" for i in range(k)))

    def allowed(v: int, rows: DataFrame) -> DataFrame:
        if not want or v not in want:
            return rows
        ids = labels.where(F.col("label") == want[v]).select(F.col("id").alias(f"v{v}"))
        return rows.join(ids, f"v{v}", "left_semi")

    both = {(a, b) for a, b in pattern} | (set() if g.directed else {(b, a) for a, b in pattern})
    out = None
    while len(order) < k or out is None:
        a, b, forward = next(((a, b, True) for a, b in sorted(both) if a in order and b not in order), None) or next(((b, a, False) for a, b in sorted(both) if b in order and a not in order), (None, None, None))
        if a is None:
            raise GraphError("the pattern is not connected")
        step = edges.select(F.col("src" if forward else "dst").alias(f"v{a}"), F.col("dst" if forward else "src").alias(f"v{b}"))
        out = allowed(a, step) if out is None else out.join(step, f"v{a}")
        for u in order:
            if u != a:
                out = out.where(F.col(f"v{u}") != F.col(f"v{b}"))
        order.append(b)
        out = allowed(b, out)
        for u in order[:-1]:  # the other edges between b and what is matched: kept by semi-joins, forbidden ones by anti-joins
            for x, y in ((u, b), (b, u)) if g.directed else ((u, b),):
                here = {x, y} == {a, b} and ((x, y) == (a, b)) == forward if g.directed else {x, y} == {a, b}
                if here:
                    continue
                pair = edges.select(F.col("src").alias(f"v{x}"), F.col("dst").alias(f"v{y}"))
                if (x, y) in both:
                    out = out.join(pair, [f"v{x}", f"v{y}"], "left_semi")
                elif mode != "monomorphism":
                    out = out.join(pair, [f"v{x}", f"v{y}"], "left_anti")
    return out.select(*[f"v{i}" for i in range(k)])


def cliques(g: Graph, size: int) -> DataFrame:
    """(v0 < .. by rank) all cliques of that size, along edges that point to the higher (degree, id); those of three vertices and more grow inside tasks."""
    if size < 2:
        return g.vertices.select(F.col("id").alias("v0"))
    e = g.edges.where("src <> dst").select("src", "dst").distinct()
    if size > 2:
        return clique_rows(e, size)
    d = out_degree(g)
    e = e.join(d.select(F.col("id").alias("src"), F.col("degree").alias("ds")), "src").join(d.select(F.col("id").alias("dst"), F.col("degree").alias("dd")), "dst")
    return e.where(F.struct("ds", "src") < F.struct("dd", "dst")).select(F.col("src").alias("v0"), F.col("dst").alias("v1"))


def maximum_cliques(g: Graph) -> DataFrame:
    """(size, members): every clique of the largest size. Each level extends the cliques of the one before and is written."""
    up = materialize(cliques(g, 2), "clique-edges")
    level, size = up, 2
    if up.isEmpty():
        return g.vertices.select(F.lit(1).alias("size"), F.array("id").alias("members"))
    while True:
        last, new = f"v{size - 1}", f"v{size}"
        more = level.join(up.select(F.col("v0").alias(last), F.col("v1").alias(new)), last)
        for j in range(size - 1):
            more = more.join(up.select(F.col("v0").alias(f"v{j}"), F.col("v1").alias(new)), [f"v{j}", new], "left_semi")
        more = materialize(more.select(*[f"v{i}" for i in range(size + 1)]), "cliques")
        if more.isEmpty():
            return level.select(F.lit(size).alias("size"), F.array_sort(F.array(*[f"v{i}" for i in range(size)])).alias("members"))
        level, size = more, size + 1


def labelled_line_graph(g: Graph, labels: DataFrame) -> DataFrame:
    """(a_src, a_dst, b_src, b_dst, shared, label): pairs of edges that share a vertex, with that vertex and its label(id, label)."""
    v = g.edges.where("src < dst").select("src", "dst")
    ends = v.select("src", "dst", F.explode(F.array("src", "dst")).alias("shared"))
    a, b = (ends.select("shared", F.struct("src", "dst").alias(x)) for x in "ab")
    pairs = a.join(b, "shared").where(F.col("a") < F.col("b")).join(labels.select(F.col("id").alias("shared"), "label"), "shared", "left")
    return pairs.select(F.col("a.src").alias("a_src"), F.col("a.dst").alias("a_dst"), F.col("b.src").alias("b_src"), F.col("b.dst").alias("b_dst"), "shared", "label")


def adjacent_product(pairs: DataFrame, g: Graph, h: Graph) -> DataFrame:
    """(u1, v1, u2, v2): the half of the modular product in which both graphs have an edge, driven by the edges of both: no pairs are crossed."""
    p1, p2 = (pairs.select(F.col("u").alias(f"u{i}"), F.col("v").alias(f"v{i}")) for i in (1, 2))
    left = g.edges.where("src <> dst").select(F.col("src").alias("u1"), F.col("dst").alias("u2"))
    right = h.edges.where("src <> dst").select(F.col("src").alias("v1"), F.col("dst").alias("v2"))
    out = p1.join(left, "u1").join(right, "v1").join(p2, ["u2", "v2"], "left_semi")
    return out.where(F.struct("u1", "v1") < F.struct("u2", "v2")).select("u1", "v1", "u2", "v2")


def label_bounds(g: Graph, h: Graph, labels_g: DataFrame, labels_h: DataFrame) -> DataFrame:
    """(common_vertices, common_edges): upper bounds on a common subgraph from counts of vertex and edge labels."""

    def vertex_counts(x: Graph, lab: DataFrame, name: str) -> DataFrame:
        return x.vertices.join(lab, "id").groupBy("label").agg(F.count("*").alias(name))

    def edge_counts(x: Graph, lab: DataFrame, name: str) -> DataFrame:
        a, b = lab.select(F.col("id").alias("src"), F.col("label").alias("la")), lab.select(F.col("id").alias("dst"), F.col("label").alias("lb"))
        e = x.edges.where("src < dst").join(a, "src").join(b, "dst")
        return e.groupBy(F.least("la", "lb").alias("p"), F.greatest("la", "lb").alias("q")).agg(F.count("*").alias(name))

    v = vertex_counts(g, labels_g, "m").join(vertex_counts(h, labels_h, "n"), "label").agg(F.coalesce(F.sum(F.least("m", "n")), F.lit(0)).alias("common_vertices"))
    e = edge_counts(g, labels_g, "m").join(edge_counts(h, labels_h, "n"), ["p", "q"]).agg(F.coalesce(F.sum(F.least("m", "n")), F.lit(0)).alias("common_edges"))
    return v.crossJoin(e)
