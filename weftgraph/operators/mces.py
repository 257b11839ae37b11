"""Largest common edge subgraphs of many pairs of small labelled graphs at once: every relation carries the number of its pair.

Graphs come as vertices(graph, id, label) and edges(graph, src, dst, label), src < dst; labels may be null and equal null. A common
subgraph is a clique of the product of both line graphs; the product is a join of edges of equal labels, cliques grow a vertex a level.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.runtime import materialize, materialize_with

#: A product vertex is its first part times this, plus its second.
SPAN = 1 << 20


def _kept(df: DataFrame, name: str) -> DataFrame:
    """``materialize``, joined by sorting: tables of many pairs are a few bytes a row on disk, so that the planner would broadcast what fills a driver."""
    return materialize(df, name).hint("merge")


def _kept_with(df: DataFrame, name: str, **aggregates: Column) -> tuple[DataFrame, dict]:
    out, facts = materialize_with(df, name, **aggregates)
    return out.hint("merge"), facts


def degree_bounds(vertices: DataFrame, edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair, common_vertices, common_edges, similarity): upper bounds for pairs(pair, a, b), before any search.

    Vertices of one label are matched by rank of degree; an edge is counted at both ends. The similarity is the square of vertices and
    edges in common over the product of those of both graphs.
    """
    ends = edges.select("graph", F.explode(F.array("src", "dst")).alias("id")).groupBy("graph", "id").agg(F.count("*").alias("d"))
    ranked = vertices.join(ends, ["graph", "id"], "left").fillna(0, ["d"]).withColumn("r", F.row_number().over(Window.partitionBy("graph", "label").orderBy(F.desc("d"), "id")))
    one, two = (ranked.select(F.col("graph").alias(g), F.col("label").alias(f"label_{g}"), F.col("r").alias(f"r_{g}"), F.col("d").alias(f"d_{g}")) for g in "ab")
    one, two, pairs = one.hint("merge"), two.hint("merge"), pairs.hint("merge")
    both = pairs.join(one, "a").join(two.withColumnRenamed("b", "b2"), F.col("b").eqNullSafe(F.col("b2")) & F.col("label_a").eqNullSafe(F.col("label_b")) & (F.col("r_a") == F.col("r_b")))
    found = both.groupBy("pair").agg(F.count("*").alias("v"), F.floor(F.sum(F.least("d_a", "d_b")) / 2).alias("e"))
    sizes = vertices.groupBy("graph").agg(F.count("*").alias("n")).join(edges.groupBy("graph").agg(F.count("*").alias("m")), "graph", "left").select("graph", (F.col("n") + F.coalesce("m", F.lit(0))).alias("size")).hint("merge")
    size_a, size_b = (sizes.select(F.col("graph").alias(g), F.col("size").alias(f"size_{g}")).hint("merge") for g in "ab")
    out = pairs.join(found.hint("merge"), "pair", "left").fillna(0, ["v", "e"]).join(size_a, "a", "left").join(size_b, "b", "left").fillna(0, ["size_a", "size_b"])
    share = F.try_divide((F.col("v") + F.col("e")) * (F.col("v") + F.col("e")), F.col("size_a") * F.col("size_b"))
    return out.select("pair", F.col("v").cast("long").alias("common_vertices"), F.col("e").cast("long").alias("common_edges"), F.coalesce(share, F.lit(0.0)).alias("similarity"))


def _numbered_edges(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, e, src, dst, label, p, q): edges numbered within their graph, with both ends' labels in order."""
    a, b = (vertices.select("graph", F.col("id").alias(c), F.col("label").alias(f"l_{c}")) for c in ("src", "dst"))
    e = edges.join(a, ["graph", "src"], "left").join(b, ["graph", "dst"], "left")
    low = F.when(F.col("l_src").isNull() | F.col("l_dst").isNull(), None).otherwise(F.least("l_src", "l_dst"))  # nulls come first
    number = F.row_number().over(Window.partitionBy("graph").orderBy("src", "dst")) - 1
    return e.select("graph", number.cast("long").alias("e"), "src", "dst", "label", low.alias("p"), F.greatest("l_src", "l_dst").alias("q"))


def _shared(vertices: DataFrame, e: DataFrame) -> DataFrame:
    """(graph, e, f, at): pairs of edges, both ways, that share a vertex, with its label."""
    ends = e.select("graph", "e", F.explode(F.array("src", "dst")).alias("id"))
    pairs = ends.join(ends.withColumnRenamed("e", "f"), ["graph", "id"]).where("e <> f")
    return pairs.join(vertices, ["graph", "id"], "left").select("graph", "e", "f", F.col("label").alias("at"))


def line_graph_product(vertices: DataFrame, edges: DataFrame, pairs: DataFrame, accept: Callable[[], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(pair, x) and (pair, x, y), x < y, of the product of each pair's line graphs; x = first edge * SPAN + second edge.

    A product vertex is an edge of either graph, with equal labels of edge and ends; ``accept`` may ask more, as a column of
    src1, dst1, label1, src2, dst2, label2. Two are joined if their edges differ in both graphs and share a vertex of one label in both, or none in either.
    """
    e = _kept(_numbered_edges(vertices, edges), "mces-e")
    one, two = (e.select(F.col("graph").alias(g), F.col("e").alias(f"e{k}"), *(F.col(c).alias(f"{c}{k}") for c in ("src", "dst", "label", "p", "q"))) for g, k in (("a", 1), ("b", 2)))
    same = F.col("label1").eqNullSafe(F.col("label2")) & F.col("p1").eqNullSafe(F.col("p2")) & F.col("q1").eqNullSafe(F.col("q2"))
    both = pairs.select("pair", "a", "b").join(one, "a").join(two.withColumnRenamed("b", "b2"), (F.col("b") == F.col("b2")) & same)
    both = both if accept is None else both.where(accept())
    x = _kept(both.select("pair", "a", "b", "e1", "e2", (F.col("e1") * SPAN + F.col("e2")).alias("x")), "mces-x")
    shared = _kept(_shared(vertices, e), "mces-s")
    y = x.select("pair", F.col("e1").alias("f1"), F.col("e2").alias("f2"), F.col("x").alias("y"))
    s1, s2 = (shared.select(F.col("graph").alias(g), F.col("e").alias(f"e{k}"), F.col("f").alias(f"f{k}"), F.struct("at").alias(f"at{k}")) for g, k in (("a", 1), ("b", 2)))
    at = x.join(y, "pair").where("x < y and e1 <> f1 and e2 <> f2").join(s1, ["a", "e1", "f1"], "left").join(s2, ["b", "e2", "f2"], "left")
    return x.select("pair", "x"), _kept(at.where(F.col("at1").eqNullSafe(F.col("at2"))).select("pair", "x", "y"), "mces-p")


def _bound(c: str) -> Column:
    """How many members a clique of the candidates has at most, since either part is used once."""
    parts = [F.size(F.array_distinct(F.transform(c, f))) for f in (lambda x: F.shiftright(x, 20), lambda x: x.bitwiseAND(F.lit(SPAN - 1)))]
    return F.least(*parts)


def partitioned_maximum_cliques(vertices: DataFrame, edges: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(pair, size, members): all largest cliques of each graph, given as (pair, x) and edges (pair, x, y), x < y; members ascend.

    Both parts of x (x div SPAN, x mod SPAN) occur once in a clique, which edges must respect. A clique grows by larger vertices; it is dropped once its size
    and the parts among its candidates fall short of a clique already found greedily. ``sizes``(pair, size) asks for all cliques of that size instead.
    """
    empty = F.array().cast("array<long>")
    near = edges.groupBy("pair", "x").agg(F.array_sort(F.collect_list("y")).alias("near"))
    v = _kept(vertices.join(near, ["pair", "x"], "left").select("pair", "x", F.coalesce("near", empty).alias("near")), "clique-v")
    follow = v.select("pair", F.col("x").alias("y"), F.col("near").alias("near_y"))
    if sizes is None:
        dive, size, most = v.select("pair", F.col("near").alias("cand")), 1, None
        while True:
            here = dive.select("pair").distinct().withColumn("least", F.lit(size))
            most = here if most is None else most.union(here)
            step = dive.where(F.size("cand") > 0).select("pair", F.get("cand", F.lit(0)).alias("y"), "cand").join(follow, ["pair", "y"])
            dive, facts = _kept_with(step.select("pair", F.array_intersect("cand", "near_y").alias("cand")), "clique-dive", n=F.count("*"))
            size += 1
            if not facts["n"]:
                break
        least = _kept(most.groupBy("pair").agg(F.max("least").alias("least")), "clique-least")
    else:
        least = sizes.select("pair", F.col("size").alias("least"))
    level = v.select("pair", F.array("x").alias("members"), F.col("near").alias("cand")).join(least, "pair")
    out, size = None, 1
    while True:
        alive = level.where(F.lit(size) + _bound("cand") >= F.col("least"))
        level, facts = _kept_with(alive, "cliques", n=F.count("*"))
        if not facts["n"]:
            break
        ended = level.where((F.size("cand") == 0) if sizes is None else (F.col("least") == size)).select("pair", F.lit(size).alias("size"), "members")
        out = ended if out is None else out.union(ended)
        grown = level.where(F.size("cand") > 0).withColumn("y", F.explode("cand")).join(follow, ["pair", "y"])
        level = grown.select("pair", F.concat("members", F.array("y")).alias("members"), F.array_intersect(F.filter("cand", lambda c: c > F.col("y")), "near_y").alias("cand"), "least")
        size += 1
    if out is None:
        return v.where("false").select("pair", F.lit(0).alias("size"), F.array("x").alias("members"))
    if sizes is not None:
        return out
    top = out.groupBy("pair").agg(F.max("size").alias("size"))
    return out.join(top.hint("merge"), ["pair", "size"]).select("pair", "size", "members")


def _matched(cliques: DataFrame, e: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair, members, src1, dst1, src2, dst2): the edges that each clique matches."""
    flat = cliques.select("pair", "members", F.explode("members").alias("x")).select("pair", "members", F.shiftright("x", 20).alias("e1"), F.col("x").bitwiseAND(F.lit(SPAN - 1)).alias("e2")).join(pairs.select("pair", "a", "b"), "pair")
    one, two = (e.select(F.col("graph").alias(g), F.col("e").alias(f"e{k}"), F.col("src").alias(f"src{k}"), F.col("dst").alias(f"dst{k}")) for g, k in (("a", 1), ("b", 2)))
    return flat.join(one, ["a", "e1"]).join(two, ["b", "e2"]).select("pair", "members", "src1", "dst1", "src2", "dst2")


def without_exchange(matched: DataFrame) -> DataFrame:
    """(pair, members) of cliques whose two edge sets have equal degrees; a triangle matched to a claw does not."""
    key = ["pair", "members"]
    degrees = []
    for k in (1, 2):
        d = matched.select(*key, F.explode(F.array(f"src{k}", f"dst{k}")).alias("id")).groupBy(*key, "id").agg(F.count("*").alias("d"))
        degrees.append(d.groupBy(*key).agg(F.array_sort(F.collect_list("d")).alias(f"d{k}")))
    return degrees[0].join(degrees[1].hint("merge"), key).where("d1 = d2").select(*key)


def fragments(matched: DataFrame) -> DataFrame:
    """(pair, members, fragment_count, largest_edges, largest_vertices) of each clique's edges in the first graph."""
    key = ["pair", "members"]
    both = matched.select(*key, F.col("src1").alias("u"), F.col("dst1").alias("v"))
    steps = _kept(both.union(both.select(*key, "v", "u")), "fragment-e")
    lab = _kept(steps.select(*key, "u").distinct().withColumn("f", F.col("u")), "fragment")
    while True:
        new = steps.join(lab.select(*key, F.col("u").alias("v"), "f"), [*key, "v"]).groupBy(*key, "u").agg(F.min("f").alias("g"))
        lab, facts = _kept_with(lab.join(new, [*key, "u"]).select(*key, "u", F.least("f", "g").alias("f"), (F.col("g") < F.col("f")).alias("moved")), "fragment", n=F.count(F.when(F.col("moved"), 1)))
        lab = lab.drop("moved")
        if not facts["n"]:
            break
    v = lab.groupBy(*key, "f").agg(F.count("*").alias("nv"))
    e = both.join(lab, [*key, "u"]).groupBy(*key, "f").agg(F.count("*").alias("ne"))
    return v.join(e.hint("merge"), [*key, "f"]).groupBy(*key).agg(F.count("*").alias("fragment_count"), F.max("ne").alias("largest_edges"), F.max("nv").alias("largest_vertices"))


def vertex_matches(matched: DataFrame, vertices: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair, members, v1, v2): the vertices that matched edges make correspond.

    A vertex of several matched edges goes to the end that all their images share, which settles their other ends; for an edge apart the smaller ends
    correspond if their labels allow it, and else the smaller to the larger.
    """
    key = ["pair", "members"]
    m = matched.select(*key, *(F.col(c) for c in ("src1", "dst1", "src2", "dst2")))
    ends = m.select(*key, F.struct("src1", "dst1").alias("e"), F.explode(F.array(*[F.struct(F.col(a).alias("v1"), F.col(b).alias("v2")) for a in ("src1", "dst1") for b in ("src2", "dst2")])).alias("x")).select(*key, "e", "x.v1", "x.v2")
    degree = ends.groupBy(*key, "v1").agg((F.count("*") / 2).alias("d"))
    held = ends.groupBy(*key, "v1", "v2").agg(F.count("*").alias("n")).join(degree.hint("merge"), [*key, "v1"]).where("n = d")
    fixed = _kept(held.where("d > 1").select(*key, "v1", "v2"), "fixed")
    # the other end of an edge of a settled vertex goes to the other end of the image
    other = None
    for a, b in (("src1", "dst1"), ("dst1", "src1")):
        x = m.join(fixed.withColumnRenamed("v1", a), [*key, a]).where("v2 = src2 or v2 = dst2").select(*key, F.col(b).alias("v1"), F.when(F.col("v2") == F.col("src2"), F.col("dst2")).otherwise(F.col("src2")).alias("v2"))
        other = x if other is None else other.union(x)
    touched = _kept(fixed.union(other).distinct(), "touched")
    done = touched.select(*key, "v1").distinct()
    done = done.hint("merge")
    lone = m.join(done.withColumnRenamed("v1", "src1"), [*key, "src1"], "left_anti").join(done.withColumnRenamed("v1", "dst1"), [*key, "dst1"], "left_anti").join(pairs.select("pair", "a", "b"), "pair")
    for g, c in (("a", "src1"), ("a", "dst1"), ("b", "src2"), ("b", "dst2")):
        lone = lone.join(vertices.select(F.col("graph").alias(g), F.col("id").alias(c), F.col("label").alias(f"l_{c}")), [g, c], "left")
    straight = F.col("l_src1").eqNullSafe(F.col("l_src2")) & F.col("l_dst1").eqNullSafe(F.col("l_dst2"))
    apart = lone.select(*key, F.explode(F.array(F.struct(F.col("src1").alias("v1"), F.when(straight, F.col("src2")).otherwise(F.col("dst2")).alias("v2")), F.struct(F.col("dst1").alias("v1"), F.when(straight, F.col("dst2")).otherwise(F.col("src2")).alias("v2")))).alias("x"))
    return touched.union(apart.select(*key, "x.v1", "x.v2"))


def mces(vertices: DataFrame, edges: DataFrame, pairs: DataFrame, least_similarity: float = 0.0, exchange: bool = False, accept: Callable[[], Column] | None = None, order: list[Column] | None = None) -> DataFrame:
    """(pair, common_edges, common_vertices, fragment_count, largest_edges, largest_vertices, similarity, matched, mapping) for pairs(pair, a, b).

    The common subgraph of most edges; of several the one of fewest fragments, then the largest fragment by edges, then the first, or by the
    columns of ``order``. Pairs whose ``degree_bounds`` similarity is below ``least_similarity`` are left out. Unless ``exchange``, cliques that match
    a triangle to a claw do not count; where all of a size do, smaller ones are searched. Pairs without a common edge have zeros.
    """
    vertices, edges = _kept(vertices.select("graph", "id", "label"), "mces-v"), _kept(edges.select("graph", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "label").where("src <> dst").distinct(), "mces-e")
    bounds = degree_bounds(vertices, edges, pairs)
    pairs = _kept(pairs.join(bounds.where(F.col("similarity") >= least_similarity).select("pair").hint("merge"), "pair", "left_semi"), "mces-pairs")
    x, product = line_graph_product(vertices, edges, pairs, accept)
    e = _kept(_numbered_edges(vertices, edges), "mces-e")
    found = _kept(partitioned_maximum_cliques(x, product), "mces-cliques")
    good = found
    if not exchange:
        good, open_pairs = None, found
        while True:
            fine = _kept(open_pairs.join(without_exchange(_matched(open_pairs, e, pairs)).hint("merge"), ["pair", "members"], "left_semi"), "mces-fine")
            good = fine if good is None else good.union(fine)
            less = open_pairs.join(fine.select("pair"), "pair", "left_anti").select("pair", (F.col("size") - 1).alias("size")).distinct()
            less, facts = _kept_with(less.where("size > 0"), "mces-less", n=F.count("*"))
            if not facts["n"]:
                break
            open_pairs = _kept(partitioned_maximum_cliques(x.join(less, "pair", "left_semi"), product.join(less, "pair", "left_semi"), less), "mces-cliques")
    matched = _kept(_matched(good, e, pairs), "mces-matched")
    ranked = good.join(fragments(matched).hint("merge"), ["pair", "members"])
    by = order or [F.asc("fragment_count"), F.desc("largest_edges")]
    best = _kept(ranked.withColumn("k", F.row_number().over(Window.partitionBy("pair").orderBy(*by, "members"))).where("k = 1").drop("k"), "mces-best")
    own = _kept(matched.join(best.select("pair", "members"), ["pair", "members"], "left_semi"), "mces-own")
    shown = own.groupBy("pair").agg(F.array_sort(F.collect_list(F.struct("src1", "dst1", "src2", "dst2"))).alias("matched"))
    mapping = vertex_matches(own, vertices, pairs).groupBy("pair").agg(F.array_sort(F.collect_list(F.struct("v1", "v2"))).alias("mapping"))
    sizes = vertices.groupBy("graph").agg(F.count("*").alias("n")).join(edges.groupBy("graph").agg(F.count("*").alias("m")), "graph", "left").select("graph", (F.col("n") + F.coalesce("m", F.lit(0))).alias("size")).hint("merge")
    out = pairs.join(best.drop("members").withColumnRenamed("size", "common_edges").hint("merge"), "pair", "left").join(shown.hint("merge"), "pair", "left").join(mapping.hint("merge"), "pair", "left")
    for g in "ab":
        out = out.join(sizes.select(F.col("graph").alias(g), F.col("size").alias(f"size_{g}")).hint("merge"), g, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    n_v, n_e = zero(F.when(F.col("mapping").isNotNull(), F.size("mapping"))), zero(F.col("common_edges"))
    share = F.coalesce(F.try_divide((n_v + n_e) * (n_v + n_e), F.col("size_a") * F.col("size_b")), F.lit(0.0))
    return out.select("pair", n_e.alias("common_edges"), n_v.alias("common_vertices"), *(zero(F.col(c)).alias(c) for c in ("fragment_count", "largest_edges", "largest_vertices")), share.alias("similarity"), "matched", "mapping")
