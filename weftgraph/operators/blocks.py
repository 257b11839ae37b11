"""Bridges, blocks and articulation points: a breadth-first forest, subtree extents, and components of tree edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import Graph
from weftgraph.operators.components import star_components
from weftgraph.runtime import materialize


def forest(g: Graph) -> tuple[DataFrame, int]:
    """(id, parent, depth, root) of a breadth-first forest, and its depth; the root of a component is its smallest id."""
    e = g.edges.where("src <> dst").select("src", "dst").distinct()
    loops = g.vertices.select(F.col("id").alias("u"), F.col("id").alias("v"))
    comp = star_components(e.select(F.col("src").alias("u"), F.col("dst").alias("v")).union(loops))
    tree = front = materialize(comp.where("id = component").select("id", F.lit(None).cast("long").alias("parent"), F.lit(0).alias("depth"), F.col("id").alias("root")), "forest")
    depth = 0
    while True:
        step = front.select(F.col("id").alias("src"), "root").join(e, "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"), F.min("root").alias("root"))
        new = materialize(step.join(tree.select("id"), "id", "left_anti").select("id", "parent", F.lit(depth + 1).alias("depth"), "root"), "front")
        if new.isEmpty():
            return tree, depth
        tree, front, depth = tree.union(new), new, depth + 1


def _numbered(tree: DataFrame, deepest: int) -> DataFrame:
    """(id, parent, depth, pre, size): preorder numbers within each tree, children by id, and subtree sizes; a pass a level up, one down."""
    sizes = None
    for d in range(deepest, -1, -1):
        rows = tree.where(F.col("depth") == d)
        if sizes is None:
            level = rows.select("id", "parent", F.lit(1).cast("long").alias("size"))
        else:
            below = level.groupBy(F.col("parent").alias("id")).agg(F.sum("size").alias("s"))
            level = rows.join(below, "id", "left").select("id", "parent", (F.coalesce("s", F.lit(0)) + 1).alias("size"))
        level = materialize(level, "sizes")
        sizes = level if sizes is None else sizes.union(level)
    from pyspark.sql.window import Window

    # a child's number: its parent's + 1 + the sizes of the parent's smaller children
    earlier = Window.partitionBy("parent").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    kin = materialize(tree.join(sizes.select("id", "size"), "id").withColumn("before", F.when(F.col("parent").isNotNull(), F.coalesce(F.sum("size").over(earlier), F.lit(0)))), "kin")
    out = level = kin.where("depth = 0").select("id", "parent", "depth", "root", "size", F.lit(0).cast("long").alias("pre"))
    for d in range(1, deepest + 1):
        above = level.select(F.col("id").alias("parent"), F.col("pre").alias("base"))
        level = materialize(kin.where(F.col("depth") == d).join(above, "parent").select("id", "parent", "depth", "root", "size", (F.col("base") + 1 + F.col("before")).alias("pre")), "preorder")
        out = out.union(level)
    return out


def blocks(g: Graph) -> DataFrame:
    """(src, dst, block) for every edge src < dst without loops: its biconnected component, named by its smallest tree edge's lower end.

    Tree edges, named by their child, are joined if a non-tree edge closes a cycle over both: a child's edge meets its
    parent's if the child's subtree has an edge that leaves the parent's subtree, and the edges of two unrelated
    vertices meet if an edge of the graph joins these. The blocks are the components of these links; a non-tree edge is in the
    block of its end with the higher preorder number. The number of rounds follows the depth of a breadth-first forest.
    """
    tree, deepest = forest(g.kept("blocks") if hasattr(g, "kept") else g)
    t = materialize(_numbered(tree, deepest), "numbered")
    e = g.edges.where("src < dst").select("src", "dst").distinct()
    at = lambda p: t.select(F.col("id").alias(p), F.col("pre").alias(f"pre_{p}"), F.col("size").alias(f"size_{p}"), F.col("parent").alias(f"parent_{p}"))
    both = e.join(at("src"), "src").join(at("dst"), "dst")
    own = F.col("parent_src").eqNullSafe(F.col("dst")) | F.col("parent_dst").eqNullSafe(F.col("src"))
    other = materialize(both.where(~own), "non-tree")
    # smallest and largest preorder number that non-tree edges of a subtree reach
    reach = other.select(F.col("src").alias("id"), F.col("pre_dst").alias("p")).union(other.select(F.col("dst").alias("id"), F.col("pre_src").alias("p"))).groupBy("id").agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    first = materialize(t.join(reach, "id", "left").select("id", "parent", "depth", "pre", "size", F.least("pre", "lo").alias("lo"), F.greatest("pre", "hi").alias("hi")), "reach")
    level = extents = None
    for d in range(deepest, -1, -1):
        rows = first.where(F.col("depth") == d)
        if level is not None:
            below = level.groupBy(F.col("parent").alias("id")).agg(F.min("lo").alias("l"), F.max("hi").alias("h"))
            rows = rows.join(below, "id", "left").select("id", "parent", "depth", "pre", "size", F.least("lo", "l").alias("lo"), F.greatest("hi", "h").alias("hi"))
        level = materialize(rows, "extents")
        extents = level if extents is None else extents.union(level)
    up = extents.select(F.col("id").alias("parent"), F.col("pre").alias("pp"), F.col("size").alias("ps"), F.col("parent").alias("grand"))
    rises = extents.join(up, "parent").where(F.col("grand").isNotNull() & ((F.col("lo") < F.col("pp")) | (F.col("hi") >= F.col("pp") + F.col("ps"))))
    unrelated = other.where("pre_src + size_src <= pre_dst or pre_dst + size_dst <= pre_src")
    links = rises.select(F.col("id").alias("u"), F.col("parent").alias("v")).union(unrelated.select("src", "dst"))
    alone = t.where("parent is not null").select(F.col("id").alias("u"), F.col("id").alias("v"))
    named = star_components(links.union(alone)).select(F.col("id").alias("child"), F.col("component").alias("block"))
    child = F.when(F.col("parent_src").eqNullSafe(F.col("dst")), F.col("src")).when(F.col("parent_dst").eqNullSafe(F.col("src")), F.col("dst")).when(F.col("pre_src") > F.col("pre_dst"), F.col("src")).otherwise(F.col("dst"))
    return both.withColumn("child", child).join(named, "child").select("src", "dst", "block")


def bridges(of: DataFrame) -> DataFrame:
    """Edges (src, dst) that are a block of their own; ``of``: the result of ``blocks``."""
    return of.groupBy("block").agg(F.count("*").alias("k"), F.min("src").alias("src"), F.min("dst").alias("dst")).where("k = 1").select("src", "dst")


def articulation_points(of: DataFrame) -> DataFrame:
    """(id, blocks): vertices in several blocks."""
    ends = of.select("block", F.explode(F.array("src", "dst")).alias("id")).distinct()
    return ends.groupBy("id").agg(F.count("*").alias("blocks")).where("blocks > 1")


def cactus(of: DataFrame) -> DataFrame:
    """(is_cactus): every block is one edge or one cycle, that is, has no more edges than vertices."""
    size = of.groupBy("block").agg(F.count("*").alias("m"))
    ends = of.select("block", F.explode(F.array("src", "dst")).alias("id")).distinct().groupBy("block").agg(F.count("*").alias("n"))
    return size.join(ends, "block").agg(F.coalesce(F.bool_and(F.col("m") <= F.col("n")), F.lit(True)).alias("is_cactus"))
