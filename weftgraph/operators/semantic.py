"""Information content and the similarities built on it, over DAGs stored as edges from general to special."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import Graph, GraphError
from weftgraph.operators.iterative import hops, kahn_layers
from weftgraph.runtime import materialize


def information_content(g: Graph, occurrences: DataFrame) -> DataFrame:
    """(id, ic): -ln(propagated / total occurrences); a vertex passes its count to each predecessor once per edge.

    Layers of the DAG are taken from the deepest up, one join and sum each. A sink without occurrences is refused.
    """
    occ = g.vertices.join(occurrences.groupBy("id").agg(F.sum("n").alias("n")), "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("decimal(38,0)").alias("own"))
    occ = materialize(occ, "occurrences")
    if not occ.where("own <= 0").join(g.edges.select(F.col("src").alias("id")), "id", "left_anti").isEmpty():
        raise GraphError("a sink has no occurrences")
    layers = materialize(kahn_layers(g).join(occ, "id"), "ic-layers")
    total = occ.agg(F.sum("own").cast("double")).first()[0]
    done = None
    for depth in range(layers.agg(F.max("layer")).first()[0] or 0, -1, -1):
        here = layers.where(F.col("layer") == depth).select("id", "own")
        if done is None:
            got = here.select("id", F.col("own").alias("prop"))
        else:
            up = g.edges.join(done.select(F.col("id").alias("dst"), "prop"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("prop").cast("decimal(38,0)").alias("got"))
            got = here.join(up, "id", "left").select("id", (F.col("own") + F.coalesce("got", F.lit(0))).cast("decimal(38,0)").alias("prop"))
        got = materialize(got, "ic")
        done = got if done is None else done.union(got)
    return done.select("id", (-F.log(F.col("prop").cast("double") / F.lit(total))).alias("ic"))


def _ancestors(g: Graph, ids: DataFrame) -> DataFrame:
    """(src, id): src's ancestors and src itself."""
    back = Graph(g.vertices, g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"), True)
    return hops(back, ids.select(F.col("id").alias("src"))).select("src", "id")


def resnik(g: Graph, ic: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, resnik): the largest ic of a common ancestor-or-self, at least 0; 0 for equal ids."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    anc = materialize(_ancestors(g, ids).join(ic, "id"), "anc")
    both = pairs.join(anc.select(F.col("src").alias("a"), F.col("id").alias("top"), "ic"), "a").join(anc.select(F.col("src").alias("b"), F.col("id").alias("top")), ["b", "top"])
    best = both.groupBy("a", "b").agg(F.max("ic").alias("m"))
    return pairs.join(best, ["a", "b"], "left").select("a", "b", F.when(F.col("a") == F.col("b"), 0.0).otherwise(F.greatest(F.coalesce("m", F.lit(0.0)), F.lit(0.0))).alias("resnik"))


def lin(g: Graph, ic: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, lin): 2 resnik / (ic a + ic b); 1 for equal ids."""
    x = resnik(g, ic, pairs).join(ic.select(F.col("id").alias("a"), F.col("ic").alias("ia")), "a").join(ic.select(F.col("id").alias("b"), F.col("ic").alias("ib")), "b")
    return x.select("a", "b", F.when(F.col("a") == F.col("b"), 1.0).otherwise(2 * F.col("resnik") / F.greatest(F.col("ia") + F.col("ib"), F.lit(2.220446049250313e-16))).alias("lin"))


def wu_palmer_tree(g: Graph, root: int, pairs: DataFrame) -> DataFrame:
    """(a, b, wu_palmer) on a tree: 2 depth(deepest common ancestor) / (depth a + depth b), the root at depth 1."""
    depth = materialize(hops(g, g.vertices.where(F.col("id") == root).select(F.col("id").alias("src"))).select("id", (F.col("depth") + 1).alias("d")), "depth")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    anc = materialize(_ancestors(g, ids).join(depth, "id"), "anc")
    both = pairs.join(anc.select(F.col("src").alias("a"), F.col("id").alias("top"), "d"), "a").join(anc.select(F.col("src").alias("b"), F.col("id").alias("top")), ["b", "top"])
    best = both.groupBy("a", "b").agg(F.max("d").alias("m"))
    x = best.join(depth.select(F.col("id").alias("a"), F.col("d").alias("da")), "a").join(depth.select(F.col("id").alias("b"), F.col("d").alias("db")), "b")
    return x.select("a", "b", F.when(F.col("a") == F.col("b"), 1.0).otherwise(2.0 * F.col("m") / (F.col("da") + F.col("db"))).alias("wu_palmer"))
