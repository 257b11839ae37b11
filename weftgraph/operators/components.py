"""Connected components of edge lists of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.runtime import materialize


def star_components(edges: DataFrame, name: str = "cc", max_rounds: int = 60, loops: bool = True) -> DataFrame:
    """``edges(u, v)`` -> ``(id, component)`` for every endpoint; component = smallest reachable id.

    Alternates large-star and small-star rewrites until the edge list is a set of stars. Each
    round is two partially aggregated shuffles, the number of rounds is logarithmic in practice,
    and a hub costs one row per incident edge (never a quadratic expansion). Self-loops make
    their vertex appear with itself, unless ``loops`` is false: the input is then read once. Nulls are dropped.
    """
    e = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u is not null and v is not null")
    alone = e.where("u = v").select(F.col("u").alias("id"), F.col("u").alias("component"))
    cur = materialize(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    before = None
    for _ in range(max_rounds):
        sym = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low2.select("u", F.col("m").alias("v")))
            .distinct()
        )
        cur = materialize(small, name)
        after = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    ids = cur.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = cur.select(F.col("v").alias("id"), F.col("v").alias("component"))
    return (ids.union(roots).union(alone) if loops else ids.union(roots)).groupBy("id").agg(F.min("component").alias("component"))
