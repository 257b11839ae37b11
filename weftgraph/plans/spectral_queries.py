"""Queries of cycle spaces, reductions, stationary distributions and eigenvectors, with the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.graph import Graph
from weftgraph.operators import cycles as C
from weftgraph.operators import spectral as E
from weftgraph.plans.flow_queries import PRICES
from weftgraph.plans.graph_queries import CC, COPART, query
from weftgraph.runtime import materialize
from weftgraph.sources import graphs as G


def _shown(cycles):
    """(length, cycle): edges as text, which is compared more easily than arrays of pairs."""
    return cycles.select("length", F.concat_ws(" ", F.transform("edges", lambda x: F.concat_ws("-", x["src"], x["dst"]))).alias("cycle"))


def _wheels(spark, d, hub: bool = True) -> Graph:
    """Nations of a region in a ring by key, and, with ``hub``, the region (100 + key) joined to all of them."""
    w = Window.partitionBy("n_regionkey")
    n = G.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), "n_regionkey")
    ring = n.select(F.col("id").alias("src"), F.coalesce(F.lead("id").over(w.orderBy("id")), F.min("id").over(w)).alias("dst"))
    v, e = n.select("id"), ring
    if hub:
        v = v.union(n.select(F.col("n_regionkey") + 100).distinct())
        e = e.union(n.select("id", (F.col("n_regionkey") + 100).cast("long")))
    return Graph.build(v, e)


@query("SELECT CAST(sum(n * (n - 1) / 2 - n + 1) AS BIGINT) AS size, CAST(sum(3 * (n * (n - 1) / 2 - n + 1)) AS BIGINT) AS total FROM (SELECT count(*) AS n FROM nation GROUP BY n_regionkey)")
def minimum_cycle_basis(spark, d):
    """Of the complete graphs of each region's nations, whose cycles are sums of triangles."""
    return C.minimum_cycle_basis(G.same_region(spark, d).kept()).agg(F.count("*").alias("size"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("total"))


@query(COPART + CC + "SELECT (SELECT count(*) FROM e WHERE src < dst) - (SELECT count(*) FROM v) + (SELECT count(DISTINCT component) FROM cc) AS size")
def cycle_basis_size(spark, d):
    """A minimum basis of the co-purchase graph has as many cycles as edges less vertices plus components."""
    return C.minimum_cycle_basis(G.copurchase(spark, d).kept()).agg(F.count("*").alias("size"))


@query("SELECT 3 AS length, a.n_nationkey || '-' || b.n_nationkey || ' ' || a.n_nationkey || '-' || c.n_nationkey || ' ' || b.n_nationkey || '-' || c.n_nationkey AS cycle FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey JOIN nation c ON c.n_regionkey = a.n_regionkey AND b.n_nationkey < c.n_nationkey")
def relevant_cycles(spark, d):
    """Of the complete graphs: all their triangles, and nothing longer."""
    return _shown(C.relevant_cycles(G.same_region(spark, d).kept()))


@query("SELECT 3 AS length, least(a, b) || '-' || greatest(a, b) || ' ' || least(a, b) || '-' || (100 + r) || ' ' || greatest(a, b) || '-' || (100 + r) AS cycle FROM (SELECT n_nationkey a, n_regionkey r, coalesce(lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), min(n_nationkey) OVER (PARTITION BY n_regionkey)) b FROM nation)")
def essential_cycles(spark, d):
    """Of the wheels: the triangles at the hub; the rim is their sum."""
    return _shown(C.essential_cycles(_wheels(spark, d).kept()))


@query("SELECT 'ring' AS graph, false AS has_k4 UNION ALL SELECT 'wheel', max(n) >= 3 FROM (SELECT count(*) n FROM nation GROUP BY n_regionkey)")
def has_k4_homeomorph(spark, d):
    rings, wheels = (C.has_k4_homeomorph(_wheels(spark, d, hub).kept()).select(F.lit(name).alias("graph"), "has_k4") for name, hub in (("ring", False), ("wheel", True)))
    return rings.union(wheels)


CHAIN = """WITH t AS (SELECT event_type a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) b FROM events), w AS (SELECT a, b, count(*) w FROM t WHERE b IS NOT NULL GROUP BY 1, 2),
p0 AS (SELECT a, b, w / sum(w) OVER (PARTITION BY a) p FROM w)
"""
POWERS = "".join(f", p{k + 1} AS (SELECT x.a, y.b, sum(x.p * y.p) p FROM p{k} x JOIN p{k} y ON x.b = y.a GROUP BY 1, 2)" for k in range(6))


@query(CHAIN + POWERS + "SELECT b AS event_type, round(avg(p), 9) AS probability FROM p6 GROUP BY b")
def stationary_distribution(spark, d):
    """Of the types of consecutive events; the SQL raises the matrix to the 64th power."""
    w = materialize(G.event_chain(spark, d), "chain")
    sums = w.groupBy("src").agg(F.sum("weight").alias("s"))
    names = materialize(w.select(F.col("src").alias("name")).union(w.select("dst")).distinct().select("name", F.row_number().over(Window.orderBy("name")).cast("long").alias("id")), "types")  # a row for each type
    ids = [names.select(F.col("name").alias(c), F.col("id").alias(f"i_{c}")) for c in ("src", "dst")]
    cells = w.join(sums, "src").join(ids[0], "src").join(ids[1], "dst").select(F.col("i_src").alias("src"), F.col("i_dst").alias("dst"), (F.col("weight") / F.col("s")).alias("value"))
    return E.stationary_distribution(cells).join(names, "id").select(F.col("name").alias("event_type"), F.round("probability", 9).alias("probability"))


@query(PRICES + ", a AS (SELECT x.r i, x.s j, (x.w + y.w) / 2000 v FROM w x JOIN w y ON x.r = y.s AND x.s = y.r) SELECT CAST((SELECT count(*) FROM region) AS BIGINT) AS n, round(sum(v) FILTER (WHERE i = j), 6) AS trace, round(sum(v * v), 6) AS squares, CAST(0 AS BIGINT) AS wrong FROM a")
def eigen(spark, d):
    """Of the regions' least prices (thousands, both ways averaged): number and sums of the eigenvalues and their squares, and the parts of A x - value x beyond 1e-6."""
    p = materialize(G.region_prices(spark, d), "prices")
    cells = materialize(p.join(p.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("weight").alias("w2")), ["src", "dst"]).select("src", "dst", ((F.col("weight") + F.col("w2")) / 2000).alias("value")), "cells")
    values, vectors = E.eigen(cells)
    moved = cells.withColumnRenamed("value", "cell").join(vectors.select("k", F.col("id").alias("dst"), "x"), "dst").groupBy("k", F.col("src").alias("id")).agg(F.sum(F.col("cell") * F.col("x")).alias("y"))
    wrong = moved.join(vectors, ["k", "id"]).join(values, "k").agg(F.count(F.when(F.abs(F.col("y") - F.col("value") * F.col("x")) > 1e-6, 1)).alias("wrong"))
    return values.agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("trace"), F.round(F.sum(F.col("value") * F.col("value")), 6).alias("squares")).crossJoin(wrong)


@query("WITH a AS (SELECT CAST(n_regionkey AS BIGINT) id, avg(c_acctbal) / 1000 x FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1), c AS (SELECT id, x - (SELECT avg(x) FROM a) y FROM a) SELECT id, round(y * (SELECT sign(y) FROM c ORDER BY abs(y) DESC LIMIT 1), 6) AS x, CAST(0 AS DOUBLE) AS stress FROM c")
def classical_mds(spark, d):
    """Regions on a line by the gaps between their customers' mean balances: the means themselves, centred."""
    n = G.table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").cast("long").alias("id"))
    c = G.table(spark, d, "customer")
    a = c.join(n, c.c_nationkey == n.n_nationkey).groupBy("id").agg((F.avg("c_acctbal") / 1000).alias("x"))
    gaps = a.crossJoin(a.select(F.col("id").alias("dst"), F.col("x").alias("y"))).select(F.col("id").alias("src"), "dst", F.abs(F.col("x") - F.col("y")).alias("weight"))  # 5 x 5 regions
    points, off = E.classical_mds(materialize(gaps, "gaps"), dimensions=1)
    return points.crossJoin(off).select("id", F.round(F.get("x", F.lit(0)), 6).alias("x"), F.round("stress", 6).alias("stress"))
