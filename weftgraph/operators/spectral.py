"""Stationary distributions by state reduction, eigenvectors by rotations, and classical scaling."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import Graph, GraphError
from weftgraph.operators.iterative import strongly_connected_components
from weftgraph.operators.matrices import double_center, stress
from weftgraph.runtime import materialize, materialize_with


def stationary_distribution(cells: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """(id, probability) of a row-stochastic matrix cells(src, dst, value); states are the ids of both columns, cells not given are 0.

    Grassmann, Taksar and Heyman's reduction: states leave one after another, their transitions led on to the others, without
    a subtraction; then probabilities come back in the opposite order. Here all states of an independent set leave in a round, those of few transitions first. A
    chain with several closed classes settles in the one that holds the smallest id; other states have 0.
    """
    if not (0 <= tolerance < math.inf):
        raise GraphError("the tolerance is not a finite number of at least 0")
    cells = materialize(cells.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("value").cast("double").alias("p")), "gth")
    p = F.col("p")
    odd = cells.agg(F.count("*").alias("n"), F.count(F.when(p.isNull() | F.isnan(p) | (F.abs(p) == float("inf")), 1)).alias("odd"), F.count(F.when(p < 0, 1)).alias("low")).first()
    for text, wrong in (("the matrix is empty", not odd["n"]), ("a value is not finite", odd["odd"]), ("a value is negative", odd["low"])):
        if wrong:
            raise GraphError(text)
    states = materialize(cells.select(F.col("src").alias("id")).union(cells.select("dst")).distinct(), "gth-v")
    sums = states.join(cells.groupBy(F.col("src").alias("id")).agg(F.sum("p").alias("s")), "id", "left")
    if not sums.where(F.abs(F.coalesce("s", F.lit(0.0)) - 1) > tolerance).isEmpty():
        raise GraphError("a row does not sum to 1")
    steps = cells.where("p > 0").select("src", "dst", F.col("p").alias("weight"))
    parts = materialize(strongly_connected_components(Graph(states, steps, True)), "gth-scc")
    names = [parts.select(F.col("id").alias(c), F.col("component").alias(f"c_{c}")) for c in ("src", "dst")]
    inside = materialize(steps.join(names[0], "src").join(names[1], "dst"), "gth-in")
    leaving = inside.where("c_src <> c_dst").select(F.col("c_src").alias("component")).distinct()
    chosen = parts.join(leaving, "component", "left_anti").agg(F.min("component")).first()[0]
    live = materialize(inside.where((F.col("c_src") == chosen) & (F.col("c_dst") == chosen) & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.sum("weight").alias("p")), "gth-e")
    gone, turn = [], 0
    while True:
        near = live.select("src", "dst").union(live.select("dst", "src")).distinct()
        turn += 1
        rank, facts = materialize_with(near.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d")).select("id", F.struct("d", F.xxhash64("id", F.lit(turn)).alias("h"), "id").alias("r")), "gth-r", n=F.count("*"))
        if facts["n"] == 0:
            break
        low = near.join(rank.select(F.col("id").alias("dst"), "r"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("r").alias("least"))
        out = materialize(rank.join(low, "id").where("r < least").select("id"), "gth-out")
        away = live.join(out.withColumnRenamed("id", "src"), "src").select(F.col("src").alias("k"), F.col("dst").alias("j"), F.col("p").alias("q"))
        total = away.groupBy("k").agg(F.sum("q").alias("s"))
        into = live.join(out.withColumnRenamed("id", "dst"), "dst").select("src", F.col("dst").alias("k"), "p").join(total, "k").select("src", "k", (F.col("p") / F.col("s")).alias("p"))
        into = materialize(into, "gth-into")
        gone.append(into)
        led = into.join(away, "k").where("src <> j").select("src", F.col("j").alias("dst"), (F.col("p") * F.col("q")).alias("p"))
        rest = live.join(out.withColumnRenamed("id", "src"), "src", "left_anti").join(out.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst", "p")
        live = materialize(rest.union(led).groupBy("src", "dst").agg(F.sum("p").alias("p")), "gth-e")
    left = parts.where(F.col("component") == chosen).select("id")
    for into in gone:
        left = left.join(into.select(F.col("k").alias("id")).distinct(), "id", "left_anti")
    known = materialize(left.select("id", F.lit(1.0).alias("w")), "gth-w")
    for into in reversed(gone):
        new = into.join(known.select(F.col("id").alias("src"), "w"), "src").groupBy(F.col("k").alias("id")).agg(F.sum(F.col("w") * F.col("p")).alias("w"))
        known = materialize(known.union(new), "gth-w")
    total = known.agg(F.sum("w").alias("total"))  # one row
    return states.join(known, "id", "left").crossJoin(total).select("id", F.coalesce(F.col("w") / F.col("total"), F.lit(0.0)).alias("probability"))


def _rounds(n: int) -> list[list[tuple[int, int]]]:
    """All pairs of 0..n-1 in rounds of disjoint pairs: one number stays, the others go round."""
    ring = [*range(n), *([None] if n % 2 else [])]
    out = []
    for _ in range(len(ring) - 1):
        half = len(ring) // 2
        pairs = [tuple(sorted((a, b))) for a, b in zip(ring[:half], reversed(ring[half:])) if a is not None and b is not None]
        out.append(pairs)
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return out


def eigen(cells: DataFrame, tolerance: float = 1e-12, sweeps: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(k, value) and (k, id, x): eigenvalues in descending order and unit eigenvectors of a symmetric matrix cells(src, dst, value), all n^2 of them.

    Parallel Jacobi: a round turns n / 2 disjoint pairs of rows and columns, and a sweep's rounds meet all pairs; it ends once the squares off the diagonal
    sum to less than ``tolerance``. The matrix and the turned axes are one table of rows, each with its values as an array; a row meets its
    partner by a join, and what is turned within a row is done by the round's angles, n / 2 numbers. The largest part of each vector is positive.
    """
    if not (0 < tolerance < math.inf) or sweeps < 1:
        raise GraphError("the tolerance or the number of sweeps is not positive")
    from weftgraph.graph import dense_ids

    cells = materialize(cells.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("value").cast("double").alias("v")), "eig-cells")
    v = F.col("v")
    names = materialize(dense_ids(cells.select(F.col("src").alias("symbol")).union(cells.select("dst"))), "eig-ids")
    n = names.count()
    facts = cells.agg(F.count("*").alias("n"), F.count_distinct("src", "dst").alias("cells"), F.count(F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 1)).alias("odd")).first()
    if not n:
        raise GraphError("the matrix is empty")
    if facts["odd"]:
        raise GraphError("a value is not finite")
    if not facts["n"] == facts["cells"] == n * n:
        raise GraphError("the matrix is not a whole square")
    if not cells.join(cells.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("v").alias("w")), ["src", "dst"]).where(F.abs(v - F.col("w")) > 1e-12 * F.greatest(F.abs(v), F.abs("w"), F.lit(1.0))).isEmpty():
        raise GraphError("the matrix is not symmetric")
    e = cells.join(names.select(F.col("symbol").alias("src"), F.col("id").alias("i")), "src").join(names.select(F.col("symbol").alias("dst"), F.col("id").alias("j")), "dst")
    unit = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda x: F.when(x == F.col("i"), 1.0).otherwise(0.0))
    rows = e.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda s: s["v"]).alias("a")).select(F.col("i").cast("int").alias("i"), "a", unit.alias("u"))
    # the sum of squares off the diagonal, taken term by term so that it does not cancel
    off = F.aggregate(F.transform("a", lambda x, k: F.when(k == F.col("i"), 0.0).otherwise(x * x)), F.lit(0.0), lambda s, x: s + x)
    rows, facts = materialize_with(rows, "eig", off=F.sum(off))
    rounds = _rounds(n)
    for _ in range(sweeps):
        if facts["off"] < tolerance:
            break
        for pairs in rounds:
            other = {i: j for a, b in pairs for i, j in ((a, b), (b, a))}
            mate = F.get(F.array(*[F.lit(other.get(i, i)) for i in range(n)]), F.col("i"))
            paired = rows.withColumn("m", mate)
            both = paired.join(rows.select(F.col("i").alias("m"), F.col("a").alias("b")), "m")
            # the angle that clears the pair's cell, from its three values; both rows of a pair find the same one
            p_row, q_row = F.when(F.col("i") <= F.col("m"), F.col("a")).otherwise(F.col("b")), F.when(F.col("i") <= F.col("m"), F.col("b")).otherwise(F.col("a"))
            p, q = F.least("i", "m"), F.greatest("i", "m")
            app, aqq, apq = F.get(p_row, p), F.get(q_row, q), F.get(p_row, q)
            theta = (aqq - app) / (2 * apq)
            tan = F.when((apq == 0) | (p == q), 0.0).otherwise(F.when(theta >= 0, 1.0).otherwise(-1.0) / (F.abs(theta) + F.sqrt(theta * theta + 1)))
            tans = {r["i"]: r["t"] for r in both.select("i", tan.alias("t")).collect()}  # n numbers, as many as a row has values
            cosines = [1 / math.hypot(1, tans[i]) for i in range(n)]
            sines = [(-1.0 if i < other.get(i, i) else 1.0) * cosines[i] * tans[i] for i in range(n)]
            cos, sin, order = (F.array(*map(F.lit, x)) for x in (cosines, sines, [other.get(i, i) for i in range(n)]))
            across = lambda x: F.transform(x, lambda y, k: F.get(cos, k) * y + F.get(sin, k) * F.get(x, F.get(order, k)))
            own = [F.get(x, F.col("i")) for x in (cos, sin)]
            mixed = both.select("i", "u", F.zip_with("a", "b", lambda x, y: own[0] * x + own[1] * y).alias("x"))
            rows, facts = materialize_with(mixed.select("i", across(F.col("x")).alias("a"), across(F.col("u")).alias("u")), "eig", off=F.sum(off))
    else:
        raise GraphError("the rotations did not converge")
    # column k of u is the vector of value a[k][k]
    ranked = rows.select(F.col("i").alias("k0"), F.get("a", F.col("i")).alias("value")).collect()  # n numbers
    place = {r["k0"]: k for k, r in enumerate(sorted(ranked, key=lambda r: (-r["value"], r["k0"])))}
    spark = cells.sparkSession
    values = spark.createDataFrame([(place[r["k0"]], r["value"]) for r in ranked], "k int, value double")
    long = rows.select("i", F.posexplode("u").alias("k0", "x"))
    lead = long.groupBy("k0").agg(F.max(F.struct(F.abs("x").alias("m"), (-F.col("i")).alias("i"), F.signum("x").alias("s"))).alias("m")).select("k0", F.col("m.s").alias("s"))
    names_k = spark.createDataFrame(sorted(place.items()), "k0 int, k int")
    vectors = long.join(lead, "k0").join(names_k, "k0").join(names.select(F.col("id").cast("int").alias("i"), F.col("symbol").alias("id")), "i").select("k", "id", (F.col("x") * F.col("s")).alias("x"))
    return values, vectors


def classical_mds(cells: DataFrame, dimensions: int = 2, tolerance: float = 1e-12) -> tuple[DataFrame, DataFrame]:
    """(id, x array) and (stress): points whose distances come close to cells(src, dst, weight), from the largest eigenvalues of the centred squares.

    Distances are a whole symmetric square, not negative, 0 on the diagonal. An eigenvalue below 0 gives coordinates of 0.
    """
    bad = cells.agg(F.count("*").alias("n"), F.count_distinct("src").alias("points"), F.count(F.when(F.col("weight").isNull() | (F.col("weight") < 0) | F.isnan("weight"), 1)).alias("low"), F.count(F.when((F.col("src") == F.col("dst")) & (F.col("weight") != 0), 1)).alias("diagonal"), F.max("weight").alias("most")).first()
    if dimensions < 1 or bad["points"] < 2 or dimensions > bad["points"]:
        raise GraphError("there are fewer than two points, or too many dimensions or none")
    if bad["low"] or bad["diagonal"] or bad["most"] > 1e150:
        raise GraphError("a distance is negative, too large or not a number, or one on the diagonal is not 0")
    values, vectors = eigen(double_center(cells).select("src", "dst", "value"), tolerance)
    at = vectors.where(F.col("k") < dimensions).join(values, "k").select("id", "k", (F.col("x") * F.sqrt(F.greatest("value", F.lit(0.0)))).alias("y"))
    points = materialize(at.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "y"))), lambda s: s["y"]).alias("x")), "points")
    return points, stress(cells, points)
