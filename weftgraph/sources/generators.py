"""Deterministic graph families as arithmetic over ranges: undirected, each edge once, or as a Graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.graph import Graph, GraphError
from weftgraph.operators.access import positions
from weftgraph.runtime import materialize


def _graph(spark: SparkSession, n: int, edges: DataFrame) -> Graph:
    return Graph.build(spark.range(n), edges.select("src", "dst"))


def _pairs(spark: SparkSession, n: int, keep: Callable) -> DataFrame:
    """Pairs src < dst below n that ``keep(src, dst)`` allows; each row opens its own columns, nothing is crossed."""
    rows = spark.range(max(n - 1, 0)).select(F.col("id").alias("src"), F.explode(F.sequence(F.col("id") + 1, F.lit(n - 1).cast("long"))).alias("dst"))
    return rows.where(keep(F.col("src"), F.col("dst")))


def complete(spark: SparkSession, n: int) -> Graph:
    return _graph(spark, n, _pairs(spark, n, lambda s, d: F.lit(True)))


def path(spark: SparkSession, n: int) -> Graph:
    return _graph(spark, n, spark.range(max(n - 1, 0)).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))


def cycle(spark: SparkSession, n: int) -> Graph:
    """No edges below three vertices."""
    return _graph(spark, n, spark.range(n if n >= 3 else 0).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst")))


def star(spark: SparkSession, leaves: int) -> Graph:
    return _graph(spark, leaves + 1, spark.range(1, leaves + 1).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst")))


def wheel(spark: SparkSession, rim: int) -> Graph:
    """Hub 0 and a rim 1..rim; the rim closes from three vertices on."""
    ring = spark.range(rim if rim >= 3 else max(rim - 1, 0)).select((F.col("id") + 1).alias("src"), ((F.col("id") + 1) % max(rim, 1) + 1).alias("dst"))
    return _graph(spark, rim + 1, star(spark, rim).edges.where("src < dst").select("src", "dst").union(ring))


def grid(spark: SparkSession, rows: int, cols: int, wrap: bool = False) -> Graph:
    """Row-major grid; ``wrap`` joins the borders of a side of three or more, as a torus does."""
    i, j = (F.col("id") / cols).cast("long"), F.col("id") % cols
    ids = spark.range(rows * cols)
    right = ids.where(j + 1 < cols).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    down = ids.where(i + 1 < rows).select(F.col("id").alias("src"), (F.col("id") + cols).alias("dst"))
    e = right.union(down)
    if wrap and cols > 2:
        e = e.union(ids.where(j == cols - 1).select((F.col("id") - cols + 1).alias("src"), F.col("id").alias("dst")))
    if wrap and rows > 2:
        e = e.union(ids.where(i == rows - 1).select((F.col("id") - (rows - 1) * cols).alias("src"), F.col("id").alias("dst")))
    return _graph(spark, rows * cols, e)


def hypercube(spark: SparkSession, d: int) -> Graph:
    bits = F.explode(F.array(*[F.lit(1 << b).cast("long") for b in range(d)])) if d else F.explode(F.array().cast("array<bigint>"))
    e = spark.range(1 << d).select(F.col("id").alias("src"), bits.alias("bit")).select("src", F.col("src").bitwiseXOR(F.col("bit")).alias("dst")).where("src < dst")
    return _graph(spark, 1 << d, e)


def complete_bipartite(spark: SparkSession, a: int, b: int) -> Graph:
    return _graph(spark, a + b, _pairs(spark, a + b, lambda s, d: (s < a) & (d >= a)))


def crown(spark: SparkSession, n: int) -> Graph:
    return _graph(spark, 2 * n, _pairs(spark, 2 * n, lambda s, d: (s < n) & (d >= n) & (d - n != s)))


def turan(spark: SparkSession, n: int, r: int) -> Graph:
    """Vertices joined if their numbers differ modulo r."""
    return _graph(spark, n, _pairs(spark, n, lambda s, d: s % r != d % r))


def barbell(spark: SparkSession, k: int, p: int) -> Graph:
    """Two complete graphs on k vertices, joined through a path of p more."""
    left = _pairs(spark, k, lambda s, d: F.lit(True))
    right = left.select((F.col("src") + k + p).alias("src"), (F.col("dst") + k + p).alias("dst"))
    bridge = spark.range(k - 1, k + p).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    return _graph(spark, 2 * k + p, left.union(right).union(bridge))


def windmill(spark: SparkSession, cliques: int, size: int) -> Graph:
    """``cliques`` complete graphs of ``size`` vertices that share vertex 0."""
    m = size - 1
    inner = _pairs(spark, cliques * m + 1, lambda s, d: (s == 0) | (F.floor((s - 1) / m) == F.floor((d - 1) / m)))
    return _graph(spark, cliques * m + 1, inner)


def friendship(spark: SparkSession, n: int) -> Graph:
    return windmill(spark, n, 3)


def gnp(spark: SparkSession, seed: int, n: int, p: float) -> Graph:
    """Each pair is an edge if a hash of (seed, pair) falls below p; the same graph however it is partitioned."""
    scale = 1 << 52
    return _graph(spark, n, _pairs(spark, n, lambda s, d: F.pmod(F.xxhash64(F.lit(seed), s, d), F.lit(scale)) < int(p * scale)))


def random_tree(spark: SparkSession, seed: int, n: int) -> Graph:
    """Each vertex after the first hangs on a hashed earlier one."""
    e = spark.range(1, max(n, 1)).select(F.pmod(F.xxhash64(F.lit(seed), "id"), F.col("id")).alias("src"), F.col("id").alias("dst"))
    return _graph(spark, n, e)


def triangular_lattice(spark: SparkSession, rows: int, cols: int) -> Graph:
    """The grid with one diagonal in every cell, from the upper left to the lower right."""
    ids = spark.range(rows * cols)
    down = ids.where((F.col("id") % cols + 1 < cols) & ((F.col("id") / cols).cast("long") + 1 < rows)).select(F.col("id").alias("src"), (F.col("id") + cols + 1).alias("dst"))
    return _graph(spark, rows * cols, grid(spark, rows, cols).edges.where("src < dst").select("src", "dst").union(down))


def hexagonal_lattice(spark: SparkSession, rows: int, cols: int) -> Graph:
    """Brick wall of hexagons: the grid, whose vertical edges stay where row and column numbers have an even sum."""
    e = grid(spark, rows, cols).edges.where("src < dst").select("src", "dst")
    i, j = (F.col("src") / cols).cast("long"), F.col("src") % cols
    return _graph(spark, rows * cols, e.where((F.col("dst") == F.col("src") + 1) | ((i + j) % 2 == 0)))


def _chance(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the seed and columns: the same wherever md5 is."""
    text = F.concat_ws("/", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


def random_pairs(spark: SparkSession, n: int, chance: Callable, seed: int = 0) -> Graph:
    """Each pair src < dst with probability ``chance(src, dst)``, a column: block models and given expected degrees are such graphs."""
    s, d = F.col("src"), F.col("dst")
    return _graph(spark, n, _pairs(spark, n, lambda a, b: _chance(seed, a, b) < chance(s, d)))


def stochastic_block_model(spark: SparkSession, sizes: list[int], inside: float, between: float, seed: int = 0) -> Graph:
    """Blocks of consecutive vertices; an edge has probability ``inside`` within a block and ``between`` across."""
    ends = [sum(sizes[: i + 1]) for i in range(len(sizes))]
    block = lambda x: sum((F.when(x >= e, 1).otherwise(0) for e in ends[1:]), F.when(x >= ends[0], 1).otherwise(0))
    return random_pairs(spark, ends[-1], lambda s, d: F.when(block(s) == block(d), inside).otherwise(between), seed)


def chung_lu(spark: SparkSession, weights: list[float], seed: int = 0) -> Graph:
    """An edge has probability w_a w_b / sum(w), at most 1; the expected degree of a vertex is its weight."""
    w, total = F.array(*[F.lit(float(x)) for x in weights]), float(sum(weights))
    return random_pairs(spark, len(weights), lambda s, d: F.get(w, s.cast("int")) * F.get(w, d.cast("int")) / total, seed)


def gnm(spark: SparkSession, n: int, m: int, seed: int = 0) -> Graph:
    """The m pairs of the smallest hash; ties by the pair."""
    e = _pairs(spark, n, lambda s, d: F.lit(True)).orderBy(_chance(seed, F.col("src"), F.col("dst")), "src", "dst").limit(m)
    return _graph(spark, n, e)


def random_dag(spark: SparkSession, n: int, p: float, seed: int = 0) -> Graph:
    """Edges from lower to higher ids, each with probability p."""
    e = _pairs(spark, n, lambda s, d: _chance(seed, s, d) < p)
    return Graph.build(spark.range(n), e, directed=True)


def watts_strogatz(spark: SparkSession, n: int, k: int, p: float, seed: int = 0) -> Graph:
    """A ring in which each vertex has edges to its k / 2 next; each edge moves its far end, with probability p, to a hashed vertex.

    An edge that would become a loop or meet another stays where it was or falls together with it.
    """
    ring = spark.range(n).select(F.col("id").alias("a"), F.explode(F.sequence(F.lit(1), F.lit(k // 2))).alias("j"))
    far = (F.col("a") + F.col("j")) % n
    to = (_chance(seed + 1, F.col("a"), F.col("j")) * n).cast("long")
    e = ring.select("a", F.when((_chance(seed, F.col("a"), F.col("j")) < p) & (to != F.col("a")), to).otherwise(far).cast("long").alias("b"))
    return _graph(spark, n, e.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct())


def preferential_attachment(spark: SparkSession, n: int, seed: int = 0) -> Graph:
    """A tree in which each new vertex copies an end of an earlier edge: vertex v picks edge e < v - 1 by hash and joins one of its ends.

    An end that is itself a copy is resolved by rounds of pointer jumping, so all vertices attach at once.
    """
    v = spark.range(2, n).select(F.col("id"), (_chance(seed, F.col("id")) * (F.col("id") - 1)).cast("long").alias("e"), (_chance(seed + 1, F.col("id")) < 0.5).alias("near"))
    # edge k joins vertex k + 1 to its target; the near end is the vertex, the far end the target of that edge
    done = materialize(spark.range(1, min(n, 2)).select(F.col("id"), F.lit(0).cast("long").alias("to")).union(v.where("near").select("id", (F.col("e") + 1).alias("to"))), "targets")
    wait = materialize(v.where("not near").select("id", (F.col("e") + 1).alias("of")), "copies")
    while not wait.isEmpty():
        got = wait.join(done.select(F.col("id").alias("of"), "to"), "of")
        left = wait.join(wait.select(F.col("id").alias("of"), F.col("of").alias("next")), "of").select("id", F.col("next").alias("of"))
        done, wait = materialize(done.union(got.select("id", "to")), "targets"), materialize(left, "copies")
    return _graph(spark, n, done.select(F.least("id", "to").alias("src"), F.greatest("id", "to").alias("dst")))


def configuration_model(spark: SparkSession, degrees: DataFrame, seed: int = 0) -> Graph:
    """From degrees(id, degree): the ends of edges in hashed order, joined two by two; loops and repeated edges are dropped. An odd sum is an error."""
    stubs = degrees.where("degree > 0").select("id", F.explode(F.sequence(F.lit(1), F.col("degree").cast("int"))).alias("k"))
    placed = positions(stubs.select("id", "k", _chance(seed, F.col("id"), F.col("k")).alias("c")), F.asc("c"), F.asc("id"), F.asc("k"))
    ends = placed.groupBy((F.col("position") / 2).cast("long").alias("pair")).agg(F.min("id").alias("src"), F.max("id").alias("dst"), F.count("*").alias("n"))
    ends = materialize(ends, "stub-pairs")
    if not ends.where("n <> 2").isEmpty():
        raise GraphError("the sum of the degrees is odd")
    return Graph.build(degrees.select("id"), ends.where("src <> dst").select("src", "dst").distinct())


def random_regular(spark: SparkSession, n: int, k: int, seed: int = 0, most: int = 1000) -> Graph:
    """All vertices of degree k: pairings of ends are drawn until one has neither loop nor repeated edge; an error after ``most`` draws.

    A draw succeeds with a chance of about exp(-(k * k - 1) / 4), whatever n is, so k should be small.
    """
    if not 0 <= k < max(n, 1) or n * k % 2:
        raise GraphError("a regular graph needs k < n and an even n * k")
    for draw in range(most):
        g = configuration_model(spark, spark.range(n).select("id", F.lit(k).alias("degree")), seed * most + draw).kept()
        if g.edges.count() == n * k:
            return g
    raise GraphError("no regular graph was drawn")


def random_geometric(spark: SparkSession, n: int, radius: float, seed: int = 0) -> Graph:
    """Hashed points of the unit square, an edge where two are no further apart than ``radius``.

    Points meet in grid cells as wide as the radius: each is copied to the nine cells around its own, so the join is an equi-join.
    """
    if radius <= 0:
        return _graph(spark, n, spark.range(0).select(F.col("id").alias("src"), F.col("id").alias("dst")))
    pts = spark.range(n).select("id", _chance(seed, F.col("id")).alias("x"), _chance(seed + 1, F.col("id")).alias("y"))
    cell = lambda c: F.floor(F.col(c) / radius)
    near = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    a = pts.select(F.col("id").alias("src"), F.col("x").alias("x1"), F.col("y").alias("y1"), cell("x").alias("i"), cell("y").alias("j"))
    b = pts.select(F.col("id").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"), near.alias("di")).select("*", near.alias("dj"))
    b = b.select("dst", "x2", "y2", (F.floor(F.col("x2") / radius) + F.col("di")).alias("i"), (F.floor(F.col("y2") / radius) + F.col("dj")).alias("j"))
    far = (F.col("x1") - F.col("x2")) * (F.col("x1") - F.col("x2")) + (F.col("y1") - F.col("y2")) * (F.col("y1") - F.col("y2"))
    return _graph(spark, n, a.join(b, ["i", "j"]).where((F.col("src") < F.col("dst")) & (far <= radius * radius)).select("src", "dst"))
