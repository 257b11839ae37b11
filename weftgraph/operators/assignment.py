"""Assignments of least cost by auction: free rows bid, columns keep the best bid, prices are a table.

A round is one job. Costs become whole numbers times n + 1, so that once bids rise by 1 the assignment found is within n of the optimum,
which is less than one unit of cost: it is optimal. Larger rises come first and leave good prices behind.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.graph import GraphError
from weftgraph.operators.flows import hopcroft_karp
from weftgraph.runtime import materialize, materialize_with


class AssignmentError(GraphError):
    """A matrix or parameter that the assignment solvers refuse; ``kind`` names the rule."""

    def __init__(self, kind: str, text: str):
        super().__init__(f"{kind}: {text}")
        self.kind = kind


@dataclass(frozen=True)
class Assignment:
    """``pairs``(src, dst, weight); ``arcs``(row, col, cost) with whole scaled costs and ``columns``(col, price, row), which prove it."""

    pairs: DataFrame
    arcs: DataFrame
    columns: DataFrame

    def proof(self) -> DataFrame:
        """(size, cost, gap, violations): pairs and their cost; scaled cost above what the prices allow at least, less than one unit's n + 1 if optimal; rows whose column is not their best but for 1."""
        owned = self.columns.select("col", "price", F.col("row").alias("by"))
        priced = self.arcs.join(owned, "col").select("row", (F.col("cost") + F.col("price")).alias("v"), (F.col("by") == F.col("row")).alias("own"))
        best = priced.groupBy("row").agg(F.min("v").alias("best"), F.min(F.when(F.col("own"), F.col("v"))).alias("got"))
        over = best.agg(F.sum(F.col("got") - F.col("best")).alias("gap"), F.count(F.when(F.col("got").isNull() | (F.col("got") > F.col("best") + 1), 1)).alias("violations"), F.count("*").alias("rows"))
        told = self.pairs.agg(F.count("*").alias("size"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("cost"))
        return told.crossJoin(over).select("size", "cost", (F.coalesce("gap", F.lit(0)) > F.col("rows")).cast("int").alias("gap"), "violations")


def _bound(name: str, value: float) -> None:
    if not math.isfinite(value):
        raise AssignmentError(f"{name}NotFinite", str(value))
    if value <= 0:
        raise AssignmentError(f"{name}NotPositive", str(value))


def _entries(entries: DataFrame, max_cost: float, decimals: int) -> tuple[DataFrame, dict]:
    """Checked (src, dst, weight, units): the weight in whole units of 10^-decimals."""
    _bound("MaximalCost", max_cost)
    w = F.col("weight")
    e = entries.select("src", "dst", w.cast("double").alias("weight"))
    bad = w.isNull() | F.isnan(w) | (F.abs(w) == float("inf"))
    seen = {"n": F.count("*"), "odd": F.count(F.when(bad, 1)), "zero": F.count(F.when(w == 0, 1)), "low": F.count(F.when(w < 0, 1)), "high": F.count(F.when(~bad & (w >= max_cost), 1)), "most": F.max(F.when(~bad, w))}
    out, facts = materialize_with(e.withColumn("units", F.when(~bad, F.round(w * 10**decimals)).cast("long")), "entries", **seen)
    for kind, key in (("NonFiniteValues", "odd"), ("ZeroValues", "zero"), ("NegativeValues", "low"), ("ValueTooLarge", "high")):
        if facts[key]:
            raise AssignmentError(kind, f"{facts[key]} entries")
    return out, facts


def _auction(arcs: DataFrame, rise: int = 16) -> tuple[DataFrame, DataFrame]:
    """Scaled arcs(row, col, cost) and columns(col, price, row) of an assignment of all rows of arcs(row, col, units); one must exist."""
    rows = materialize(arcs.select("row").distinct(), "rows")
    n = rows.count()
    arcs, facts = materialize_with(arcs.select("row", "col", (F.col("units") * (n + 1)).alias("cost")), "arcs", most=F.max("cost"), least=F.min("cost"))
    cols = materialize(arcs.select("col").distinct().select("col", F.lit(0).cast("long").alias("price"), F.lit(None).cast("long").alias("row")), "columns")
    span = (facts["most"] or 0) - (facts["least"] or 0)
    eps = max(1, span // rise)
    order = Window.partitionBy("row").orderBy("v", "col")
    while n:
        cols, taken = cols.withColumn("row", F.lit(None).cast("long")), 0
        while taken < n:
            free = rows.join(cols.where("row is not null").select("row"), "row", "left_anti")
            offers = arcs.join(free, "row").join(cols.select("col", "price"), "col").select("row", "col", "price", (F.col("cost") + F.col("price")).alias("v"))
            two = offers.withColumn("k", F.row_number().over(order)).where("k <= 2")
            bid = two.groupBy("row").agg(F.min(F.when(F.col("k") == 1, F.struct("col", "price", "v"))).alias("b"), F.min(F.when(F.col("k") == 2, F.col("v"))).alias("second"))
            # a row of one column gives more than any other row would
            raised = F.col("b.price") + F.coalesce(F.col("second") - F.col("b.v"), F.lit(2 * span + 1)) + F.lit(eps)
            won = bid.select(F.col("b.col").alias("col"), raised.alias("bid"), F.col("row").alias("by")).groupBy("col").agg(F.max(F.struct("bid", "by")).alias("w"))
            new = cols.join(won, "col", "left").select("col", F.coalesce("w.bid", "price").alias("price"), F.coalesce("w.by", "row").alias("row"))
            cols, facts = materialize_with(new, "columns", taken=F.count("row"))
            taken = facts["taken"]
        if eps == 1:
            break
        eps = max(1, eps // rise)
    return arcs, cols


def lapmod(entries: DataFrame, rows: DataFrame, columns: DataFrame, max_cost: float, decimals: int = 2) -> Assignment:
    """The perfect assignment of least cost over entries(src, dst, weight) of a square matrix with rows(id) and columns(id).

    Entries that are not there cannot be used. Weights are positive, finite and below ``max_cost``, and are compared in units of
    10^-decimals. A matrix that is not square or has no perfect assignment is an ``AssignmentError``; an empty one has no pairs.
    """
    e, facts = _entries(entries, max_cost, decimals)
    n = rows.count()
    if n != columns.count():
        raise AssignmentError("NonSquareMatrix", "rows and columns differ in number")
    if facts["n"] < n * n and hopcroft_karp(e).count() < n:
        raise AssignmentError("InfeasibleAssignment", "no perfect assignment exists")
    arcs, cols = _auction(e.select(F.col("src").alias("row"), F.col("dst").alias("col"), "units"))
    got = cols.where("row is not null").select(F.col("row").alias("src"), F.col("col").alias("dst"))
    return Assignment(got.join(e, ["src", "dst"]).select("src", "dst", "weight"), arcs, cols)


def lapjv(entries: DataFrame, rows: DataFrame, columns: DataFrame, max_cost: float, decimals: int = 2) -> Assignment:
    """``lapmod`` for a dense matrix: every cell has an entry, and there is one at least."""
    n = rows.count()
    if not n:
        raise AssignmentError("EmptyMatrix", "no rows")
    if n == columns.count() and entries.select("src", "dst").distinct().count() < n * n:
        raise AssignmentError("ExpandedMatrixBuildFailed", "a cell has no entry")
    return lapmod(entries, rows, columns, max_cost, decimals)


hungarian = lapjv


def _padded(entries: DataFrame, padding: float, max_cost: float, decimals: int, share: float) -> Assignment:
    """Least sum of the weights of pairs, plus ``padding`` for each pair that could be and is not; no weight may exceed padding * share.

    The matrix grows by a private column for each row and a private row for each column at half the padding, and free cells between those
    for each entry (the diagonal extension): 2 |E| + L + R arcs, with a perfect assignment for certain. No cell is filled in.
    """
    _bound("PaddingValue", padding)
    e, facts = _entries(entries, max_cost, decimals)
    if padding >= max_cost:
        raise AssignmentError("ValueTooLarge", "the padding reaches the maximal cost")
    if facts["n"] and facts["most"] > padding * share or share < 1 and facts["n"] and facts["most"] >= padding * share:
        raise AssignmentError("PaddingCostTooSmall", f"a weight exceeds {padding * share}")
    half = F.lit(round(padding * 10**decimals)).cast("long")
    real, inner = e.select((F.col("src") * 2).alias("row"), (F.col("dst") * 2).alias("col"), (F.col("units") * 2).alias("units")), e.select((F.col("dst") * 2 + 1).alias("row"), (F.col("src") * 2 + 1).alias("col"), F.lit(0).cast("long"))
    alone = e.select("src").distinct().select(F.col("src") * 2, F.col("src") * 2 + 1, half).union(e.select("dst").distinct().select(F.col("dst") * 2 + 1, F.col("dst") * 2, half))
    arcs, cols = _auction(real.union(inner).union(alone))
    got = cols.where("row % 2 = 0 and col % 2 = 0").select((F.col("row") / 2).cast("long").alias("src"), (F.col("col") / 2).cast("long").alias("dst"))
    return Assignment(got.join(e, ["src", "dst"]).select("src", "dst", "weight"), arcs, cols)


def jaqaman(entries: DataFrame, padding: float, max_cost: float, decimals: int = 2) -> Assignment:
    """Rectangular assignment of the most pairs, and of these the cheapest; the padding must exceed twice every weight. An empty matrix has no pairs."""
    return _padded(entries, padding, max_cost, decimals, 0.5)


def crouse(entries: DataFrame, non_edge_cost: float, max_cost: float, decimals: int = 2) -> Assignment:
    """Rectangular assignment in which a cell without an entry costs ``non_edge_cost``, which no weight may exceed; only real pairs are returned.

    Rows and columns without an entry change nothing and take no part.
    """
    return _padded(entries, non_edge_cost, max_cost, decimals, 1.0)


#: Filling up with a padding and leaving out the filled pairs asks for the same pairs as ``crouse``.
sparse_lapjv = sparse_hungarian = crouse
